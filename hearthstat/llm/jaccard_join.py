"""Similarity self-join of word n-gram sets by prefixes under several global orders.

Two sets are linked when 100 times their common n-grams are at least ``percent`` times all
of theirs.  Linked sets of n elements share an element of their first n - need + 1 under any
order of all n-grams.  An order puts n-grams of rare classes first, by a sketch of document
frequencies over the whole corpus (a fixed number of counters), then goes by a hash; the
sketch bears only on cost, any order gives the same links.

1. Documents of equal sets form one class; all further steps see classes.
2. Classes with the same first n-gram under one of ``LEADS`` orders are compared with the
   smallest class of that group only, and linked classes joined to components.  A group of
   near copies, of any size, thus costs one comparison for each copy and order.
3. Candidates are the pairs of classes from different components that share a prefix n-gram
   under the first order, at places that leave enough n-grams behind, and under each further
   order, intersected before verification.  Pairs inside a component need none: they cannot
   change components; so a few classes of each group are compared with the others first, in
   rounds of 1, 4, 16 and 64 (``ROUNDS``) while a round finds a link for every ``WORTH`` rows, which
   leaves few components to a group of near copies.  Each group draws its own classes in each
   round: near copies share many groups, and one class that links with few of them would else
   stand for all.  Before a pair of the first order is written at all, the parities of both
   sets are compared: each n-gram flips one of ``BITS`` bits, so two sets differ in at least
   as many n-grams as bits, and linked sets differ in few.  No link is lost by that.
4. Candidates are verified on the texts; components are joined again.

N-grams are compared by 64-bit hashes of their words, A-Z lower-cased.

Defined results: NULL text and texts without words have no n-gram and form components of
their own; with fewer than ``k`` words the whole sequence is the one n-gram; repeated rows
and repeated ids are members of one class; NULL ids never name a component unless no member
has an id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import mixed, prefix_sums, span_hashes, text_slices, window_hashes, words
from .components import components
from .staging import forget, staged

K, PERCENT = 3, 90
ORDERS = 3  # under which candidates must share a prefix n-gram
LEADS = 4  # orders whose first n-gram groups classes for step 2
ROUNDS = (1, 4, 16, 64)  # classes of each prefix group that are compared with all others of it
WORTH = 1000  # rows for each of which a round must find a link, or it was the last
COUNTERS, BLOCK = 1 << 20, 1 << 12
BITS = 512  # of a set's parities
_PARITY = [f"s{i}" for i in range(BITS // 64)]


def sets(column, k: int = K):
    """Yield each row's sorted distinct n-gram hashes; NULL has none."""
    for _, offsets, data in text_slices(column):
        starts, ends, first = words(offsets, data)
        hashes = span_hashes(prefix_sums(data, True), starts, ends)
        grams, begins = window_hashes(hashes, first, k)
        count = np.diff(first)
        for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
            if b > a:
                yield np.unique(grams[a:b])
            elif count[i]:
                whole = np.array([count[i]], np.uint64)
                for at in range(first[i], first[i + 1]):
                    whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def overlap_needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class Orders:
    """Global orders of all n-grams: by class of frequency, then by a hash of their own."""

    def __init__(self, counters: np.ndarray):
        # Other n-grams in the same counter add a usual amount with a usual spread; half
        # octaves of what exceeds both tell frequencies apart.
        usual = float(np.median(counters))
        spread = max(1.0, usual**0.5)
        excess = np.maximum(counters - usual - 2 * spread, 0) / spread
        self.classes = np.minimum(2 * np.log2(1 + excess), 63).astype(np.uint8)

    def prefix(self, grams: np.ndarray, order: int, length: int) -> np.ndarray:
        """The first ``length`` n-grams, first one first."""
        rank = mixed(grams + np.uint64(0xD1B54A32D192ED03 * (order + 1) % (1 << 64))) >> np.uint64(6)
        rank |= self.classes[grams & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(58)
        if length < len(grams):
            at = np.argpartition(rank, length - 1)[:length]
            return grams[at[np.argsort(rank[at])]]
        return grams[np.argsort(rank)]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The id, ``n_shingles``, ``class_id`` (hash of the set, NULL without words) and ``component_id`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("uid"), F.col(text_col).alias("text"))
    read = staged(_read(rows, k), "sets")
    members = read.filter("block is null").select("id", "uid", "node", "n")
    orders = Orders(_counters(read))
    parities = [F.max(c).alias(c) for c in _PARITY]  # a class has one set
    classes = staged(read.filter("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.min("uid").alias("uid"), F.max("n").alias("n"), *parities), "classes")
    prefixes = staged(_prefixes(rows, orders, k, percent), "prefixes")

    leads = prefixes.filter("rank = 0").select("ord", "token", "node", "n").distinct()
    pivot = leads.groupBy("ord", "token").agg(F.min("node").alias("a"), F.max("node").alias("_z"), F.min_by("n", "node").alias("na")).filter("a <> _z")
    stars = leads.join(pivot, ["ord", "token"]).filter("node <> a").select("a", "na", F.col("node").alias("b"), F.col("n").alias("nb"))
    stars = staged(_alike(stars, percent).distinct(), "stars")
    links = staged(_verified(stars, rows, classes, orders, k, percent), "links")
    near = staged(components(links), "components")

    first = prefixes.filter("ord = 0").select("token", "node", "n", "rank")
    placed = _shared(_in_components(_shared(first, "node"), near), "component").join(classes.select("node", *_PARITY), "node")
    placed = staged(placed, "candidates")
    forget(prefixes)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for many in ROUNDS:
        # Every group's classes against a few of them: at most so many pairs for each row.
        drawn = F.xxhash64("node", "token", F.lit(many))
        pivots = placed.groupBy("token", F.pmod(drawn, F.lit(many)).alias("_part")).agg(F.min_by("node", drawn).alias("pivot"))
        pivots = placed.join(pivots.drop("_part"), "token").filter("node = pivot").drop("pivot")
        pairs = staged(_pairs(pivots, placed, percent, "a <> b").join(tried, ["a", "b"], "left_anti"), "pairs")
        found = staged(_verified(pairs, rows, classes, orders, k, percent), "links")
        tried, links, rows_left = tried.union(pairs), found.count(), placed.count()
        if not links:
            break
        near = staged(_merged(near, found), "components")
        again = placed.drop("component")
        placed, old = staged(_shared(_in_components(again, near), "component"), "candidates"), placed
        forget(old)
        if links * WORTH < rows_left:
            break
    pairs = staged(_pairs(placed, placed, percent, "a < b").join(tried, ["a", "b"], "left_anti"), "pairs")
    whole = staged(_merged(near, staged(_verified(pairs, rows, classes, orders, k, percent), "links")), "components")

    named = classes.join(whole, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    out = members.join(named, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), own.alias("component_id"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _node(grams: np.ndarray) -> np.ndarray:
    """A set's class: a hash of its elements in any order."""
    return mixed(np.array([mixed(grams).sum(dtype=np.uint64) ^ np.uint64(len(grams))], np.uint64))


def _parities(grams: np.ndarray) -> np.ndarray:
    """One bit for each of ``BITS`` classes of n-grams: whether the set has an odd number of them."""
    odd = np.bincount((grams >> np.uint64(24) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _read(rows: DataFrame, k: int) -> DataFrame:
    """A row (id, uid, node, n, parities) for each document; each task's frequency counters, a row for each block."""
    parities = ", ".join(f"{c} long" for c in _PARITY)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, uid long, node long, n long, block int, counts array<int>, {parities}"
    names = ["id", "uid", "node", "n", "block", "counts", *_PARITY]
    kind = pa.list_(pa.int32())

    def read(batches):
        counters = np.zeros(COUNTERS, np.int64)
        id_type = None
        for batch in batches:
            id_type, nodes, sizes, odd, held, size = batch.column(0).type, [], [], [], [], 0
            for grams in sets(batch.column(2), k):
                nodes.append(_node(grams)[0] if len(grams) else np.uint64(0))
                sizes.append(len(grams))
                odd.append(_parities(grams))
                held.append(grams)
                size += len(grams)
                if size > 1 << 19:
                    counters += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                    held, size = [], 0
            if held:
                counters += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            n = batch.num_rows
            sizes = np.array(sizes, np.int64)
            node = pa.array(np.array(nodes, np.uint64).view(np.int64), mask=sizes == 0)
            odd = np.array(odd, np.int64).reshape(n, len(_PARITY))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(sizes), pa.nulls(n, pa.int32()), pa.nulls(n, kind), *map(pa.array, odd.T)], names=names)
        if id_type is not None:
            m = COUNTERS // BLOCK
            counts = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * BLOCK, pa.int32()), pa.array(np.minimum(counters, 2**31 - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.array(np.arange(m), pa.int32()), counts, *(pa.nulls(m, pa.int64()) for _ in _PARITY)], names=names)

    return rows.mapInArrow(read, schema)


def _counters(read: DataFrame) -> np.ndarray:
    """The tasks' counters added up: COUNTERS numbers, whatever the corpus."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += counts.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    blocks = read.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts array<long>")
    counters = np.zeros(COUNTERS, np.int64)
    for row in blocks.toArrow().to_pylist():
        counters[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["counts"]
    return counters


def _prefixes(rows: DataFrame, orders: Orders, k: int, percent: int) -> DataFrame:
    """Prefix n-grams under order 0, and the first n-gram under each order that leads."""

    def prefixes(batches):
        for batch in batches:
            tokens, nodes, sizes, order, rank = [], [], [], [], []
            for grams in sets(batch.column(0), k):
                n = len(grams)
                if not n:
                    continue
                length = n - overlap_needed(n, percent) + 1
                tokens.append(orders.prefix(grams, 0, length))
                tokens += [orders.prefix(grams, o, 1) for o in range(1, LEADS)]
                m = length + LEADS - 1
                nodes.append(np.full(m, _node(grams)[0]))
                sizes.append(np.full(m, n))
                order.append(np.concatenate((np.zeros(length), np.arange(1, LEADS))))
                rank.append(np.concatenate((np.arange(length), np.zeros(LEADS - 1))))
            if tokens:
                ints = [pa.array(np.concatenate(x), pa.int32()) for x in ([y.astype(np.int32) for y in z] for z in (sizes, order, rank))]
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), _signed(np.concatenate(nodes)), *ints], names=["token", "node", "n", "ord", "rank"])

    return rows.select("text").mapInArrow(prefixes, "token long, node long, n int, ord int, rank int")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow a link."""
    return pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")


def _in_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component of their ``node``, which is the node itself if it has no link."""
    joined = rows.join(found, "node", "left")
    return joined.select(*rows.columns, F.coalesce("component", "node").alias("component")).distinct()


def _merged(near: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``near`` and further ``links``: whole components are joined, not their nodes again."""
    for end in ("a", "b"):
        known = near.select(F.col("node").alias(end), F.col("component").alias("_c"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    joined = staged(components(links), "joined").select(F.col("node").alias("component"), F.col("component").alias("_now"))
    moved = near.join(joined, "component", "left").select("node", F.coalesce("_now", "component").alias("component"))
    # A component's name is one of its nodes; others are nodes that had no link yet.
    fresh = joined.select(F.col("component").alias("node"), F.col("_now").alias("component"))
    return moved.union(fresh.join(near, "node", "left_anti"))


def _pairs(left: DataFrame, right: DataFrame, percent: int, which: str) -> DataFrame:
    """Classes of different components with a common prefix n-gram that may be linked, the lower one as ``a``."""

    def side(rows, name):
        return rows.select("token", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "rank", "component", *_PARITY)))

    n_a, n_b = F.col("n_a"), F.col("n_b")
    # From the first common n-gram on, both sets still hold all that they share.
    enough = F.least(n_a - F.col("rank_a"), n_b - F.col("rank_b")) * (100 + percent) >= (n_a + n_b) * percent
    differing = functools.reduce(Column.__add__, (F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _PARITY))
    # Linked sets differ in (100 - percent) / (100 + percent) of both sizes' sum at most.
    near_enough = differing * (100 + percent) <= (n_a + n_b) * (100 - percent)
    joined = side(left, "a").join(side(right, "b"), "token").filter(which).filter("component_a <> component_b")
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    kept = joined.filter(sized).filter(enough).filter(near_enough)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared(prefixes: DataFrame, by: str) -> DataFrame:
    """Rows whose token occurs with several values of ``by``."""
    tokens = prefixes.groupBy("token").agg(F.min(by).alias("_low"), F.max(by).alias("_high")).filter("_low <> _high").select("token")
    return prefixes.join(tokens, "token")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, orders: Orders, k: int, percent: int) -> DataFrame:
    """Linked ones among ``pairs``: prefixes under the further orders first, then whole sets."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = classes.join(nodes, "node").select("uid", "node")
    # Repeated rows go where the join has put them anyway.
    texts = rows.join(wanted, "uid").dropDuplicates(["uid"]).select("node", "text")

    def prefixes(batches):
        for batch in batches:
            out, cuts = [], [0]
            for grams in sets(batch.column(1), k):
                length = len(grams) - overlap_needed(len(grams), percent) + 1
                for o in range(1, ORDERS):
                    out.append(orders.prefix(grams, o, length))
                    cuts.append(cuts[-1] + length)
            # Halves of the hashes do: the filter may only let more pairs through.
            flat = pa.array((np.concatenate(out) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if out else [], pa.int32())
            step = ORDERS - 1
            columns = [pa.ListArray.from_arrays(pa.array([*cuts[0:-1], cuts[-1]], pa.int32()), flat)]
            lists = [columns[0].take(pa.array(np.arange(batch.num_rows) * step + i)) for i in range(step)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["node", "text", *(f"p{o}" for o in range(1, ORDERS))])

    lists = ", ".join(f"p{o} array<int>" for o in range(1, ORDERS))
    texts = staged(texts.mapInArrow(prefixes, f"node long, text string, {lists}"), "texts")
    side = lambda name, columns: texts.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    further = [f"p{o}" for o in range(1, ORDERS)]
    kept = pairs.join(side("a", further), "a").join(side("b", further), "b")
    for p in further:
        kept = kept.filter(F.arrays_overlap(f"{p}_a", f"{p}_b"))
    kept = staged(kept.select("a", "b"), "filtered")

    def verify(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(sets(batch.column(2), k), sets(batch.column(3), k))):
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked))

    joined = kept.join(side("a", ["text"]), "a").join(side("b", ["text"]), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(verify, "a long, b long")
