"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens are words, A-Z lower-cased, and one end for each text.  The model spells them: the
bytes of a word and a space, or a line feed for the end.  Each context of up to ``DEPTH``
bytes is a restaurant; its parent is the context without its first byte, shared by all
contexts with the same last bytes; the root's parent is uniform.  A restaurant's tables are
its parent's customers.  Seatings are sampled by Gibbs: the customers of one dish in one
restaurant are reseated one after another given all others, with a new table as likely as
the parent's probability of the dish makes it (in blocks of an eighth once many sit).  After
``BURN_IN`` sweeps the predictive probabilities of ``DRAWS`` sweeps are averaged.

How it is distributed:

1. Texts are dealt out to chunks of about ``CHUNK_BYTES``.  A chunk yields its distinct
   (context, byte) strings and distinct words with their counts in training texts, packed in
   one row for each bucket: the last two bytes of the context, or a part of the words' hashes.
2. Counts are added up by bucket in two steps, first over ``GROUP`` chunks at a time.  A
   bucket of contexts is one subtree below level 1, at most as large as its distinct strings.
3. The two top levels (at most 256 * 257 dishes) are seated by the driver; their customers
   are one table for each dish of level 2.
4. For each bucket and group of chunks the subtree is sampled, from a seed of the bucket, and
   the chunks' strings get their probabilities; words get their counts.
5. Each chunk's texts meet the chunk's probabilities and are scored.

So no task holds the model or the corpus, and what is gathered grows with the texts.

Defined results: NULL and empty texts consist of the end alone; repeated rows are scored each
for itself and count in training each; without training texts every string has the top
levels' uniform probability; NULL ids stay NULL; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import prefix_sums, span_hashes, text_slices, words
from .staging import forget, staged

DEPTH = 5
SYMBOLS = 256
BURN_IN, DRAWS = 3, 4
STRENGTH = 0.5
CHUNK_BYTES, GROUP = 16 << 20, 64
WORD_BUCKETS = 256
SPACE, END = 32, 10
END_HASH = np.uint64(1)


class Restaurants:
    """All contexts of length ``low`` to ``deep`` that occur, seated."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, deep: int, low: int, above: np.ndarray, seed: int):
        self.deep, self.low, self.above = deep, low, above
        self.rng = np.random.default_rng(seed)
        self.keys, self.contexts, self.at, self.parent = {}, {}, {}, {}
        self.customers, self.tables, self.discount = {}, {}, {}
        self.keys[deep], self.customers[deep] = strings, counts.astype(np.int64)
        for level in range(deep, low - 1, -1):
            if level < deep:
                self.keys[level], self.parent[level + 1] = np.unique(self.keys[level + 1] & _mask(level), return_inverse=True)
                self.customers[level] = np.bincount(self.parent[level + 1], minlength=len(self.keys[level]))
            self.contexts[level], self.at[level] = np.unique(self.keys[level] >> 8, return_inverse=True)
            self.tables[level] = np.ones(len(self.keys[level]), np.int64)
            once, twice = (self.customers[level] == 1).sum(), (self.customers[level] == 2).sum()
            self.discount[level] = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))

    def _totals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.contexts[level])
        return np.bincount(self.at[level], self.customers[level], n), np.bincount(self.at[level], self.tables[level], n)

    def _parents(self) -> dict[int, np.ndarray]:
        """Each dish's probability in the parent restaurant."""
        out, p = {}, self.above[self.keys[self.low] & 255]
        for level in range(self.low, self.deep + 1):
            out[level] = p if level == self.low else p[self.parent[level]]
            c, t = self._totals(level)
            d, at = self.discount[level], self.at[level]
            p = (self.customers[level] - d * self.tables[level] + (STRENGTH + d * t[at]) * out[level]) / (STRENGTH + c[at])
        return out

    def sweep(self) -> None:
        """Reseat every dish of every restaurant, deepest first."""
        parents = self._parents()
        for level in range(self.deep, self.low - 1, -1):
            if level < self.deep:
                self.customers[level] = np.bincount(self.parent[level + 1], self.tables[level + 1], len(self.keys[level])).astype(np.int64)
            _, t = self._totals(level)
            others = t[self.at[level]] - self.tables[level]
            self.tables[level] = self._reseat(self.customers[level], others, parents[level], self.discount[level])

    def _reseat(self, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
        order = np.argsort(-customers, kind="stable")
        left, tables = customers[order], np.ones(len(customers), np.int64)
        others, parent = others[order], parent[order]
        seated, n = 1, len(order)
        while True:
            n = int(np.searchsorted(-left[:n], -seated))  # dishes with more customers than sit
            if not n:
                break
            block = np.minimum(max(1, seated // 8), left[:n] - seated)
            new = (STRENGTH + d * (others[:n] + tables[:n])) * parent[:n]
            new = new / (new + np.maximum(seated - d * tables[:n], 1e-9))
            tables[:n] += self.rng.binomial(block, new)
            seated += max(1, seated // 8)
        out = np.empty(len(customers), np.int64)
        out[order] = np.minimum(tables, left)
        return out

    def averaged(self, strings: np.ndarray) -> np.ndarray:
        """Predictive probability of each string's last symbol, averaged over sampled seatings."""
        if not len(self.keys[self.deep]):
            return self.above[strings & 255]
        rows = {level: _found(self.keys[level], strings & _mask(level)) for level in range(self.low, self.deep + 1)}
        rooms = {level: _found(self.contexts[level], (strings & _mask(level)) >> 8) for level in rows}
        total = np.zeros(len(strings))
        for k in range(BURN_IN + DRAWS):
            self.sweep()
            if k < BURN_IN:
                continue
            p = self.above[strings & 255]
            for level in range(self.low, self.deep + 1):
                c, t = self._totals(level)
                row, room, d = rows[level], rooms[level], self.discount[level]
                own = np.where(row >= 0, np.maximum(self.customers[level][row] - d * self.tables[level][row], 0), 0)
                p = np.where(room >= 0, (own + (STRENGTH + d * t[room]) * p) / (STRENGTH + c[room]), p)
            total += p
        return total / DRAWS


def _mask(level: int) -> int:
    return (1 << 8 * (level + 1)) - 1


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def strings(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every symbol that spells the rows, and each row's first (n + 1 values)."""
    starts, ends, first = words(offsets, data)
    n = len(offsets) - 1
    lengths = ends - starts + 1
    begin = np.concatenate(([0], np.cumsum(lengths)))
    row_begin = begin[first] + np.arange(n + 1)  # one end for each row before
    at = begin[:-1] + np.repeat(np.arange(n), np.diff(first))
    spelled = np.full(row_begin[-1], SPACE, np.uint8)
    inside = np.repeat(at - starts, lengths - 1)
    source = np.arange(len(inside)) + np.repeat(starts - (begin[:-1] - np.arange(len(starts))), lengths - 1)
    low = data[source]
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    spelled[source + inside] = low
    spelled[row_begin[1:] - 1] = END
    padded = np.insert(spelled, np.repeat(row_begin[:-1], DEPTH), END).astype(np.int64)
    where = np.arange(len(spelled)) + DEPTH * (np.repeat(np.arange(n), np.diff(row_begin)) + 1)
    out = np.zeros(len(spelled), np.int64)
    for k in range(DEPTH, -1, -1):
        out = out << 8 | padded[where - k]
    return out, row_begin


def token_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every token, the end's last in its row, and each row's first (n + 1 values)."""
    starts, ends, first = words(offsets, data)
    hashes = span_hashes(prefix_sums(data, True), starts, ends)
    hashes = np.insert(hashes, first[1:], END_HASH)
    return hashes.view(np.int64), first + np.arange(len(first))


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    new = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[new], np.add.reduceat(n, new) if len(new) else n


def _slice_counts(keys: np.ndarray, trained: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts in training rows, and those of the other rows with 0."""
    out = []
    for flag in (True, False):
        part = np.sort(keys[trained == flag])
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        out.append((part[new], np.diff(np.append(new, len(part))) if flag else np.zeros(len(new), np.int64)))
    return out


class Lookup:
    """Values of distinct keys, found by open addressing; only held keys are asked for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at[left]] < 0
            tried = left[free]
            self.slots[at[tried]] = tried  # of several for one place one stays
            left = np.concatenate((left[~free], tried[self.slots[at[tried]] != tried]))
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self._first(wanted)
        found = self.slots[at]
        wrong = np.flatnonzero(self.keys[found] != wanted)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[self.keys[found[wrong]] != wanted[wrong]]
        return self.values[found]


def _bucket_of(kind: int, keys: np.ndarray) -> np.ndarray:
    """Contexts by their last two bytes, words by a part of their hash (negative)."""
    return keys >> 8 & 0xFFFF if kind == 0 else -1 - (keys & (WORD_BUCKETS - 1))


def _packed(bucket: int, keys: np.ndarray) -> bytes:
    """A bucket's keys in order; of contexts four bytes are left besides the bucket's two."""
    if bucket < 0:
        return keys.astype("<i8").tobytes()
    return ((keys >> 24 << 8) | (keys & 255)).astype("<u4").tobytes()


def _keys(bucket: int, row: bytes) -> np.ndarray:
    if bucket < 0:
        return np.frombuffer(row, "<i8")
    short = np.frombuffer(row, "<u4").astype(np.int64)
    return short >> 8 << 24 | bucket << 8 | short & 255


def _value_kind(bucket: int) -> str:
    """Word counts are exact as doubles; log probabilities are summed, floats will do."""
    return "<f8" if bucket < 0 else "<f4"


def _chunk_rows(group: int):
    def collect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        pending = 0
        for batch in batches:
            trained = np.asarray(batch.column("train"))
            for row, offsets, data in text_slices(batch.column("text")):
                use = trained[row : row + len(offsets) - 1]
                for kind, (keys, first) in enumerate((strings(offsets, data), token_hashes(offsets, data))):
                    held[kind].extend(_slice_counts(keys, np.repeat(use, np.diff(first))))
                pending += 1
            if pending > 8:
                held, pending = tuple([_counted([k for k, _ in h], [c for _, c in h])] for h in held), 0
        chunk = key[0].as_py()
        out = []
        for kind, h in enumerate(held):
            keys, counts = _counted([k for k, _ in h], [c for _, c in h])
            bucket = _bucket_of(kind, keys)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])[: len(order)])
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                part = order[a:b]
                mine = int(bucket[part[0]])
                out.append((chunk, mine, chunk // group, _packed(mine, keys[part]), counts[part].astype("<u4").tobytes()))
        yield _batch(out, ("chunk", "bucket", "salt", "keys", "counts"))

    return collect


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"keys": pa.binary(), "counts": pa.binary(), "values": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names=list(names))


def _adder(kind: str):
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _add(key, batches, kind)

    return add


def _add(key, batches, kind: str):
    """Training counts of one bucket added up; strings that no training text holds go."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = key[0].as_py()
    for batch in batches:
        parts = [(_keys(bucket, k), np.frombuffer(c, kind).astype(np.int64)) for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist())]
        parts = [(k[c > 0], c[c > 0]) for k, c in parts]
        keys, counts = _counted([keys, *(k for k, _ in parts)], [counts, *(c for _, c in parts)])
    yield _batch([(bucket, _packed(bucket, keys), counts.astype("<i8").tobytes())], ("bucket", "keys", "counts"))


def _summary(batches):
    """Of each bucket: dishes (256 flags) of contexts; distinct and all tokens of words."""
    for batch in batches:
        rows = []
        for bucket, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "counts"))):
            dishes = np.zeros(SYMBOLS, bool)
            if bucket >= 0:
                dishes[_keys(bucket, keys) & 255] = True
            rows.append((bucket, len(counts) // 8, int(np.frombuffer(counts, "<i8").sum()), np.packbits(dishes).tobytes()))
        yield _batch(rows, ("bucket", "distinct", "total", "keys"))


def _top_levels(summary: list[dict]) -> np.ndarray:
    """Averaged probabilities of a byte after each byte (256 x 256)."""
    seen = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for row in summary:
        if row["bucket"] >= 0:
            seen[row["bucket"] & 255] += np.unpackbits(np.frombuffer(row["keys"], np.uint8)).astype(np.int64)
    pairs = np.flatnonzero(seen.ravel())
    uniform = np.full(SYMBOLS, 1 / SYMBOLS)
    every = np.arange(SYMBOLS * SYMBOLS)
    return Restaurants(pairs, seen.ravel()[pairs], 1, 0, uniform, 1).averaged(every).reshape(SYMBOLS, SYMBOLS)


def _valued(top: np.ndarray):
    """Log probabilities of the chunks' strings, counts of their words."""

    def value(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if not left.num_rows:  # none of these chunks has the bucket
            return pa.Table.from_batches([_batch([], ("chunk", "bucket", "keys", "values"))])
        known = _keys(bucket, right.column("keys")[0].as_py()) if right.num_rows else np.zeros(0, np.int64)
        counts = np.frombuffer(right.column("counts")[0].as_py(), "<i8") if right.num_rows else known
        chunks, raw = left.column("chunk").to_pylist(), left.column("keys").to_pylist()
        wanted = [_keys(bucket, r) for r in raw]
        if bucket >= 0:
            every, back = np.unique(np.concatenate(wanted), return_inverse=True)
            below = Restaurants(known, counts, DEPTH, 2, top[bucket & 255], bucket)
            values = np.log10(below.averaged(every))[back]
        else:
            at = _found(known, np.concatenate(wanted))
            values = np.where(at >= 0, counts[at] if len(counts) else 0, 0).astype(float)
        cuts = np.cumsum([0, *map(len, wanted)])
        rows = [(c, bucket, r, values[a:b].astype(_value_kind(bucket)).tobytes()) for c, r, a, b in zip(chunks, raw, cuts[:-1], cuts[1:])]
        return pa.Table.from_batches([_batch(rows, ("chunk", "bucket", "keys", "values"))])

    return value


def _scored(id_type: pa.DataType, total: int, distinct: int):
    names = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        known = [_lookup(right, kind) for kind in (0, 1)]
        texts, parts = left.column("text").combine_chunks(), []
        for _, offsets, data in text_slices(texts):
            keys, first = strings(offsets, data)
            model = _sums(known[0].of(keys), first)
            tokens, first = token_hashes(offsets, data)
            counts = known[1].of(tokens)
            base = _sums(np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1))), first)
            parts.append((np.diff(first), _sums(counts > 0, first).astype(np.int64), base, model))
        n_tokens, n_known, base, model = (np.concatenate(x) for x in zip(*parts))
        held = pa.array(~np.asarray(left.column("train").combine_chunks().to_numpy(zero_copy_only=False), bool))
        columns = [left.column("id").combine_chunks().cast(id_type), held, pa.array(n_tokens, pa.int64()), pa.array(n_known), pa.array(np.full(len(held), total)), pa.array(base), pa.array(model)]
        return pa.Table.from_arrays(columns, names=list(names))

    return score


def _lookup(table: pa.Table, kind: int) -> Lookup:
    rows = [(_keys(b, k), np.frombuffer(v, _value_kind(b)).astype(float)) for b, k, v in zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "values"))) if (b < 0) == bool(kind)]
    return Lookup(np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows]))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    running = np.concatenate(([0.0], np.cumsum(values)))
    return running[first[1:]] - running[first[:-1]]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, group: int = GROUP) -> DataFrame:
    """Score every row; ``held_out`` (never NULL) tells which rows the model does not learn from.

    Columns: the id, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training holds),
    ``train_tokens``, ``base_score`` (add-half unigrams) and ``score`` (this model), as log10.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    deal = F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks))  # copies of a text are few rows of a chunk unless ids repeat too
    rows = docs.select(F.col(id_col).alias("id"), (~held_out).alias("train"), text.alias("text"), deal.alias("chunk"))
    chunk_rows = staged(rows.groupBy("chunk").applyInArrow(_chunk_rows(group), "chunk long, bucket long, salt long, keys binary, counts binary"), "chunk_strings")
    counts = "bucket long, keys binary, counts binary"
    parts = chunk_rows.groupBy("bucket", "salt").applyInArrow(_adder("<u4"), counts)
    summed = parts.groupBy("bucket").applyInArrow(_adder("<i8"), counts)
    summed = staged(summed, "counts")
    summary = summed.mapInArrow(_summary, "bucket long, distinct long, total long, keys binary").toArrow().to_pylist()
    tokens = [r for r in summary if r["bucket"] < 0]
    top = _top_levels(summary)
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((chunks - 1) // group).cast("long")))
    spread = summed.select("bucket", salts.alias("salt"), "keys", "counts")
    valued = chunk_rows.select("bucket", "salt", "chunk", "keys").groupBy("bucket", "salt").cogroup(spread.groupBy("bucket", "salt"))
    valued = staged(valued.applyInArrow(_valued(top), "chunk long, bucket long, keys binary, values binary"), "values")
    forget(chunk_rows)
    forget(summed)
    id_field = docs.schema[id_col]
    fields = [T.StructField("id", id_field.dataType), T.StructField("held_out", T.BooleanType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    scored = _scored(to_arrow_type(id_field.dataType), sum(r["total"] for r in tokens), sum(r["distinct"] for r in tokens))
    return rows.groupBy("chunk").cogroup(valued.groupBy("chunk")).applyInArrow(scored, T.StructType(fields)).withColumnRenamed("id", id_col)
