"""Removal of long byte strings that occur twice or more, by external suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the
same text or another, is removed; strings are judged on the input.

Suffix-sorting a whole corpus in one piece is what no task could do, so it is divided without
losing a match:

1. From every window of ``length`` bytes one anchor is taken, the ``GRAM``-byte string with
   the least hash.  The choice depends on the window alone, so equal windows have equal
   anchors, and only surroundings of anchors that occur twice can hold a repeat.
2. Occurrences are counted by (anchor, surroundings).  Equal surroundings are repeats as a
   whole and are represented by one of them from here on: a group of copies of any size is
   counted in the shuffle, never gathered.
3. An anchor whose surroundings differ joins them to the left and to the right: a repeat
   reaches at least half of the rest of its length to one side of the anchor, so equal halves
   on that side bring the two together.  This deals the surroundings of a frequent passage
   out over many groups; groups of one are done.
4. Groups are dealt out to shards, and each shard's text is suffix-sorted: in memory by the first
   bytes, then by two or three times as many from the ranks of their parts, up to ``length``
   bytes; suffixes that nothing else begins like leave at once.  A shard that turns out larger
   than ``IN_MEMORY`` bytes is sorted with common prefixes on disk (induced.py).  Neighbours
   with ``length`` bytes in common are repeats.
5. Spans are joined back to their texts and cut out.

Strings are compared by 64-bit hashes in 1-3 and as sorted suffixes in 4.

Defined results: NULL is the empty text; texts shorter than ``length`` keep all bytes;
repeated rows are copies of each other; NULL ids are ids like any other; an empty table gives
no rows; other columns pass unread.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import _INVERSE, flat, mixed, powers, prefix_sums, span_hashes, text_slices
from .induced import suffixes
from .staging import forget, staged

LENGTH, GRAM = 400, 160
SHARD_BYTES = 4 << 20
IN_MEMORY = 2 * SHARD_BYTES  # shards are of that size on average
_CHUNK = 1 << 23  # windows handled at once in a very long text
_POSITION = (1 << 24) - 1
ANCHOR_COLUMNS = ("anchor", "around", "left", "right", "uid", "pos", "a", "b")


def anchors(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and rows of the anchors of all windows of ``length`` bytes; sums over prefixes."""
    sums = prefix_sums(data, False)
    windows = np.zeros(len(data) + 1, np.int8)
    long = np.diff(offsets) >= length
    np.add.at(windows, offsets[:-1][long], 1)
    np.add.at(windows, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(windows[:-1], dtype=np.int8))
    out, width = [], length - gram + 1
    for low in range(0, len(data), _CHUNK):
        mine = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + _CHUNK)]
        if not len(mine):
            continue
        stop = min(low + _CHUNK + width, len(data) - gram + 1)
        keys = mixed((sums[low + gram : stop + gram] - sums[low:stop]) * powers(_INVERSE, stop)[low:])
        # The later of equal hashes wins; the position is kept in the low bits.
        keys = (keys & np.uint64(~_POSITION & (2**64 - 1))) | (np.uint64(_POSITION) - np.arange(stop - low, dtype=np.uint64))
        least = _sliding_least(keys, width)[mine - low]
        chosen = least[np.append(True, least[1:] != least[:-1])]
        out.append(low + _POSITION - (chosen & np.uint64(_POSITION)).astype(np.int64))
    at = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return at, np.searchsorted(offsets, at, "right") - 1, sums


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys (fewer at the end)."""
    rows = -(-len(keys) // width) + 1
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(keys)], ahead[width - 1 : width - 1 + len(keys)])


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Each anchor with hashes of itself, its surroundings and their halves, and where it lies."""
    half = (length - gram) // 2

    def find(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for row, offsets, data in text_slices(batch.column(1)):
                at, owner, sums = anchors(offsets, data, length, gram)
                begin, end = offsets[owner], offsets[owner + 1]
                a, b = np.maximum(begin, at - (length - gram)), np.minimum(end, at + length)
                where = mixed((at - a).astype(np.uint64) * np.uint64(_POSITION) + (b - at).astype(np.uint64))
                left, right = np.maximum(begin, at - half), np.minimum(end, at + gram + half)
                hashes = [
                    span_hashes(sums, at, at + gram),
                    mixed(span_hashes(sums, a, b) + where),
                    np.where(at - begin >= half, span_hashes(sums, left, at + gram), 0),
                    np.where(end - at - gram >= half, span_hashes(sums, at, right), 0),
                ]
                columns = [pa.array(np.asarray(h, np.uint64).view(np.int64)) for h in hashes]
                columns += [pa.array(uid[row + owner]), *(pa.array(x - begin, pa.int32()) for x in (at, a, b))]
                yield pa.RecordBatch.from_arrays(columns, names=list(ANCHOR_COLUMNS))

    kinds = ("long", "long", "long", "long", "long", "int", "int", "int")
    return rows.select("uid", "text").mapInArrow(find, ", ".join(f"{c} {k}" for c, k in zip(ANCHOR_COLUMNS, kinds)))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, sift: bool = False) -> DataFrame:
    """Spans (uid, a, b) of repeated strings in ``rows`` (uid, text); spans may overlap.

    ``sift`` finds the repeated anchors first and writes only these: a second pass over the texts
    for less disk, where short strings make many anchors.
    """
    found = _anchor_rows(rows, length, gram)
    if sift:
        several = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
        found = found.join(staged(several, "several"), "anchor", "left_semi")
    found = staged(found, "anchors")
    key = F.xxhash64("uid", "pos")
    one = lambda c: F.min_by(c, "_k").alias(c)
    kinds = found.withColumn("_k", key).groupBy("anchor", "around").agg(F.count("*").alias("n"), *(one(c) for c in ANCHOR_COLUMNS[2:]))
    kinds = staged(kinds, "surroundings")
    whole = staged(found.join(kinds.filter("n > 1").select("anchor", "around"), ["anchor", "around"]).select("uid", "a", "b").distinct(), "whole")
    forget(found)
    differing = kinds.groupBy("anchor").agg(F.count("*").alias("_kinds")).filter("_kinds > 1").select("anchor")
    # A repeat reaches half of what the anchor leaves to its left or to its right.
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("half")) for i, c in enumerate(("left", "right"))))
    sided = kinds.join(differing, "anchor").select("anchor", F.explode(sides).alias("_s"), "uid", "a", "b").filter("_s.half <> 0")
    sided = sided.select(F.xxhash64("anchor", "_s.side", "_s.half").alias("group"), "uid", "a", "b")
    several = sided.groupBy("group").agg(F.count("*").alias("_n")).filter("_n > 1").select("group")
    chosen = staged(sided.join(several, "group"), "chosen")
    forget(kinds)
    size = chosen.agg(F.sum(F.col("b") - F.col("a"))).first()[0] or 0
    if not size:
        return whole
    shards = max(1, -(-size // shard_bytes))
    parts = chosen.select("uid", F.struct(F.pmod("group", F.lit(shards)).alias("shard"), "a", "b").alias("_p")).distinct()
    parts = parts.groupBy("uid").agg(F.collect_list("_p").alias("parts"))  # at most a text's own anchors
    # Repeated rows go where the join has put them anyway.
    texts = rows.join(parts, "uid").dropDuplicates(["uid"]).select("uid", "text", "parts")
    segments = texts.mapInArrow(_segments, "shard long, uid long, start int, bytes binary")
    sorted_ = segments.groupBy("shard").applyInArrow(_sorted_shard(length), "uid long, a int, b int")
    return whole.union(staged(sorted_, "repeats"))


def _segments(batches):
    """The parts of each text by shard, overlapping ones joined."""
    for batch in batches:
        texts, uids = flat(batch.column(1)), batch.column(0).to_pylist()
        shards, owners, starts, pieces = [], [], [], []
        for i, parts in enumerate(batch.column(2)):
            raw = (texts[i].as_py() or "").encode()
            spans = sorted((p["shard"], p["a"], p["b"]) for p in parts.as_py())
            joined = []
            for shard, a, b in spans:
                if joined and joined[-1][0] == shard and a <= joined[-1][2]:
                    joined[-1][2] = max(joined[-1][2], b)
                else:
                    joined.append([shard, a, b])
            for shard, a, b in joined:
                shards.append(shard)
                owners.append(uids[i])
                starts.append(a)
                pieces.append(raw[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(owners, pa.int64()), pa.array(starts, pa.int32()), pa.array(pieces, pa.binary())], names=["shard", "uid", "start", "bytes"])


def _sorted_shard(length: int):
    def sort(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            uids, starts, sizes = [], [], []
            for batch in batches:
                uids.append(batch.column("uid").to_numpy())
                starts.append(batch.column("start").to_numpy())
                pieces = batch.column("bytes").to_pylist()
                sizes.append(np.array([len(p) for p in pieces], np.int64))
                for piece in pieces:
                    file.write(piece + b"\0")
            file.flush()
            uid, start, size = map(np.concatenate, (uids, starts, sizes))
            text = np.memmap(file, np.uint8, "r")
            begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
            a, b = repeats(text, begin, begin + size, length)
        owner = np.searchsorted(begin, a, "right") - 1
        shift = start[owner] - begin[owner]
        yield pa.RecordBatch.from_arrays([pa.array(uid[owner]), pa.array(a + shift, pa.int32()), pa.array(b + shift, pa.int32())], names=["uid", "a", "b"])

    return sort


def repeats(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``text`` covered by strings of ``length`` that start twice; none leaves its segment [begin, end)."""
    found = _starts_in_memory if len(text) <= IN_MEMORY else _starts_on_disk
    starts = found(text, begin, end, length)
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length


def _fitting(n: int, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes from each of ``n`` places on lie in one segment."""
    fits = np.zeros(n + 1, np.int32)
    long = end - begin >= length
    np.add.at(fits, begin[long], 1)
    np.add.at(fits, end[long] - length + 1, -1)
    return np.cumsum(fits[:-1]) > 0


def _starts_in_memory(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Places of strings of ``length`` that start twice, by ranks of ever longer prefixes of the suffixes."""
    depth = min(8, length)
    at = np.flatnonzero(_fitting(len(text), begin, end, depth))
    key = np.zeros(len(at), np.uint64)
    for i in range(depth):
        key <<= np.uint64(8)
        key |= text[at + i]
    # 0 where the prefix occurs once or leaves its segment, and so does every longer one.
    rank = np.zeros(len(text) + length, np.uint32)
    groups = _ranked(rank, at, key)
    while depth < length and groups:
        parts = 3 if groups < 1 << 21 else 2
        step = min(depth, -(-(length - depth) // (parts - 1)))
        further = [min(p * step, length - depth) for p in range(1, parts)]
        at = np.flatnonzero(rank)
        for shift in further:
            at = at[rank[at + shift] > 0]
        key = rank[at].astype(np.uint64)
        for shift in further:
            key <<= np.uint64(64 // parts)
            key |= rank[at + shift]
        depth += further[-1]
        groups = _ranked(rank, at, key)
    return np.flatnonzero(rank)


def _ranked(rank: np.ndarray, at: np.ndarray, key: np.ndarray) -> int:
    """Number the keys that occur twice or more from 1, in their order, at ``at`` in ``rank``; how many there are."""
    rank[:] = 0
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    several = np.flatnonzero(same[1:] | same[:-1])
    number = np.cumsum(~same[several], dtype=np.uint32)
    rank[at[order[several]]] = number
    return int(number[-1]) if len(number) else 0


def _starts_on_disk(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Places of strings of ``length`` that start twice, by sorted suffixes and their common prefixes."""
    fits = _fitting(len(text), begin, end, length)
    marked = np.zeros(len(text), bool)
    last, least = -1, 0
    for _, position, common in suffixes(text, length):
        at = np.flatnonzero(fits[position])
        if not len(at):
            least = min(least, int(common.min()))
            continue
        value = np.empty(len(at), np.int64)
        value[0] = min(least, int(common[: at[0] + 1].min()))
        if len(at) > 1:
            cuts = np.column_stack((at[:-1] + 1, at[1:] + 1)).ravel()
            cuts = cuts[:-1] if cuts[-1] >= len(common) else cuts
            value[1:] = np.minimum.reduceat(common, cuts)[::2]
        twice = np.flatnonzero(value >= length)
        here = position[at]
        marked[here[twice]] = True
        before = np.concatenate(([last], here[:-1]))[twice]
        marked[before[before >= 0]] = True
        last = int(here[-1])
        least = int(common[at[-1] + 1 :].min()) if at[-1] + 1 < len(common) else length
    return np.flatnonzero(marked)


def joined_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


CUT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string,kept:string>"


def cut(column: pa.Array, spans: pa.Array, over_words: int = -1, any_words: int = LENGTH) -> pa.Array:
    """Counts, digest of the remaining bytes, and these as text without characters cut in two.

    Joined spans of fewer than ``any_words`` bytes stay unless they touch more than ``over_words`` words.
    """
    texts, out = flat(column), []
    for text, found in zip(texts, spans):
        raw = (text.as_py() or "").encode()
        gone = [(a, b) for a, b in joined_spans(found.as_py()) if b - a >= any_words or len(raw[a:b].split()) > over_words]
        left, at = [], 0
        for a, b in gone:
            left.append(raw[at:a])
            at = b
        kept = b"".join([*left, raw[at:]])
        whole = text.as_py() if not gone else kept.decode("utf-8", "ignore")
        out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), whole))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], list(names))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", over_words: int = -1, **options) -> DataFrame:
    """``docs`` with one more column ``_dedup``: the struct of ``cut`` for each row; ``over_words`` is as there.

    Columns of ``docs`` may have any names but ``_dedup``.
    """
    text = F.col(text_col)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(id_col, text_col).alias("uid"), text.alias("text"))
    rows = keyed.select("uid", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows, **options).distinct()
    spans = spans.groupBy(F.col("uid").alias("owner")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(spans, keyed["uid"] == spans["owner"], "left")

    def removed(column: pa.Array, spans: pa.Array) -> pa.Array:
        return cut(column, spans, over_words)

    return joined.select("row.*", F.arrow_udf(removed, CUT)("text", "spans").alias("_dedup"))
