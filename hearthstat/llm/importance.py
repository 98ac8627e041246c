"""Importance resampling towards a target text, by hashed n-grams from prefix CRCs.

Features are runs of 1 to ``max_words`` words of the separator-normalised text (A-Z folded, one
space between words); a feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  Each
document is scanned once: a slice of texts is laid out in lanes, all lanes step through their
bytes together by the CRC's table, and the register after every byte is kept.  CRC is linear
over GF(2), so the CRC of any run of words follows from two registers: the one before the run,
shifted by the run's length (a multiplication by x**(8 n) modulo the polynomial, done bit by
bit of n with tables), cancels what came before.  Runs of many words cost no more than words.

Counts by bucket are added up in each task before the shuffle, at most ``buckets`` rows a task.
A bucket's gain is a logarithm of smoothed shares, target over corpus, in whole thousandths;
a document's weight is the floored mean of its features' gains, and its score adds Gumbel
noise from a hash of its id, which makes the highest scores a draw without replacement.  The
``buckets`` gains are the only thing the driver hands out.  Ranks come from counts by score
(scores are whole numbers of a bounded range) and from places in range partitions, so no task
sees all documents, nor all documents of one score.

Defined results: NULL text is a text without words; no words means no features, weight 0 and
no draw; repeated rows are documents of their own, with equal scores and ranks in any order;
a NULL id is noised as the empty id and comes after other ids of its score; an empty target or
corpus leaves all gains to smoothing; other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hearthstat.operators.numbering import with_position

from .arrays import text_slices
from .staging import staged, workspace

BUCKETS = 10_000
SEED = 2024
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
LANES = 64, 1024  # fewest and most bytes of a lane
# Word bytes: digits, letters, and all bytes of code points from 128 on.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _step_bits(value: np.ndarray) -> np.ndarray:
    """``value`` times x modulo the polynomial."""
    return np.where(value & 1, value >> np.uint32(1) ^ np.uint32(POLYNOMIAL), value >> np.uint32(1))


@functools.cache
def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = _step_bits(table)
    return table


@functools.cache
def _shift_tables(power: int) -> np.ndarray:
    """Four tables of 256: a register times x**(8 * 2**power), by each of its bytes."""
    if power == 0:
        lows = np.arange(256, dtype=np.uint32)
        values = [lows << np.uint32(8 * i) for i in range(4)]
        return np.stack([v >> np.uint32(8) ^ _byte_table()[v & np.uint32(255)] for v in values])
    half = _shift_tables(power - 1)
    return np.stack([_through(half, row) for row in half])


def _through(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    out = tables[0][registers & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ tables[i][registers >> np.uint32(8 * i) & np.uint32(255)]
    return out


def shifted(registers: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Each register after ``n_bytes`` zero bytes."""
    out, left, power = registers.astype(np.uint32), n_bytes.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _through(_shift_tables(power), out[odd])
        left >>= 1
        power += 1
    return out


def running_crcs(data: np.ndarray) -> np.ndarray:
    """The register, from zero, before the first byte and after each one."""
    n = len(data)
    lane = min(max(math.isqrt(n), LANES[0]), LANES[1])
    lanes = -(-n // lane)
    laid = np.zeros((lanes, lane), np.uint8)
    laid.reshape(-1)[:n] = data
    by_step = np.ascontiguousarray(laid.T)
    out = np.zeros((lane, lanes), np.uint32)
    register, table = np.zeros(lanes, np.uint32), _byte_table()
    for i in range(lane):
        register = table[(register ^ by_step[i]) & np.uint32(255)] ^ register >> np.uint32(8)
        out[i] = register
    local = out.T.reshape(-1)[:n]
    # What lanes before add: the register at a lane's start, by doubling the reach of each lane.
    carried, reach = register.copy(), 1
    length = np.full(lanes, lane, np.int64)
    while reach < lanes:
        add = shifted(carried[:-reach], length[reach:])
        carried[reach:] ^= add
        length[reach:] = length[reach:] + length[:-reach]
        reach *= 2
    start = np.concatenate((np.zeros(1, np.uint32), carried[:-1])) if lanes else carried
    whole = np.zeros(n + 1, np.uint32)
    if lanes > 1:
        # One zero byte after another carries all lane starts along together.
        moved, at = start.copy(), np.empty((lane, lanes), np.uint32)
        for i in range(lane):
            moved = table[moved & np.uint32(255)] ^ moved >> np.uint32(8)
            at[i] = moved
        local = local ^ at.T.reshape(-1)[:n]
    whole[1:] = local
    return whole


def span_crcs(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span, from the registers before and after it."""
    n = ends - starts
    ones = np.full(len(n), 0xFFFFFFFF, np.uint32)
    # The standard preset behaves like ones before the span: both are shifted at once.
    return running[ends] ^ shifted(running[starts] ^ ones, n) ^ ones


def normalised(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words with one space between them, their starts and ends, and each row's first word."""
    folded = _FOLD[data]
    inside = _INSIDE[folded]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:n].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    begins = inside & before
    kept = inside.copy()
    kept[1:] |= ~inside[1:] & inside[:-1]  # one separator after a word
    place = np.cumsum(kept) - kept
    starts, ends = np.flatnonzero(begins), np.flatnonzero(inside & after)
    text = np.where(inside, folded, np.uint8(32))[kept]
    return text, place[starts], place[ends] + 1, np.searchsorted(starts, offsets)


def features(offsets: np.ndarray, data: np.ndarray, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row each belongs to, and each row's number of words."""
    text, starts, ends, first = normalised(offsets, data)
    running = running_crcs(text)
    words = np.diff(first)
    owner = np.repeat(np.arange(len(words)), words)
    found, rows = [], []
    for k in range(1, max_words + 1):
        at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :])
        found.append(span_crcs(running, starts[at], ends[at + k - 1]) % np.uint32(buckets))
        rows.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features of all texts."""

    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, offsets, data in text_slices(batch.column(0)):
                held += np.bincount(features(offsets, data, max_words, buckets)[0], minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    counts = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log of each bucket's smoothed share in the target over that in the corpus."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, corpus), (t, target)):
        for r in counts.collect():  # at most ``buckets`` rows, whatever the corpus
            held[r.bucket] = r.n
    up, down = (t + 1.0) * (s.sum() + buckets), (s + 1.0) * (t.sum() + buckets)
    return [math.floor(1000.0 * math.log(a / b)) for a, b in zip(up.tolist(), down.tolist())]


def weights(docs: DataFrame, by_bucket: list[int], id_col: str = "doc_id", text_col: str = "text", max_words: int = 1) -> DataFrame:
    """``id_col, n_words, n_features, weight`` of every document."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    names, n_buckets = schema.names, len(by_bucket)

    def weigh(batches):
        gain = np.array(by_bucket, np.int64)
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                found, rows, words = features(offsets, data, max_words, n_buckets)
                n = len(words)
                sums = np.zeros(n, np.int64)
                np.add.at(sums, rows, gain[found])
                counts = np.bincount(rows, minlength=n)
                weight = sums // np.maximum(counts, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), *(pa.array(x, pa.int64()) for x in (words, counts, weight))], names=names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(weigh, schema)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Whole thousandths of standard Gumbel noise from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    max_words: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's ``id_col, n_words, n_features, weight, score, rank``; ``rank`` is NULL for documents not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_bucket = gains(bucket_counts(rows, "text", max_words, buckets), bucket_counts(target, target_col, max_words, buckets), buckets)
    weighed = weights(rows, by_bucket, "id", "text", max_words)
    scored = staged(weighed.withColumn("score", F.col("weight") + noise("id", seed)), "scores")
    enough = F.col("n_words") >= min_words
    # A gain is within 1000 times the log of a count, the noise within -3200 and 22900, so this
    # table has some hundred thousand rows at most, whatever the corpus.
    by_score = [(r.score, r.n) for r in scored.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()]
    draw = percent * sum(n for _, n in by_score) // 100
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select("*", none).withColumnRenamed("id", id_col)
    least, above = 0, 0
    for score, n in sorted(by_score, reverse=True):
        least, above = score, above + n
        if above >= draw:
            break
    high = F.coalesce(enough & (F.col("score") >= least), F.lit(False))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranked = with_position(scored.filter(high), order, workspace(scored.sparkSession), "place")
    drawn = ranked.select(*scored.columns, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return scored.filter(~high).select("*", none).unionByName(drawn).withColumnRenamed("id", id_col)
