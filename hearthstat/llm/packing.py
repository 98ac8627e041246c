"""Best-fit packing of token sequences (configuration linear program).

A configuration is a multiset of lengths that fits one sequence.  The linear program asks
for the fewest configurations that cover the histogram of lengths.  It has at most
``capacity`` rows, whatever the corpus, so the driver solves it: multiplicative weights move
dual prices towards lengths covered too little, and a knapsack dynamic program finds the
configuration worth most at these prices.  The fractional solution is rounded down to what
the histogram holds; what is left is packed best-fit decreasing, again on the histogram.

Pieces never meet the driver.  Each gets a rank among the pieces of its length: its number
within the task that wrote it, plus how many came in earlier tasks.  The rank picks its place
in the solution, a table of at most some thousand slots.  No window or group spans a length,
so one length may hold any share of the pieces.

Defined results: NULL text is the empty text; the empty text is one piece of the end id;
repeated rows are packed each for itself; ids and other columns pass through unread, NULL
included; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .encode import encoder
from .staging import staged

CAPACITY = 1024
END_ID = 2
ROUNDS = 400  # of the multiplicative weights
RATE = 1.0


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
    with_crc32: bool = False,
) -> DataFrame:
    """Ids of each text and ``end_id``, cut into pieces of ``capacity`` of which the first may be shorter.

    Columns: the id, ``piece``, ``start``, ``length``, and as asked ``ids`` and ``ids_crc32``
    (of the little-endian unsigned 32-bit ids).
    """
    fields = [docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if with_crc32:
        fields.append(T.StructField("ids_crc32", T.LongType()))

    def cut(batches):
        for batch in batches:
            for row, _, _, ids, first in encoder(vocabulary).slices(batch.column(1)):
                counts = np.diff(first) + 1
                n = len(counts)
                ended = np.insert(ids, first[1:], end_id).astype(np.int32)
                begins = first[:-1] + np.arange(n)
                pieces = -(-counts // capacity)
                short = counts - (pieces - 1) * capacity
                owner = np.repeat(np.arange(n), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.where(number == 0, 0, short[owner] + (number - 1) * capacity)
                length = np.where(number == 0, short[owner], capacity)
                cuts = np.append(begins[owner] + start, len(ended))
                columns = [batch.column(0).take(pa.array(owner + row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ended)))
                if with_crc32:
                    raw = memoryview(ended.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    columns.append(pa.array(sums, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give every row of ``pieces`` (column ``length``, 1 to ``capacity``) a sequence and a place in it.

    Adds ``sequence_id`` and ``offset``; within a sequence offsets have no gap from 0.
    """
    numbered = staged(_numbered(pieces), "pieces")
    counts = numbered.groupBy("_task", F.col("length").alias("_length")).agg(F.count("*").alias("_n"))
    counts = staged(counts, "piece_counts")
    by_length = counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()  # capacity rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        if r["_length"] is None or not 1 <= r["_length"] <= capacity:
            raise ValueError(f"a piece of length {r['_length']}; 1 to {capacity} fit")
        histogram[r["_length"]] = r["n"]
    slots = Slots.of(solve(histogram, capacity, rounds))
    earlier = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_task").alias("_t"), "_length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Tasks times lengths grow with the corpus: never broadcast, however small the file looks.
    ranked = numbered.join(before.hint("merge"), (numbered["_task"] == before["_t"]) & (numbered["length"] == before["_length"]))
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_local")).alias("_rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = slots.place(length, rank)
            columns = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(place, schema)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Each row's task and its number among the task's rows of the same length."""
    extra = [T.StructField("_task", T.LongType()), T.StructField("_local", T.LongType())]
    schema = T.StructType([*pieces.schema.fields, *extra])
    at = pieces.columns.index("length")

    def number(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy()
            if len(length) and length.max() >= len(seen):
                seen = np.concatenate((seen, np.zeros(length.max() + 1 - len(seen), np.int64)))
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            local = np.empty(len(length), np.int64)
            local[order] = seen[ordered] + np.arange(len(length)) - first
            seen[: len(seen)] += np.bincount(length, minlength=len(seen))
            columns = [*batch.columns, pa.array(np.full(len(length), task), pa.int64()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pieces.mapInArrow(number, schema)


def solve(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) that together hold the histogram exactly."""
    left, chosen = histogram.copy(), []
    for share, copies in fractional(histogram, capacity, rounds):
        times = min(int(share), *(left[l] // k for l, k in copies.items()))
        if times > 0:
            for l, k in copies.items():
                left[l] -= times * k
            chosen.append((int(times), copies))
    return chosen + best_fit(left, capacity)


def fractional(histogram: np.ndarray, capacity: int, rounds: int) -> list[tuple[float, dict[int, int]]]:
    """Configurations and their shares from multiplicative weights, largest share first."""
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return []
    need = histogram[lengths].astype(float)
    volume = float(lengths @ need) / capacity
    covered, used = np.zeros(len(lengths)), 0.0
    shares: dict[tuple, float] = {}
    for _ in range(rounds):
        # By volume alone a length's price is proportional to it; cover so far bends that.
        behind = used / volume - covered / need
        price = np.where(covered < need, lengths * np.exp(RATE * behind), 0)
        copies = knapsack(lengths, price, capacity)
        taken = copies > 0
        if not taken.any():
            break
        step = (np.minimum(need / 2, need - covered)[taken] / copies[taken]).min()
        config = tuple(zip(lengths[taken].tolist(), copies[taken].tolist()))
        shares[config] = shares.get(config, 0) + step
        covered += step * copies
        used += step
    return [(x, dict(c)) for c, x in sorted(shares.items(), key=lambda item: (-item[1], item[0]))]


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length of the most valuable multiset of at most ``capacity``."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if upto[c]:
            totals = value[c - lengths[: upto[c]]] + price[: upto[c]]
            best = int(totals.argmax())
            if totals[best] > value[c]:
                value[c], choice[c] = totals[best], best
    copies, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            copies[choice[c]] += 1
            c -= lengths[choice[c]]
    return copies


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over equal sequences at once: (times, {length: copies})."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def put(room: int, times: int, held: dict[int, int]) -> None:
        if times:
            open_.setdefault(room, []).append((times, held))

    for length in np.flatnonzero(histogram)[::-1].tolist():
        n = int(histogram[length])
        rooms = iter(sorted(r for r in open_ if r >= length))
        while n:
            room = next(rooms, None)
            groups = open_.pop(room) if room is not None else [(-(-n // (capacity // length)), {})]
            fits = (capacity if room is None else room) // length
            room = capacity if room is None else room
            for times, held in groups:
                full = min(times, n // fits)
                rest = min(n - full * fits, fits - 1) if full < times else 0
                n -= full * fits + rest
                put(room - fits * length, full, held | {length: fits})
                if rest:
                    put(room - rest * length, 1, held | {length: rest})
                put(room, times - full - bool(rest), held)
    return [(times, held) for groups in open_.values() for times, held in groups if held]


@dataclass
class Slots:
    """Where the pieces of each length go, by their rank; sorted by (length, first rank)."""

    key: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, solution: list[tuple[int, dict[int, int]]]) -> "Slots":
        rows, sequence, ranks = [], 0, {}
        for times, copies in solution:
            offset = 0
            for length, k in copies.items():
                for _ in range(k):
                    rank = ranks.get(length, 0)
                    rows.append(((length << 44) + rank, times, sequence, offset))
                    ranks[length] = rank + times
                    offset += length
            sequence += times
        rows.sort()
        return cls(*(np.array([r[i] for r in rows], np.int64) for i in range(4)))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        at = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[at] + key - self.key[at], self.offset[at]
