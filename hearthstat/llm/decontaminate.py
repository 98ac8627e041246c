"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, exact check.

Texts and items are compared in a plain form: A-Z lower-cased, each run of white space and
ASCII punctuation one space.  A text holds an item when some stretch of it is within
``ERRORS`` (a fifth) of the item's length in edits, counted on bytes of the plain form.

1. Windows begin at every word of a text and at every character of three bytes or more.  The
   CGK walk embeds a window: at each step it writes the current byte, and moves on or stays by a
   random bit of step and byte.  Few edits become few differing places, two texts that have
   nothing in common agree in about ``CHANCE`` of them.  ``WALKS`` walks of ``STEPS`` steps read
   about ``STEPS / 2`` bytes.  Items have such windows at every word too, so that an item is
   found by any of its parts, also if its beginning is edited, missing or run into other text.
2. A sample is a few places of all walks.  A window of a text and one of an item that agree in all
   places of a sample are candidates.  The number of places grows with the logarithm of the
   windows of items, so that chance agreements stay rare, and the number of samples follows: a
   window whose embedding agrees in half of the places is found with ``ENTRY_RECALL``.  An item with
   few windows, which share its edits, is in more samples: ``EXPECTED`` of them agree with its
   only window, and with each of ``n`` windows fewer by ``n**1.5``.
3. Candidates go on if they agree in ``HAMMING`` of ``CHECKED`` places, and then if a walk over the
   whole item, to its end and to its beginning, agrees with the text in ``WHOLE`` of its places.
   A fifth of edits leaves 0.4 and more.

Recall of 1 to 3 together, on items that are within the limit after random edits byte by byte or
in one place: above 0.95 at 5, 10, 15 and 18 percent (tested; README has the figures).  No text is
left out before step 2.

4. Candidates are verified with the exact edit distance of item and stretch.

Items come in blocks of at most ``ITEMS`` to every task; each block is a pass over the texts.

Defined results: NULL and empty texts hold no item; items that are NULL or have no letter or
digit match nothing; items of fewer than ``SHORT`` bytes match only whole and unchanged, at
word limits; an item that occurs in several rows counts under each id; repeated rows of texts
are judged each for itself; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrays import prefix_sums, span_hashes, text_slices

ERRORS, SHORT = 0.2, 30
WALKS, STEPS = 4, 64
CHANCE, AGREE, ENTRY_RECALL, EXPECTED = 0.12, 0.5, 0.12, 4.0
CHECKED, HAMMING, WHOLE = 96, 0.4, 0.33
BLOCK, PAIRS = 1 << 15, 1 << 17
ITEMS = 5000
SLICE = 4 << 20


def _plain_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for b in range(128):
        if not (chr(b).isalnum()):
            table[b] = 32
    return table


_PLAIN = _plain_table()


def plain(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes in plain form; every row begins and ends with one space."""
    n = len(offsets) - 1
    where = np.repeat(offsets, 2)[1:-1]
    full = np.insert(_PLAIN[data], where, 32) if n else data
    offsets = offsets + 2 * np.arange(n + 1)
    keep = np.ones(len(full), bool)
    keep[1:] = (full[1:] != 32) | (full[:-1] != 32)
    keep[offsets[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return kept[offsets], full[keep]


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text`` (bit-parallel)."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1, left << 1
        up = (left | (full & ~(diagonal | right))) & full
        down = right & diagonal & full
        best = min(best, score)
    return best


def window_starts(data: np.ndarray) -> np.ndarray:
    """Where windows begin: after a space, and at characters of three bytes or more, which need no spaces."""
    first = data != 32
    first[1:] &= (data[:-1] == 32) | (data[1:] >= 0xE0)
    return np.flatnonzero(first)


def _agreeing(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of the ``CHECKED`` bytes of each row agree, added up eight bytes at a time."""
    same = (one == other).view(np.uint64)
    total = same[:, 0].copy()
    for i in range(1, same.shape[1]):
        total += same[:, i]
    # Each of the eight bytes holds at most CHECKED / 8; their sum is the highest byte.
    return (total * np.uint64(0x0101010101010101)) >> np.uint64(56)


@functools.cache
def _two_steps(moves: bytes) -> np.ndarray:
    """For each walk, even step and two bytes of text: the byte written second, and 256 for each place moved on in both."""
    single = np.frombuffer(moves, np.uint8).reshape(WALKS, STEPS, 256)
    table = np.empty((WALKS, STEPS // 2, 1 << 16), np.uint16)
    # Entries go by first byte plus 256 times the next.
    first, after = np.tile(np.arange(256, dtype=np.uint8), 256), np.repeat(np.arange(256, dtype=np.uint8), 256)
    for w in range(WALKS):
        for t in range(0, STEPS, 2):
            on = single[w, t].take(first)
            second = np.where(on, after, first)
            table[w, t // 2] = second + 256 * (on + single[w, t + 1].take(second)).astype(np.uint16)
    return table


class Index:
    """The items of one block: embedded windows from each of their words, and the tables of samples."""

    def __init__(self, items: list[tuple[object, str | None]], seed: int = 7):
        self.ids, self.items = [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            _, data = plain(np.array([0, len(raw)]), raw)
            if len(data) > 2:
                self.ids.append(item_id)
                self.items.append(data[1:-1].tobytes() if len(data) >= SHORT + 2 else data.tobytes())
        self.sizes = np.array([len(item) for item in self.items], np.int64)
        # Byte 0 never occurs in plain form, so that nothing agrees beyond an item.
        self.text = np.frombuffer(bytes(STEPS).join([b"", *self.items, b""]), np.uint8)
        self.begin = np.cumsum(self.sizes + STEPS) - self.sizes
        entries = []
        for i, item in enumerate(self.items):
            data = np.frombuffer(item, np.uint8)
            if len(item) < SHORT:
                h = int(span_hashes(prefix_sums(data, False), np.array([0]), np.array([len(data)]))[0])
                self.short[len(item)][h].append(i)
                continue
            at = np.union1d([0], window_starts(data))
            at = at[(at == 0) | (at <= len(item) - STEPS // 2)]
            entries.append(np.column_stack((np.full(len(at), i), at)))
        self.owner, self.place = np.concatenate(entries).T if entries else np.zeros((2, 0), np.int64)
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (WALKS, STEPS, 256), dtype=np.int64)
        self.far = rng.integers(0, 2, (2 * int(self.sizes.max(initial=0)), 256), dtype=np.int64)
        places = max(5, 7 + round(float(np.log(max(len(self.owner), 1) / 6000) / np.log(1 / CHANCE))))
        windows = np.bincount(self.owner, minlength=len(self.items))[self.owner]
        enough = np.ceil(np.maximum(-np.log(1 - ENTRY_RECALL), EXPECTED / windows**1.5) / AGREE**places)
        samples = int(enough.max(initial=0))
        self.samples = [rng.choice(WALKS * STEPS, places, replace=False) for _ in range(samples)]
        self.weights = rng.integers(0, 1 << 31, (samples, places), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.checked = np.sort(rng.choice(WALKS * STEPS, CHECKED, replace=False))
        seen = self.embedded(self.text, self.begin[self.owner] + self.place)
        self.seen = np.ascontiguousarray(seen[self.checked].T)
        self.bits = min(21, int(len(self.owner)).bit_length() + 5)
        self.tables, self.known = [], np.zeros((samples, 1 << self.bits), bool)
        for j in range(samples):
            members = np.flatnonzero(enough > j).astype(np.int32)
            keys = self.keys(seen, j)[members]
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], members[order]))
            self.known[j, keys[order] >> np.uint32(32 - self.bits)] = True

    def embedded(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes that the walks write from each start: one row for each step of each walk."""
        seen, steps = np.empty((WALKS * STEPS, len(starts)), np.uint8), _two_steps(self.moves.astype(np.uint8).tobytes())
        low, high = (min(int(starts.min()), len(text) - 1), int(starts.max()) + STEPS + 1) if len(starts) else (0, 0)
        part = text[low : high + 1].astype(np.uint16)
        part[:-1] += part[1:] << np.uint16(8)
        part[-1:] *= np.uint16(257)  # beyond the last byte it is read again
        both, moved = np.empty((2, len(starts)), np.uint16)
        for w in range(WALKS):
            at = starts.astype(np.int64) - low
            for t in range(0, STEPS, 2):
                np.take(part, at, out=both, mode="clip")
                np.take(steps[w, t // 2], both, out=moved, mode="clip")
                seen[w * STEPS + t], seen[w * STEPS + t + 1] = both, moved  # their low bytes
                moved >>= np.uint16(8)
                at += moved
        return seen

    def keys(self, seen: np.ndarray, sample: int) -> np.ndarray:
        """The places of one sample as one number for each window."""
        key = np.zeros(seen.shape[1], np.uint32)
        part = np.empty_like(key)
        for place, weight in zip(self.samples[sample], self.weights[sample]):
            np.multiply(seen[place], weight, out=part, dtype=np.uint32)
            key += part
        key *= np.uint32(0x9E3779B1)
        return key

    def matches(self, column):
        """Yield for each row its matches {index of item: distance}."""
        for _, offsets, data in text_slices(column, SLICE):
            offsets, data = plain(offsets, data)
            found: list[dict[int, int]] = [{} for _ in range(len(offsets) - 1)]
            self._short_matches(offsets, data, found)
            if len(self.owner) and len(data):
                self._long_matches(offsets, data, found)
            yield from found

    def _short_matches(self, offsets, data, found) -> None:
        for size, table in self.short.items():
            spaces = np.flatnonzero(data == 32)
            spaces = spaces[spaces + size <= len(data)]
            owner = np.searchsorted(offsets, spaces, "right") - 1
            spaces, owner = spaces[inside := spaces + size <= offsets[owner + 1]], owner[inside]
            hashes = span_hashes(prefix_sums(data, False), spaces, spaces + size)
            for i in np.flatnonzero(np.isin(hashes, np.array(list(table), np.uint64))).tolist():
                raw = data[spaces[i] : spaces[i] + size].tobytes()
                for item in table[int(hashes[i])]:
                    if self.items[item] == raw:
                        found[owner[i]][item] = 0

    def _candidates(self, data: np.ndarray, starts: np.ndarray):
        """Yield starts and entries that agree in a sample and in ``HAMMING`` of the checked places."""
        seen, hits = self.embedded(data, starts), []
        for j, (keys, members) in enumerate(self.tables):
            mine = self.keys(seen, j)
            hit = np.flatnonzero(self.known[j].take((mine >> np.uint32(32 - self.bits)).astype(np.intp), mode="clip"))
            low = np.searchsorted(keys, mine[hit])
            known = keys.take(low, mode="clip") == mine[hit]
            hit, low = hit[known], low[known]
            hits.append((members, hit, low, np.searchsorted(keys, mine[hit], "right")))
        # The checked places of windows that agree in some sample, one row each.
        known = np.zeros(len(starts), bool)
        for _, hit, *_ in hits:
            known[hit] = True
        checked, row = np.ascontiguousarray(seen[self.checked][:, known].T), np.cumsum(known) - 1
        for members, hit, low, high in hits:
            ends = np.cumsum(high - low)
            total = int(ends[-1]) if len(ends) else 0
            for first in range(0, total, PAIRS):
                pair = np.arange(first, min(first + PAIRS, total))
                of = np.searchsorted(ends, pair, "right")
                entry = members[pair - (ends[of] - high[of])]
                good = _agreeing(checked.take(row[hit[of]], axis=0), self.seen.take(entry, axis=0)) >= HAMMING * CHECKED
                yield starts[hit[of[good]]], entry[good]

    def _close(self, data: np.ndarray, starts: np.ndarray):
        """Yield starts and entries whose whole items agree with the text, about ``PAIRS`` at a time."""
        held, n = [], 0
        for i in range(0, len(starts), BLOCK):
            for start, entry in self._candidates(data, starts[i : i + BLOCK]):
                held.append(start * len(self.owner) + entry)
                n += len(start)
                if n >= PAIRS:
                    yield self._whole(data, held)
                    held, n = [], 0
        if n:
            yield self._whole(data, held)

    def _whole(self, data: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        start, entry = np.divmod(np.unique(np.concatenate(held)), len(self.owner))
        close = self._agreement(data, start, entry) >= WHOLE
        return start[close], entry[close]

    def _agreement(self, data: np.ndarray, start: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Share of the places of an item-sized walk, to both ends of the item, that agree."""
        item = self.owner[entry]
        here, size = self.begin[item] + self.place[entry], self.sizes[item]
        agree, left = np.zeros(len(start)), 2.0 * size
        for direction, steps, one, other in ((1, 2 * (size - self.place[entry]), start, here), (-1, 2 * self.place[entry], start - 1, here - 1)):
            rank = np.argsort(-steps)
            one, other, ends = one[rank], other[rank], -steps[rank]
            for t in range(-int(ends.min(initial=0))):
                if t % 16 == 0:
                    # What cannot reach ``WHOLE`` any more is done, as is what is at its end.
                    n = int(np.searchsorted(ends, -t, "left"))
                    able = np.flatnonzero(agree[rank[:n]] + left[rank[:n]] - np.minimum(t, -ends[:n]) >= WHOLE * 2 * size[rank[:n]] - 1)
                    rank, one, other, ends = rank[able], one[able], other[able], ends[able]
                n = int(np.searchsorted(ends, -t, "left"))
                a, b = data.take(one[:n], mode="clip"), self.text.take(other[:n], mode="clip")
                agree[rank[:n]] += a == b
                one[:n] += direction * self.far[t].take(a)
                other[:n] += direction * self.far[t].take(b)
            left -= steps
        return agree / (2 * size)

    def _long_matches(self, offsets, data, found) -> None:
        starts = window_starts(data)
        starts = starts[starts < len(data) - 1]
        regions = defaultdict(set)
        for start, entry in self._close(data, starts):
            for item, at, place in zip(self.owner[entry].tolist(), start.tolist(), self.place[entry].tolist()):
                regions[item].add((at, place))
        raw = data.tobytes() if regions else b""
        for item, at in regions.items():
            pattern = self.items[item]
            allowed = int(ERRORS * len(pattern))
            # The row is that of the window, whose item may seem to begin before it.
            rows = defaultdict(list)
            for start, place in at:
                rows[int(np.searchsorted(offsets, start, "right")) - 1].append(start - place)
            for row, begins in rows.items():
                for first, last in self._runs(sorted(begins), len(pattern)):
                    low, high = max(offsets[row], first - 2 * allowed), min(offsets[row + 1], last + len(pattern) + 2 * allowed)
                    distance = edit_distance_within(pattern, raw[low:high])
                    if distance <= allowed:
                        found[row][item] = min(distance, found[row].get(item, distance))

    @staticmethod
    def _runs(at: list[int], reach: int):
        """First and last of sorted places that lie within ``reach`` of the next."""
        first = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > reach:
                yield at[first], at[k - 1]
                first = k


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = ITEMS):
    """Yield an Index for each block of at most about ``items`` items, picked by a hash of their text."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    blocks = -(-rows.count() // items)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == b).orderBy("i", "t")
        yield Index([(r.i, r.t) for r in part.collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The id, ``item_id``, ``item_length`` (plain form) and ``distance`` of every item that a row holds."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, item_id {item_type}, item_length long, distance long"
    out, item_kind = docs.sparkSession.createDataFrame([], schema), to_arrow_type(benchmark.schema[item_col].dataType)
    for index in item_blocks(benchmark, item_col, item_text_col):

        def search(batches, index=index):
            for batch in batches:
                rows = [(r, i, d) for r, m in enumerate(index.matches(batch.column(1))) for i, d in sorted(m.items())]
                ids = batch.column(0).take(pa.array([r for r, _, _ in rows], pa.int64()))
                sizes = pa.array([len(index.items[i]) for _, i, _ in rows], pa.int64())
                items = pa.array([index.ids[i] for _, i, _ in rows], item_kind)
                yield pa.RecordBatch.from_arrays([ids, items, sizes, pa.array([d for *_, d in rows], pa.int64())], names=["_id", "item_id", "item_length", "distance"])

        out = out.union(docs.select(id_col, text_col).mapInArrow(search, schema))
    return out.withColumnRenamed("_id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """Rows of ``docs`` that hold no item, with all their columns."""
    for index in item_blocks(benchmark, **columns):
        docs = docs.filter(~F.arrow_udf(_holder(index), "boolean")(docs[text_col]))
    return docs


def _holder(index: Index):
    def holds(column: pa.Array) -> pa.Array:
        return pa.array([bool(m) for m in index.matches(column)], pa.bool_())

    return holds
