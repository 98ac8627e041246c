"""Suffix and common-prefix arrays by external induced sorting.

Suffixes whose text rises where it fell before (seeds) are sorted first; all others follow
from them: scanning sorted suffixes upwards, the suffix one symbol to the left joins the
queue of its first symbol if it falls; scanning downwards, if it rises.  Within a symbol's
queue, suffixes that begin with longer runs of the symbol come in later generations.  The
queues are monotone: a symbol's queue is read when all smaller (larger) ones are done, so
entries need no comparison, and each is a file of blocks once memory is full.

Seeds are sorted the same way: the passes over unsorted seeds order the pieces between seeds,
equal pieces get equal names, and the text of names, at most half as long, is sorted by
recursion, or in memory when it fits.

Entries are (position, common prefix with the entry before).  Common prefixes are carried to
the left: one more than the least value between the two sources.  They are exact up to
``cap``; those of neighbouring seeds come from comparing sums over prefixes.

The text lies in a file of the task's scratch space that vanishes with the task.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .arrays import powers, prefix_sums

IN_MEMORY = 1 << 22  # names sorted in memory, entries held before a queue goes to disk
_INVERSE_OF = {}


class Queues:
    """One queue of (position, common prefix) for each symbol; blocks beyond ``limit`` entries lie on disk."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.held = limit, 0
        self.blocks: dict[int, list] = {}
        self.file = None

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.blocks.setdefault(symbol, []).append((position, prefix))
        self.held += len(position)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks.values():
            kept = [b for b in blocks if not isinstance(b[0], np.ndarray)]
            fresh = [b for b in blocks if isinstance(b[0], np.ndarray)]
            if fresh:
                position, prefix = (np.concatenate([b[i] for b in fresh]) for i in (0, 1))
                kept.append((self.file.tell(), len(position)))
                self.file.write(position.astype("<i8").tobytes())
                self.file.write(prefix.astype("<i4").tobytes())
            blocks[:] = kept
        self.held = 0

    def symbols(self) -> list[int]:
        return list(self.blocks)

    def pop(self, symbol: int):
        """Take a symbol's queue: its blocks, first in first out."""
        blocks = self.blocks.pop(symbol, [])
        self.held -= sum(len(b[0]) for b in blocks if isinstance(b[0], np.ndarray))
        return [self._read(b) for b in blocks]

    def _read(self, block):
        if isinstance(block[0], np.ndarray):
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), "<i8"), np.frombuffer(self.file.read(4 * n), "<i4")

    def close(self) -> None:
        self.blocks = {}
        if self.file is not None:
            self.file.close()


def common_prefix(text, p: int, q: int, cap: int) -> int:
    n = min(cap, len(text) - max(p, q))
    differ = np.flatnonzero(np.asarray(text[p : p + n]) != np.asarray(text[q : q + n]))
    return int(differ[0]) if len(differ) else n


class _Pass:
    """One scan over sorted suffixes that fills the queues of the suffixes to their left."""

    def __init__(self, text, queues: Queues, cap: int, rising: bool):
        self.text, self.queues, self.cap, self.rising = text, queues, cap, rising
        self.least: dict[int, int] = {}  # least common prefix since a symbol's last entry
        self.last = -1

    def feed(self, symbol: int, position: np.ndarray, prefix: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scan one block; returns the entries that stay with ``symbol`` (its next generation)."""
        inner = np.flatnonzero(position > 0)
        before = np.asarray(self.text[position[inner] - 1])
        go = (before > symbol) if not self.rising else (before < symbol)
        stay = inner[before == symbol] if same else inner[:0]
        going, target = inner[go], before[go]
        if self.cap:
            order = np.argsort(target, kind="stable")
            edges = np.flatnonzero(np.append(True, target[order][1:] != target[order][:-1])) if len(order) else []
            ends = np.append(edges[1:], len(order)) if len(order) else []
            whole = int(prefix.min()) if len(prefix) else self.cap
            for known in self.least:
                self.least[known] = min(self.least[known], whole)
            for a, b in zip(edges, ends):
                at = going[order[a:b]]
                x = int(target[order[a]])
                value = np.empty(b - a, np.int64)
                value[0] = min(self.saved.get(x, self.cap), int(prefix[: at[0] + 1].min())) + 1 if x in self.saved else 0
                if b - a > 1:
                    cuts = np.column_stack((at[:-1] + 1, at[1:] + 1)).ravel()
                    cuts = cuts[:-1] if cuts[-1] >= len(prefix) else cuts
                    value[1:] = np.minimum.reduceat(prefix, cuts)[::2] + 1
                self.least[x] = int(prefix[at[-1] + 1 :].min()) if at[-1] + 1 < len(prefix) else self.cap
                self.queues.push(x, position[at] - 1, np.minimum(value, self.cap).astype(np.int32))
            self.saved = dict(self.least)
        elif len(going):
            order = np.argsort(target, kind="stable")
            edges = np.flatnonzero(np.append(True, target[order][1:] != target[order][:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                at = going[order[a:b]]
                self.queues.push(int(target[order[a]]), position[at] - 1, np.zeros(b - a, np.int32))
        if not len(stay):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        value = np.zeros(len(stay), np.int32)
        if self.cap and len(stay) > 1:
            cuts = np.column_stack((stay[:-1] + 1, stay[1:] + 1)).ravel()
            cuts = cuts[:-1] if cuts[-1] >= len(prefix) else cuts
            value[1:] = np.minimum(np.minimum.reduceat(prefix, cuts)[::2] + 1, self.cap)
        return position[stay] - 1, value

    saved: dict[int, int] = {}


def _joined(blocks) -> tuple[np.ndarray, np.ndarray]:
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate([b[i] for b in blocks]) for i in (0, 1))


def induce(text, seeds: "Queues", size: int, cap: int, limit: int):
    """Yield blocks (symbol, positions, common prefixes, rising) of all suffixes in falling order.

    ``seeds`` holds the sorted seeds by first symbol; a common prefix is that with the entry
    yielded before.
    """
    falls, rises = Queues(limit), Queues(limit)
    up = _Pass(text, falls, cap, rising=False)
    up.saved = {}
    stored = Queues(limit)
    heads: dict[int, list] = {}
    if size:
        falls.push(int(text[size - 1]), np.array([size - 1]), np.array([0], np.int32))
        if cap:
            up.least[int(text[size - 1])] = cap
            up.saved = dict(up.least)
    for symbol in _rising_symbols(falls, seeds):
        last, run = -1, 1
        position, prefix = _joined(falls.pop(symbol))
        prefix = prefix.copy()
        while len(position):
            if cap:
                prefix[0] = min(run - 1, cap) if last >= 0 else 0
            stored.push(symbol, position, prefix)
            last = int(position[-1])
            position, prefix = up.feed(symbol, position, prefix, same=True)
            run += 1
        position, prefix = _joined(seeds.pop(symbol))
        if len(position):
            prefix = prefix.copy()
            if cap:
                prefix[0] = common_prefix(text, last, int(position[0]), cap) if last >= 0 else 0
            up.feed(symbol, position, prefix, same=False)
    falls.close()
    down = _Pass(text, rises, cap, rising=True)
    down.saved = {}
    for symbol in _falling_symbols(stored, rises):
        last, run = -1, 1
        position, prefix = _joined(rises.pop(symbol))
        prefix = prefix.copy()
        while len(position):
            if cap:
                prefix[0] = min(run - 1, cap) if last >= 0 else 0
            yield symbol, position, prefix, True
            last = int(position[-1])
            position, prefix = down.feed(symbol, position, prefix, same=True)
            run += 1
        position, prefix = _joined(stored.pop(symbol))
        if len(position):
            position = position[::-1]
            back = np.zeros(len(prefix), np.int32)
            back[1:] = prefix[:0:-1]
            if cap:
                back[0] = common_prefix(text, last, int(position[0]), cap) if last >= 0 else 0
            yield symbol, position, back, False
            down.feed(symbol, position, back, same=False)
    stored.close()
    rises.close()


def _rising_symbols(*queues: Queues):
    done = -1
    while True:
        left = [s for q in queues for s in q.symbols() if s > done]
        if not left:
            return
        done = min(left)
        yield done


def _falling_symbols(*queues: Queues):
    done = None
    while True:
        left = [s for q in queues for s in q.symbols() if done is None or s < done]
        if not left:
            return
        done = max(left)
        yield done


def seed_positions(text) -> np.ndarray:
    """Positions where the text rises and the symbol before is larger; the end counts as smallest."""
    symbols = np.asarray(text)
    n = len(symbols)
    if n < 2:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(symbols[1:].astype(np.int64) - symbols[:-1].astype(np.int64))
    step[-1] = -1
    changes = np.flatnonzero(step)
    rising = step[changes[np.searchsorted(changes, np.arange(n))]] > 0
    return np.flatnonzero(rising[1:] & (symbols[:-1] > symbols[1:])) + 1


def sort_in_memory(names: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a short text in order, by doubling."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        width *= 2


def sorted_seeds(text, seeds: np.ndarray, sums, limit: int) -> np.ndarray:
    """Seeds in the order of their suffixes."""
    if len(seeds) < 2:
        return seeds
    unsorted = _by_symbol(text, seeds, np.zeros(len(seeds), np.int32), limit)
    is_seed = np.zeros(len(text) + 1, bool)
    is_seed[seeds] = True
    blocks = [p[is_seed[p]] for _, p, _, rising in induce(text, unsorted, len(text), 0, limit) if rising]
    order = np.concatenate(blocks)[::-1]
    number = np.empty(len(text) + 1, np.int64)
    number[seeds] = np.arange(len(seeds))
    at = number[order]
    ends = np.append(seeds[1:] + 1, len(text))
    length = ends - seeds
    piece = _spans(sums, seeds, ends)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (piece[at][1:] != piece[at][:-1]) | (length[at][1:] != length[at][:-1])
    fresh[1:] |= (at[1:] == len(seeds) - 1) | (at[:-1] == len(seeds) - 1)  # the last piece meets the end
    names = np.empty(len(seeds), np.int64)
    names[at] = np.cumsum(fresh)
    if names.max() == len(seeds):
        return order
    if len(names) <= limit:
        return seeds[sort_in_memory(names)]
    return seeds[suffix_array(names, limit)]


def _spans(sums, starts, ends):
    from .arrays import _INVERSE, mixed

    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def _sums(text) -> np.ndarray:
    if text.dtype == np.uint8:
        return prefix_sums(np.asarray(text), False)
    from .arrays import _BASE, mixed

    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(mixed(np.asarray(text).astype(np.uint64)) * powers(_BASE, len(text)), out=out[1:])
    return out


def _by_symbol(text, positions: np.ndarray, prefix: np.ndarray, limit: int) -> Queues:
    queues = Queues(limit)
    if len(positions):
        first = np.asarray(text[positions])
        order = np.argsort(first, kind="stable")
        edges = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            queues.push(int(first[order[a]]), positions[order[a:b]], prefix[order[a:b]])
    return queues


def suffix_array(text, limit: int = IN_MEMORY) -> np.ndarray:
    """All suffixes in rising order (for texts of names; the array is held)."""
    blocks = [p for _, p, _ in suffixes(text, 0, limit)]
    return np.concatenate(blocks)[::-1] if blocks else np.zeros(0, np.int64)


def suffixes(text, cap: int, limit: int = IN_MEMORY):
    """Yield blocks (symbol, positions, common prefixes up to ``cap``) of all suffixes in falling order."""
    sums = _sums(text)
    seeds = sorted_seeds(text, seed_positions(text), sums, limit)
    prefix = np.zeros(len(seeds), np.int32)
    if cap and len(seeds) > 1:
        low, high = np.zeros(len(seeds) - 1, np.int64), np.minimum(cap, len(text) - np.maximum(seeds[1:], seeds[:-1]))
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = _spans(sums, seeds[1:], seeds[1:] + middle) == _spans(sums, seeds[:-1], seeds[:-1] + middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        prefix[1:] = low
    del sums
    for symbol, position, common, _ in induce(text, _by_symbol(text, seeds, prefix, limit), len(text), cap, limit):
        yield symbol, position, common
