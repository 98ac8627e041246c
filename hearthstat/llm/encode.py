"""Byte-level BPE over whole Arrow columns.

Texts are cut into pieces on numpy arrays by the split rule of the vocabulary's family
(contractions; a space and letters; a space and digits; a space and other signs; white
space).  Only pieces not met before go through BPE, so a common piece costs one look-up.
Ids equal those of ``tokenizers`` with ``add_special_tokens=False``; a text that contains
one of the vocabulary's special strings is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from .arrays import prefix_sums, span_hashes, text_slices

KEPT_PIECES = 400_000  # beyond it known pieces are forgotten and learnt anew; results stay
TABLE = 1 << 21
SPACE, WHITE, LETTER, DIGIT, OTHER = range(5)
# Unicode White_Space; the split rule's contractions.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = DIGIT
    table[list(WHITE_SPACE)] = WHITE
    table[32] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and value of each code point of valid UTF-8."""
    if not len(data) or data.max() < 128:
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[at].astype(np.int32)
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int32) & 0x3F
    two, three, four = (value >= 0xC0) & (value < 0xE0), (value >= 0xE0) & (value < 0xF0), value >= 0xF0
    p = at[two]
    value[two] = (value[two] & 0x1F) << 6 | padded[p + 1]
    p = at[three]
    value[three] = (value[three] & 0x0F) << 12 | padded[p + 1] << 6 | padded[p + 2]
    p = at[four]
    value[four] = (value[four] & 0x07) << 18 | padded[p + 1] << 12 | padded[p + 2] << 6 | padded[p + 3]
    return at, value


def piece_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of all rows begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, points = code_points(data)
    kind = _classes()[points]
    group = np.where(kind <= WHITE, 0, kind)
    n = len(at)
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(at, offsets)] = True
    change = row_start[:n].copy()
    change[1:] |= group[1:] != group[:-1]
    begins = change.copy()
    # A run after a space takes that space; other white space before a run stands alone.
    run = np.flatnonzero(change & (group != 0) & ~row_start[:n])
    run = run[group[run - 1] == 0]
    begins[run - 1] = True
    begins[run[kind[run - 1] == SPACE]] = False
    # Contractions: a lone apostrophe that begins a piece, with the letters behind it.
    quote = np.flatnonzero(begins & (points == 39) & (np.append(group[1:], 0) == LETTER) & ~row_start[1:])
    for p in quote.tolist():
        end = p + 1
        while end < n and end < p + 3 and group[end] == LETTER and not row_start[end]:
            end += 1
        follow = "".join(map(chr, points[p + 1 : end]))
        for tail in CONTRACTIONS:
            if follow.startswith(tail):
                begins[p + 1] = False
                stop = p + 1 + len(tail)
                if stop < n:
                    begins[stop] = True
                break
    return at[begins]


class Encoder:
    """Ids of whole columns by one vocabulary file of a byte-level BPE."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte = _byte_letters()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if all(c in to_byte for c in piece)}
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        ranks = {piece: i for piece, i in ranks.items() if i not in special.values()}
        self.whole = Tokenizer.from_file(path)
        self.special = list(special)
        self.pairs = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.byte_length = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.byte_length[i] = len(piece)
        for text, i in special.items():
            self.byte_length[i] = len(text.encode())
        self._clear()

    def _clear(self, places: int = TABLE):
        self.mask = (1 << max(places - 1, TABLE - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.pieces = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(KEPT_PIECES, np.int64)
        self.count = np.zeros(KEPT_PIECES, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each known piece, -1 for others."""
        found = np.full(len(hashes), -1, np.int32)
        open_, place = np.arange(len(hashes)), (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(open_):
            slot = self.slots[place]
            hit = (self.keys[place] == hashes[open_]) & (slot >= 0)
            found[open_[hit]] = slot[hit]
            go = ~hit & (slot >= 0)
            open_, place = open_[go], (place[go] + 1) & self.mask
        return found

    def _learn(self, h: int, piece: bytes) -> None:
        if self.pieces == len(self.begin):
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        ids = self.pairs._encode_single_piece(piece)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        place = h & self.mask
        while self.slots[place] >= 0:
            place = (place + 1) & self.mask
        self.keys[place], self.slots[place] = h, self.pieces
        self.begin[self.pieces], self.count[self.pieces] = self.used, len(ids)
        self.pieces += 1
        self.used += len(ids)

    def slices(self, column):
        """Yield (first row, offsets, bytes, ids, index of each row's first id)."""
        for row, offsets, data in text_slices(column):
            yield row, offsets, data, *self._slice(offsets, data)

    def _slice(self, offsets, data):
        raw = data.tobytes()
        odd = [s for s in self.special if s.encode() in raw]
        if odd:
            found = [self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            firsts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            return np.array([i for x in found for i in x], np.int32), firsts
        starts = piece_starts(offsets, data)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(prefix_sums(data, False), starts, ends)
        if self.pieces > KEPT_PIECES:
            self._clear()
        slots = self._find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            values, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.pieces + len(values) > self.mask // 2:  # a text of very many pieces
                self._clear(4 * len(values))
                return self._slice(offsets, data)
            for h, p in zip(values.tolist(), new[first].tolist()):
                self._learn(h, raw[starts[p] : ends[p]])
            slots[new] = self._find(values)[back]
        counts, begin = self.count[slots], self.begin[slots]
        total = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(total[-1]) + np.repeat(begin - total[:-1], counts)
        return self.ids[at], total[np.searchsorted(starts, offsets)]


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write in place of bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path)


