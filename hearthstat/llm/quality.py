"""Quality rules: base counts, and a linear-chain conditional random field over lines.

Each line of a text is content or boilerplate.  A line's features are shares of its words or
characters (symbols, capitals, repeats, ...); the field adds a weight for each pair of
neighbouring labels.  Viterbi decoding marks the lines of every text; a text is kept when
content holds at least ``CONTENT_SHARE`` of its words.

Labels are known by text, not by line, so training has two rounds of gradient ascent on the
log likelihood, the gradient from forward-backward sums.  Its chains are the labelled texts
and, for each of them, one mixed chain: a run of lines of a text of the other label set
between its lines, so that chains change their label at known places.  The first round gives
all lines their text's label; before the second, the lines of texts labelled bad get the
first field's marks, line by line, wherever boilerplate holds most of the text's words.  Texts that fail the
base rules are not learnt from, since the field decides nothing there.  The sample is
bounded: ``SAMPLE`` texts of at most ``SAMPLE_BYTES`` bytes each.

Defined results: NULL text has no words and fails the base rules, as does the empty text;
without texts of either label the field is untrained and calls all lines content;
NULL labels are left out; repeated rows are judged each for itself; an empty table gives no
rows.  Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import mixed, prefix_sums, span_hashes, text_slices, window_hashes, words

SAMPLE = 3000  # labelled texts the field is trained on, at most
SAMPLE_BYTES = 20_000  # of each of them; longer texts are judged, but not learnt from
CHAIN = 100  # lines; training cuts longer chains
CONTENT_SHARE = 0.5
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
STEPS, RATE, PENALTY = 120, 0.2, 1e-4
SYMBOLS = b"#*$%&|<>"
FEATURES = ("always", "symbols", "capitals", "next word the same", "exclamations", "digits", "no full stop", "few words", "short words", "long words", "seen before", "distinct words", "plain")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _CAPITAL, _LOWER, _DIGIT, _BANG = map(_table, (SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!"))


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


@dataclass
class Page:
    """What one slice of texts yields: counts by text, features by line."""

    counts: dict[str, np.ndarray]
    line_first: np.ndarray  # index of each text's first line, n + 1 values
    line_words: np.ndarray
    features: np.ndarray


def read(offsets: np.ndarray, data: np.ndarray) -> Page:
    n = len(offsets) - 1
    starts, ends, first = words(offsets, data)
    n_words = np.diff(first)
    sums = prefix_sums(data, False)
    hashes = span_hashes(sums, starts, ends)
    leads = _running((data & 0xC0) != 0x80)
    chars = leads[ends] - leads[starts]
    symbols = _running(_SYMBOL[data])
    by_word = _running(np.ones(0)) if not len(chars) else np.concatenate(([0], np.cumsum(chars)))

    # Words in windows that the text has twice or more.
    windows, begins = window_hashes(hashes, first, WINDOW)
    owner = np.repeat(np.arange(n), np.diff(begins))
    keys = mixed(windows + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(starts) + WINDOW + 1, np.int64)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = np.flatnonzero(twice[at] == keys)
        word = first[owner[hit]] + hit - begins[owner[hit]]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + WINDOW, -1)
    repeated = _running(np.cumsum(cover)[: len(starts)] > 0)

    # Lines.
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    line_first = np.concatenate(([0], np.cumsum(1 + np.bincount(row_of, minlength=n))))
    index = np.arange(len(breaks)) + row_of + 1
    line_start, line_end = np.empty(line_first[-1], np.int64), np.empty(line_first[-1], np.int64)
    line_start[line_first[:-1]], line_start[index] = offsets[:-1], breaks + 1
    line_end[line_first[1:] - 1], line_end[index - 1] = offsets[1:], breaks
    word_a, word_b = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    line_row = np.repeat(np.arange(n), np.diff(line_first))
    with_word = np.flatnonzero(word_b > word_a)
    line_key = mixed(span_hashes(sums, line_start[with_word], line_end[with_word]) + line_row[with_word].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, earliest = np.unique(line_key, return_index=True)
    seen = np.zeros(len(line_start), bool)
    seen[with_word] = True
    seen[with_word[earliest]] = False

    count = np.maximum(word_b - word_a, 1)
    size = np.maximum(leads[line_end] - leads[line_start], 1)
    within = lambda flags: (lambda r: r[line_end] - r[line_start])(_running(flags[data]))
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[word_a[with_word]] = False
    same = _running(same)
    capitals, lower = within(_CAPITAL), within(_LOWER)
    mean = (by_word[word_b] - by_word[word_a]) / count
    last = data[np.maximum(line_end - 1, 0)] if len(data) else np.zeros(len(line_end), np.uint8)
    marked, shouted = symbols[line_end] - symbols[line_start], within(_BANG)
    twins, upper = same[word_b] - same[word_a], capitals / np.maximum(capitals + lower, 1)
    columns = (
        np.ones(len(count)),
        np.minimum(marked, 2 * count) / count,
        upper,
        twins / count,
        np.minimum(shouted, 2 * count) / count,
        within(_DIGIT) / size,
        last != ord("."),
        count < 4,
        np.clip(4 - mean, 0, 4) / 4,
        np.clip(mean - 8, 0, 8) / 8,
        seen,
        np.clip(_distinct_share(hashes, word_a, word_b, count), 0, 1),
        (word_b > word_a) & ((marked + shouted + twins) * 10 <= count) & (upper <= 0.5) & ~seen,
    )
    counts = {
        "n_words": n_words,
        "word_chars": by_word[first[1:]] - by_word[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(line_row[seen], minlength=n),
        "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]],
    }
    return Page(counts, line_first, word_b - word_a, np.column_stack([np.asarray(c, float) for c in columns]))


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Texts with too few words or too many in repeated windows."""
    n_words = counts["n_words"]
    return (n_words < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * n_words)


def _distinct_share(hashes, word_a, word_b, count) -> np.ndarray:
    owner = np.repeat(np.arange(len(word_a)), word_b - word_a)
    at = np.arange(len(owner)) + np.repeat(word_a - (np.cumsum(word_b - word_a) - (word_b - word_a)), word_b - word_a)
    keys = np.sort((mixed(hashes[at]) >> np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(40)))
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=len(word_a)) / count


@dataclass
class Field:
    """Weights of a linear-chain conditional random field; label 1 is content."""

    emit: np.ndarray  # features x 2
    step: np.ndarray  # from x to

    def viterbi(self, page: Page) -> np.ndarray:
        """Best label of each line, all texts of the page at once."""
        score = page.features @ self.emit
        order, active = _by_length(page.line_first)
        begin = page.line_first[:-1][order]
        best = np.zeros((len(order), 2))
        back = np.zeros((len(score), 2), np.int8)
        labels = np.zeros(len(score), np.int8)
        for t, m in enumerate(active):
            at = begin[:m] + t
            if t:
                paths = best[:m, :, None] + self.step
                back[at] = paths.argmax(axis=1)
                best[:m] = paths.max(axis=1) + score[at]
            else:
                best[:m] = score[at]
        end = best.argmax(axis=1).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = begin[:m] + t
            labels[at] = end[:m]
            end[:m] = back[at, end[:m]] if t else end[:m]
        return labels


def _by_length(line_first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Texts from most lines to fewest, and how many have a line 0, 1, 2, ..."""
    lengths = np.diff(line_first)
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max()) if len(lengths) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(most), "left").tolist()


@dataclass
class Chains:
    """Training chains: features and labels by line, first lines and weight by chain."""

    features: np.ndarray
    labels: np.ndarray
    line_first: np.ndarray
    weight: np.ndarray


def train(pages: list[Page], labels: list[np.ndarray]) -> Field:
    """Train on texts and mixed chains, first by text labels, then by the field's own marks of bad texts."""
    field = Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    field.emit[0, 1] = 1e-3
    judged = [~base_failed(p.counts) for p in pages]
    label = np.concatenate([np.zeros(0, np.int64), *(y[j] for y, j in zip(labels, judged))])
    if len(set(label.tolist())) < 2:
        return field
    lines = [np.repeat(j, np.diff(p.line_first)) for p, j in zip(pages, judged)]
    features = np.vstack([p.features[x] for p, x in zip(pages, lines)])
    line_words = np.concatenate([p.line_words[x] for p, x in zip(pages, lines)])
    line_first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.line_first)[j] for p, j in zip(pages, judged)]))))
    marks = np.repeat(label, np.diff(line_first))
    ascend(field, chains(features, marks, line_first, label))
    found = (features @ field.emit).argmax(axis=1)  # each line by itself: neighbours share the text's label so far
    junk = np.add.reduceat(line_words * (found == 0), line_first[:-1])
    unclear = (label == 0) & (2 * junk > np.add.reduceat(line_words, line_first[:-1]))
    marks = np.where(np.repeat(unclear, np.diff(line_first)), found, marks)
    ascend(field, chains(features, marks, line_first, label))
    return field


def chains(features: np.ndarray, marks: np.ndarray, line_first: np.ndarray, label: np.ndarray) -> Chains:
    """The texts, both kinds weighing the same, and a mixed chain for each of them."""
    rng = np.random.default_rng(7)
    lengths = np.diff(line_first)
    plain = [np.arange(a, b) for a, b in zip(line_first[:-1], line_first[1:])]
    others = [rng.permutation(np.flatnonzero(label == kind)) for kind in (1, 0)]  # partners of label 0, of 1
    mixed_ones = []
    for i, lines in enumerate(plain):
        partner = others[label[i]][i % len(others[label[i]])]
        size = rng.integers(1, lengths[partner] + 1)
        begin = rng.integers(0, lengths[partner] - size + 1)
        at = rng.integers(0, lengths[i] + 1)
        mixed_ones.append(np.concatenate((lines[:at], plain[partner][begin : begin + size], lines[at:])))
    share = np.bincount(np.repeat(label, lengths), minlength=2) / lengths.sum()
    parts, weight = [], []
    for lines, w in zip(plain + mixed_ones, [*(0.5 / share[label]), *np.ones(len(plain))]):
        for a in range(0, len(lines), CHAIN):
            parts.append(lines[a : a + CHAIN])
            weight.append(w)
    index = np.concatenate(parts)
    first = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return Chains(features[index], marks[index].astype(np.int64), first, np.array(weight))


def slopes(field: Field, data: Chains) -> tuple[float, list[np.ndarray]]:
    """Penalised log likelihood a line, and its slopes by ``emit`` and by ``step``."""
    lengths, rows = np.diff(data.line_first), data.labels
    order, active = _by_length(data.line_first)
    begin, weight = data.line_first[:-1][order], data.weight[order]
    line_weight = np.repeat(data.weight, lengths)
    score = data.features @ field.emit
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    for t, m in enumerate(active):
        at = begin[:m] + t
        forward[at] = score[at] + (_sum(forward[at - 1][:, :, None] + field.step) if t else 0)
    for t in range(len(active) - 1, 0, -1):
        at = begin[: active[t]] + t
        backward[at - 1] = _sum(field.step.T[None] + (score[at] + backward[at])[:, :, None])
    total = _sum((forward + backward)[data.line_first[:-1]][:, :, None])[:, 0]
    by_line = np.repeat(total, lengths)
    marginal = np.exp(forward + backward - by_line[:, None]) * line_weight[:, None]
    expected = np.zeros((2, 2))
    for t in range(1, len(active)):
        m = active[t]
        at = begin[:m] + t
        joint = forward[at - 1][:, :, None] + field.step + (score[at] + backward[at])[:, None, :] - by_line[at][:, None, None]
        expected += (np.exp(joint) * weight[:m, None, None]).sum(axis=0)
    follows = np.ones(len(rows), bool)
    follows[data.line_first[:-1]] = False
    after = np.flatnonzero(follows)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (rows[after - 1], rows[after]), line_weight[after])
    value = (line_weight * score[np.arange(len(rows)), rows]).sum() + (pairs * field.step).sum() - (data.weight * total).sum()
    value = value / len(rows) - PENALTY / 2 * ((field.emit**2).sum() + (field.step**2).sum())
    truth = np.eye(2)[rows] * line_weight[:, None]
    return value, [data.features.T @ (truth - marginal) / len(rows) - PENALTY * field.emit, (pairs - expected) / len(rows) - PENALTY * field.step]


def ascend(field: Field, data: Chains) -> None:
    """Climb the likelihood from where the field stands, with moments of the slopes."""
    values = (field.emit, field.step)
    moment, spread = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for k in range(1, STEPS + 1):
        for i, slope in enumerate(slopes(field, data)[1]):
            moment[i] = 0.9 * moment[i] + 0.1 * slope
            spread[i] = 0.99 * spread[i] + 0.01 * slope**2
            values[i][...] += RATE * (moment[i] / (1 - 0.9**k)) / (np.sqrt(spread[i] / (1 - 0.99**k)) + 1e-8)


def _sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the second axis."""
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> Field:
    """Train on at most ``sample`` labelled texts of at most ``SAMPLE_BYTES``, chosen by a hash of id and text."""
    pick = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    pick = pick.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    ids = pick.sparkSession.createDataFrame(pick.toArrow(), pick.schema)  # at most ``sample`` rows
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t").between(1, SAMPLE_BYTES)).join(F.broadcast(ids), "_id")
    rows = rows.orderBy(F.xxhash64("_id", "_t"), "_id", "_y").limit(sample).select("_t", "_y").toArrow()
    pages, truth = [], []
    label = rows.column("_y").to_numpy()
    for row, offsets, data in text_slices(rows.column("_t")):
        pages.append(read(offsets, data))
        truth.append(label[row : row + len(offsets) - 1].astype(np.int64))
    return train(pages, truth)


def line_marks(text: Column | str, field: Field) -> Column:
    """For each line of a text, whether it is content; one line for NULL and the empty text."""

    @F.arrow_udf("array<boolean>")
    def marks(column: pa.Array) -> pa.Array:
        sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        for _, offsets, data in text_slices(column):
            page = read(offsets, data)
            sizes.append(np.diff(page.line_first))
            values.append(field.viterbi(page))
        first = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(values).astype(bool)))

    return marks(text)


def judge(text: Column | str, field: Field, content_share: float = CONTENT_SHARE) -> Column:
    """Struct of the counts, ``n_lines``, ``content_lines``, ``content_words``, ``base_failed`` and ``kept`` of a text."""
    names = [*COUNTS, "n_lines", "content_lines", "content_words"]
    kind = ",".join(f"{n}:long" for n in names)

    @F.arrow_udf(f"struct<{kind},base_failed:boolean,kept:boolean>")
    def verdict(column: pa.Array) -> pa.Array:
        found = {n: [] for n in (*names, "base_failed", "kept")}
        for _, offsets, data in text_slices(column):
            page = read(offsets, data)
            marks = field.viterbi(page)
            by_text = lambda values: np.diff(_running(values)[page.line_first])
            lines, content = by_text(marks), by_text(page.line_words * marks)
            c = page.counts
            failed = base_failed(c)
            kept = ~failed & (content >= content_share * c["n_words"])
            judged = {"n_lines": np.diff(page.line_first), "content_lines": lines, "content_words": content, "base_failed": failed, "kept": kept}
            for name, values in (c | judged).items():
                found[name].append(values)
        arrays = [pa.array(np.concatenate(v) if v else np.zeros(0, int)).cast(pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in found.items()]
        return pa.StructArray.from_arrays(arrays, list(found))

    return verdict(text)
