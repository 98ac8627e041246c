"""Language identification by a string kernel.

Two texts are as similar as the n-grams (1 to 3 characters, blended) that both hold, by
presence, over the geometric mean of how many each holds.  The kernel is approximated by
Nystroem: a text is its similarities to a few landmark texts, whitened by the landmarks'
own kernel matrix.  One-versus-rest kernel ridge regression is fitted on these features;
scoring is two matrix products for a batch: presence x landmark n-grams, features x weights.

Characters are lower-cased letters; all others count as one space, runs as one.  The
alphabet is that of the landmarks; a letter outside it is one further character.

Defined results: ``und`` with score 0 where the text is NULL or has no letter, or where no
labelled text was given; training rows with NULL text or language, or without a letter, are
left out.  Repeated rows of a text and a language count once in training.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrays import text_slices
from .encode import code_points

UNDETERMINED = "und"
SAMPLE = 1000  # labelled texts of each language that the regression is fitted on, at most
LANDMARKS = 24  # of each language
RIDGE = 1e-2
MOST_LANGUAGES = 5000
N_GRAMS = (1, 2, 3)


@functools.cache
def _folded() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def letters(offsets: np.ndarray, data: np.ndarray):
    """Yield each row's folded characters, one 0 before, between and after words; None without a letter."""
    at, points = code_points(data)
    folded = _folded()[points]
    cuts = np.searchsorted(at, offsets)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        text = folded[a:b]
        if not text.any():
            yield None
            continue
        text = np.concatenate(([0], text, [0]))
        yield text[(text != 0) | np.append(True, text[:-1] != 0)]


@dataclass
class Kernel:
    """Landmarks, and what turns similarities to them into scores of each language."""

    languages: list[str]
    alphabet: np.ndarray  # sorted code points; the last index stands for all others
    grams: np.ndarray  # sorted n-gram numbers of the landmarks
    presence: np.ndarray  # n-grams x landmarks, 0 or 1
    sizes: np.ndarray  # n-grams of each landmark
    weights: np.ndarray  # landmarks x languages, whitening included

    def _numbers(self, text: np.ndarray) -> np.ndarray:
        """Distinct n-gram numbers of one text."""
        base = len(self.alphabet) + 2
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        c = np.where(self.alphabet[at] == text, at + 1, base - 1).astype(np.int64)
        out, number = [], np.zeros(len(c), np.int64)
        for n in range(1, max(N_GRAMS) + 1):
            number = c if n == 1 else number[: len(c) - n + 1] * base + c[n - 1 :]
            if n in N_GRAMS and len(number):
                out.append(_distinct(number, base**n) + (base ** (n - 1)) * 2 * base)
        return np.concatenate(out)

    def similarity(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts x landmarks."""
        held = np.zeros((len(texts), len(self.grams)), np.float32)
        sizes = np.zeros(len(texts))
        for i, text in enumerate(texts):
            numbers = self._numbers(text)
            sizes[i] = len(numbers)
            at = np.minimum(np.searchsorted(self.grams, numbers), len(self.grams) - 1)
            held[i, at[self.grams[at] == numbers]] = 1
        return (held @ self.presence) / np.sqrt(sizes[:, None] * self.sizes)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.similarity(texts) @ self.weights


_seen: dict[int, np.ndarray] = {}


def _distinct(numbers: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct values below ``n``."""
    if n > 1 << 24 or len(numbers) * 8 < n:
        return np.unique(numbers)
    seen = _seen.setdefault(n, np.zeros(n, bool))
    seen[numbers] = True
    out = np.flatnonzero(seen)
    seen[out] = False
    return out


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel | None:
    """Kernel ridge regression on (text, language) rows; the first texts of a language are its landmarks."""
    texts, labels, lead, count = [], [], [], {}
    for text, language in sample:
        for _, offsets, data in text_slices(pa.array([text], pa.string())):
            folded = next(letters(offsets, data))
            if folded is not None:
                count[language] = count.get(language, 0) + 1
                if count[language] <= landmarks:
                    lead.append(len(texts))
                texts.append(folded)
                labels.append(language)
    if not texts:
        return None
    languages = sorted(set(labels))
    marks = [texts[i] for i in lead]
    kernel = Kernel(languages, np.unique(np.concatenate(marks)), np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
    sets = [kernel._numbers(t) for t in marks]
    kernel.grams = np.unique(np.concatenate(sets))
    kernel.presence = np.zeros((len(kernel.grams), len(marks)), np.float32)
    for j, s in enumerate(sets):
        kernel.presence[np.searchsorted(kernel.grams, s), j] = 1
    kernel.sizes = np.array([len(s) for s in sets], float)
    values, vectors = np.linalg.eigh(kernel.similarity(marks).astype(float))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.vstack([kernel.similarity(texts[i : i + 500]) for i in range(0, len(texts), 500)]) @ whiten
    target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    share = np.sqrt(len(texts) / np.array([labels.count(l) for l in labels]) / len(languages))[:, None]
    features, target = features * share, target * share  # each language weighs the same
    gram = features.T @ features + ridge * len(texts) * np.eye(features.shape[1]) / features.shape[1]
    kernel.weights = whiten @ np.linalg.solve(gram, features.T @ target)
    return kernel


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``per_language`` different labelled texts of each language, chosen by a hash of the text.

    Texts are thinned by the hash and copies dropped before any are ranked, so neither a language's
    rows nor a text's copies meet in a task.  Different texts are counted by hash over all rows;
    more than MOST_LANGUAGES labels are refused, as the model holds weights for each.
    """
    key = F.xxhash64("t")
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("t is not null and l is not null")
    rows = rows.filter(F.col("t").rlike("\\p{L}"))
    different = rows.select("l", key.alias("_k")).distinct()
    found = different.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).toArrow()
    if found.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = docs.sparkSession.createDataFrame(found, "l string, n long")
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    thinned = rows.join(F.broadcast(counts), "l").filter(F.pmod(key, F.lit(1 << 30)) < share * F.lit(1 << 30))
    thinned = thinned.select("t", "l").distinct()
    rank = F.row_number().over(Window.partitionBy("l").orderBy(key, "t"))
    chosen = thinned.select("t", "l", rank.alias("k")).filter(F.col("k") <= per_language)
    return [(r.t, r.l) for r in chosen.orderBy("l", "k").collect()]


def predict(text: Column | str, kernel: Kernel | None) -> Column:
    """Struct of ``lang_pred`` and ``score``, from the text alone."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def language(column: pa.Array) -> pa.Array:
        names, scores = [UNDETERMINED] * len(column), np.zeros(len(column))
        if kernel is not None:
            for row, offsets, data in text_slices(column):
                texts, where = [], []
                for i, folded in enumerate(letters(offsets, data)):
                    if folded is not None:
                        texts.append(folded)
                        where.append(row + i)
                for a in range(0, len(texts), 128):
                    found = kernel.scores(texts[a : a + 128])
                    best = found.argmax(axis=1)
                    for i, b, x in zip(where[a : a + 128], best.tolist(), found.max(axis=1).tolist()):
                        names[i], scores[i] = kernel.languages[b], min(1.0, max(0.0, (x + 1) / 2))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return language(text)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The id, ``lang_pred`` and ``score`` of every row of ``docs``; learns from ``train`` only."""
    kernel = fit(labelled_sample(train, text_col, lang_col, options.pop("per_language", SAMPLE)), **options)
    return docs.select(id_col, predict(F.col(text_col), kernel).alias("_p")).select(id_col, "_p.lang_pred", "_p.score")


