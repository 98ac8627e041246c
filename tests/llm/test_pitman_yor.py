"""Scores: base counts by brute force, a proper distribution, gain on held-out text."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthstat.llm import pitman_yor

from .conftest import folded, prose, split_words


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(97, 100, (60, 4)) @ (256 ** np.arange(4)))
    top = np.full(256, 1 / 256)
    model = pitman_yor.Restaurants(keys, rng.integers(1, 9, len(keys)), 3, 0, top, 5)
    for context in (0x616161, 0x616263, 0x7A7A7A):
        every = context << 8 | np.arange(256)
        assert pitman_yor.Restaurants(model.keys[3], model.customers[3], 3, 0, top, 5).averaged(every).sum() == pytest.approx(1)


def test_tables_stay_between_one_and_the_customers():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 16, 500))
    model = pitman_yor.Restaurants(keys, rng.integers(1, 5000, len(keys)), 1, 0, np.full(256, 1 / 256), 3)
    for _ in range(4):
        model.sweep()
        for level in (0, 1):
            assert (model.tables[level] >= 1).all() and (model.tables[level] <= model.customers[level]).all()


def test_strings_spell_the_tokens():
    data = np.frombuffer(b" Ab c\nx", np.uint8)
    keys, first = pitman_yor.strings(np.array([0, 5, 5, 7]), data)
    assert bytes((keys & 255).astype(np.uint8)) == b"ab c \n" + b"\n" + b"x \n"
    assert first.tolist() == [0, 6, 7, 10]
    assert int(keys[1]).to_bytes(6, "big") == b"\n\n\n\nab"


def test_scores(spark, odd_rows):
    rng = np.random.default_rng(7)
    rows = [*odd_rows, *((10 + i, prose(rng, 120)) for i in range(300))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, score int")
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    found = pitman_yor.score_texts(docs, held, chunk_bytes=20_000, group=2).collect()
    assert len(found) == len(rows)
    tokens = lambda t: [*split_words(folded(t)), "\n"]
    counts = Counter(w for i, t in rows if not (i is not None and i % 5 == 1) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.setdefault((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t))), []).append(base)
    for r in found:
        assert r.train_tokens == n and r.score < 0
        assert any(r.base_score == pytest.approx(b) for b in want[r.doc_id, r.n_tokens, r.n_known])
    part = [r for r in found if r.held_out and r.doc_id >= 10]
    assert sum(r.score for r in part) > sum(r.base_score for r in part)


def test_without_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = pitman_yor.score_texts(docs, F.lit(True)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0 and row.score < 0
    assert pitman_yor.score_texts(docs.limit(0), F.lit(True)).count() == 0
