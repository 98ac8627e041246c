"""Prefix CRCs against zlib, and the draw against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hearthstat.llm import importance

BUCKETS = 97


def spoken(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())


def brute_features(text, k):
    w = spoken(text)
    return [zlib.crc32(b" ".join(w[i : i + n])) % BUCKETS for n in range(1, k + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, k, percent, least):
    s, t = (Counter(b for text in texts for b in brute_features(text, k)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in range(BUCKETS)]
    out = []
    for i, text in rows:
        f = brute_features(text, k)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(spoken(text)), len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_spans_of_any_length_equal_zlib():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 5000, 200_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        running = importance.running_crcs(data)
        a = rng.integers(0, n + 1, 50)
        b = np.maximum(a, rng.integers(0, n + 1, 50))
        assert importance.span_crcs(running, a, b).tolist() == [zlib.crc32(data[x:y].tobytes()) for x, y in zip(a, b)]


@pytest.mark.parametrize("k", (1, 3))
def test_equal_to_brute_force(spark, odd_docs, odd_rows, k):
    more = [(100 + i, " ".join(f"w{(i * j) % 19}-É{j % 3}" for j in range(i % 40))) for i in range(120)]
    rows = [*odd_rows, *more, more[40], more[40]]
    target = ["w1 w2 w3 W4", None, "", "two there here"]
    docs = spark.createDataFrame(more + [more[40]] * 2, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(docs, goal, percent=30, min_words=5, max_words=k, buckets=BUCKETS)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, brute(rows, target, k, 30, 5)), key=key)


def test_clashing_columns_and_empty_tables(spark, odd_docs):
    empty = odd_docs.limit(0)
    found = importance.resample(odd_docs, empty, percent=100, min_words=1).collect()
    assert len(found) == odd_docs.count() and sorted(r.rank for r in found if r.rank) == list(range(1, 1 + sum(r.n_words > 0 for r in found)))
    assert importance.resample(empty, odd_docs).count() == 0
    named = odd_docs.selectExpr("doc_id AS place", "text AS id", "doc_id AS _spread", "doc_id AS weight")
    drawn = importance.resample(named, empty, percent=50, min_words=1, id_col="place", text_col="id")
    assert drawn.columns[0] == "place" and drawn.count() == odd_docs.count()


def test_scores_of_one_value_do_not_meet_in_a_window(spark):
    docs = spark.createDataFrame([(7, "one two three")] * 300, "doc_id long, text string")
    found = importance.resample(docs, docs, percent=10, min_words=1)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    ranks = sorted(r.rank for r in found.collect() if r.rank)
    assert ranks == list(range(1, 31))
