"""Quality rules: counts by brute force, decoding by enumeration, odd rows."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from hearthstat.llm import quality
from hearthstat.llm.arrays import text_slices

from .conftest import prose, split_words


def counts(text):
    w = split_words(text)
    seen, again = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if split_words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_counts():
    rng = np.random.default_rng(2)
    texts = ["", None, "\n", "a\n", "a b\na b\n\n a", "é ü\r\né ü\r\n"]
    texts += ["\n".join(prose(rng, rng.integers(0, 12)) for _ in range(rng.integers(1, 6))) + " #*" for _ in range(200)]
    texts += [" ".join(rng.choice(["a", "b"], 30)) for _ in range(20)]
    for row, offsets, data in text_slices(pa.array(texts, pa.string()), 300):
        page = quality.read(offsets, data)
        for i in range(len(offsets) - 1):
            assert tuple(int(page.counts[c][i]) for c in quality.COUNTS) == counts(texts[row + i])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    page = quality.Page({}, np.array([0, 4, 5, 11]), np.ones(11), rng.normal(size=(11, len(quality.FEATURES))))
    field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    labels, score = field.viterbi(page), page.features @ field.emit
    for a, b in ((0, 4), (4, 5), (5, 11)):
        worth = lambda p: sum(score[a + i, y] for i, y in enumerate(p)) + sum(field.step[x, y] for x, y in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=b - a), key=worth)
        assert tuple(labels[a:b]) == best


def test_junk_goes_and_prose_stays(spark, odd_docs):
    rng = np.random.default_rng(9)
    junk = lambda: "\n".join(" ".join(w + "%%%" for w in prose(rng, 9).split()) for _ in range(4))
    good = lambda: "\n".join(prose(rng, 9).capitalize() + "." for _ in range(4))
    rows = [(i, junk() if i % 2 else good()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    kept = {r.doc_id for r in docs.filter(quality.judge("text", field)["kept"]).collect()}
    assert kept == set(range(0, 120, 2))
    judged = odd_docs.select("*", quality.judge("text", field).alias("_j")).select("doc_id", "_j.*").collect()
    assert len(judged) == 11 and all(r.base_failed and not r.kept for r in judged if r.n_words < 10)
    untrained = quality.fit(docs, labels.limit(0))
    assert docs.limit(0).filter(quality.judge("text", untrained)["kept"]).count() == 0


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    features = rng.normal(size=(260, len(quality.FEATURES)))
    first, label = np.array([0, 1, 5, 145, 150, 260]), np.array([1, 0, 0, 1, 0])
    data = quality.chains(features, np.repeat(label, np.diff(first)), first, label)
    assert np.diff(data.line_first).max() == quality.CHAIN and len(data.labels) > 2 * 260
    changes = np.diff(data.labels) != 0
    changes[data.line_first[1:-1] - 1] = False
    assert changes.any()
    field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    _, found = quality.slopes(field, data)
    for value, slope in zip((field.emit, field.step), found):
        for at in np.ndindex(value.shape):
            was, sides = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = was + d
                sides.append(quality.slopes(field, data)[0])
            value[at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - slope[at]) < 1e-6


def test_likelihood_by_enumeration():
    rng = np.random.default_rng(4)
    data = quality.Chains(rng.normal(size=(7, len(quality.FEATURES))), rng.integers(0, 2, 7), np.array([0, 4, 7]), np.array([1.0, 2.5]))
    field = quality.Field(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    score, want = data.features @ field.emit, 0
    for a, b, w in ((0, 4, 1.0), (4, 7, 2.5)):
        worth = lambda p: sum(score[a + i, y] for i, y in enumerate(p)) + sum(field.step[x, y] for x, y in zip(p, p[1:]))
        want += w * (worth(data.labels[a:b]) - np.log(sum(np.exp(worth(p)) for p in itertools.product((0, 1), repeat=b - a))))
    want = want / 7 - quality.PENALTY / 2 * ((field.emit**2).sum() + (field.step**2).sum())
    assert abs(quality.slopes(field, data)[0] - want) < 1e-9


def test_boilerplate_lines_are_found_in_real_good_texts(spark):
    """Lines of held-out bad texts set into held-out good ones: both kinds told apart line by line."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in docs.join(labels, "doc_id").orderBy("doc_id").collect() if len(split_words(r.text)) >= 30]
    field = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    odd = [r for r in rows if r.doc_id % 2]
    share = lambda text: len(re.findall(r"[#*$%&!]", text)) / len(split_words(text))
    good = [r.text.split("\n") for r in odd if r.quality == 1 and share(r.text) < 0.02]
    bad = [line for r in odd if r.quality == 0 for line in r.text.split("\n") if len(split_words(line)) > 3 and share(line) > 0.5]
    assert len(good) > 50 and len(bad) > 20
    rng, texts, truth = np.random.default_rng(6), [], []
    for k, lines in enumerate(good):
        at, run = rng.integers(0, len(lines) + 1), [bad[(3 * k + j) % len(bad)] for j in range(1 + k % 3)]
        texts.append("\n".join(lines[:at] + run + lines[at:]))
        truth.append([True] * at + [False] * len(run) + [True] * (len(lines) - at))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in made.select("doc_id", quality.line_marks("text", field).alias("marks"), quality.judge("text", field).alias("j")).collect()}
    pairs = [(t, m) for i, ts in enumerate(truth) for t, m in zip(ts, found[i].marks, strict=True)]
    hit = sum(not t and not m for t, m in pairs)
    assert hit >= 0.9 * sum(not t for t, _ in pairs)
    assert hit >= 0.9 * sum(not m for _, m in pairs)
    assert sum(0 < found[i].j.content_lines < found[i].j.n_lines for i in found) > 0.8 * len(found)
    assert all(found[i].j.content_lines == sum(found[i].marks) for i in found)


def test_line_marks_of_odd_rows(spark, odd_docs):
    field = quality.Field(np.zeros((len(quality.FEATURES), 2)), np.zeros((2, 2)))
    field.emit[0, 1] = 1
    rows = odd_docs.select("text", quality.line_marks("text", field).alias("m")).collect()
    assert len(rows) == 11 and all(r.m == [True] * (1 + (r.text or "").count("\n")) for r in rows)
    assert odd_docs.limit(0).select(quality.line_marks("text", field)).count() == 0
