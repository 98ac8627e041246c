"""Components of n-gram set links against brute force over all pairs."""

import numpy as np

from hearthstat.llm import jaccard_join
from hearthstat.llm.jaccard_join import ngram_jaccard_join

from .conftest import folded, prose, split_words


def gram_set(text, k=3):
    w = split_words(folded(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, percent=90, k=3):
    sets = [gram_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_against_all_pairs(spark, odd_rows):
    rng = np.random.default_rng(8)
    rows = list(odd_rows)
    for g in range(6):
        base = prose(rng, 60).split()
        for i in range(12):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, 60)] = "changed" + str(rng.integers(0, 3))
            rows.append((100 + 20 * g + i, " ".join(words)))
    common = prose(rng, 12)
    rows += [(400 + i, common + " " + prose(rng, 40)) for i in range(30)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, node int")
    found = ngram_jaccard_join(docs).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key)
    assert got == sorted(brute(rows), key=key)


def test_one_prefix_group_of_a_thousand_texts(spark, monkeypatch):
    """All share prefix n-grams, few link: the sets' parities keep nearly all pairs from being written."""
    rng = np.random.default_rng(9)
    base = prose(rng, 80).split()
    places = np.arange(4, 80, 5)
    # Two words for each of 16 places, of 11 of which no two texts have all alike.
    choices = {}
    while len(choices) < 1000:
        code = tuple(rng.integers(0, 2, 16))
        choices.setdefault(code[:11], code)
    rows = []
    for i, code in enumerate(choices.values()):
        words = list(base)
        for at, other in zip(places, code):
            words[at] = f"other{at}" if other else words[at]
        rows.append((i, " ".join(words)))
    want = sorted((d, c) for d, _, c in brute(rows))
    written, whole = {}, jaccard_join.staged

    def counted(df, name):
        out = whole(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == want
    assert written["candidates"] >= 1000 and written["pairs"] < 20_000 < 1000 * 999 / 2, written


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(10)
    for n in (1, 5, 80, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64))))
        apart = len(np.setxor1d(a, b))
        bits = sum(int(x).bit_count() for x in (jaccard_join._parities(a) ^ jaccard_join._parities(b)).view(np.uint64))
        assert bits <= apart and (bits - apart) % 2 == 0


def test_long_shingles(spark):
    rng = np.random.default_rng(12)
    base = prose(rng, 90).split()
    rows = [(i, " ".join([*base[:i], "new", *base[i:]])) for i in range(0, 90, 15)] + [(99, prose(rng, 50))]
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=8, percent=70).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, 70, 8))


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_later_rounds_join_components_and_not_their_nodes_again(spark, monkeypatch):
    base = prose(np.random.default_rng(11), 400).split()
    rows = [(i, " ".join(base[: 400 - i])) for i in range(30)]
    sizes = []

    def counted(edges):
        sizes.append(edges.filter("a <> b").distinct().count())
        return components(edges)

    components = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", counted)
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, c) for i, _, c in brute(rows))
    assert len(sizes) > 1 and sizes[0] >= 20
    assert max(sizes[1:]) < sizes[0]


def test_pivots_of_their_own_leave_few_pairs_of_near_copies(spark, monkeypatch):
    """Copies of one text that link with some others each: rounds find most links before all pairs are looked at."""
    rng = np.random.default_rng(14)
    base = prose(rng, 150).split()
    rows = []
    for i in range(700):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 4), replace=False):
            words[at] = f"new{rng.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    written, whole = [], jaccard_join.staged

    def counted(df, name):
        out = whole(df, name)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    found = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, c) for i, _, c in brute(rows, 80, 5))
    assert written[-1] < 700, written


def test_merged_components(spark):
    near = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (7, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(2, 7), (3, 4), (0, 9), (10, 0)], "a long, b long")
    merged = {r.node: r.component for r in jaccard_join._merged(near, links).collect()}
    assert merged == {1: 1, 2: 1, 5: 1, 7: 1, 3: 3, 4: 3, 0: 0, 8: 0, 9: 0, 10: 0}
    unchanged = jaccard_join._merged(near, links.limit(0)).collect()
    assert sorted(map(tuple, unchanged)) == sorted(map(tuple, near.collect()))
