"""Stages of the pipeline on planted documents, counted by row."""

import corpus_pipeline
import numpy as np

from .conftest import prose
from .test_jaccard_join import gram_set

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, n_chars int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], SCHEMA)


def linked(a, b, k, percent):
    x, y = gram_set(a, k), gram_set(b, k)
    return 100 * len(x & y) >= percent * len(x | y)


def kept_by_rule(rows, k=5, percent=80):
    """The least id of each component of links between texts."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if j < i and linked(a, b, k, percent):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted({find(i) for i, _ in rows})


def test_near_copies_go_by_five_words_and_four_fifths(spark):
    rng = np.random.default_rng(21)
    rows = []
    for g in range(8):
        words = prose(rng, 60).split()
        near, far = list(words), list(words)
        near[30], near[-1] = "changed", "other"  # 50 of 62 five-word shingles, 54 of 62 three-word ones
        far[15] = far[40] = "changed"  # 46 of 66
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(near)), (10 * g + 2, " ".join(far))]
    assert linked(rows[0][1], rows[1][1], 5, 80) and not linked(rows[0][1], rows[1][1], 3, 90)
    assert not linked(rows[0][1], rows[2][1], 5, 80)
    out = STAGES["n-gram Jaccard join"](spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in out) == kept_by_rule(rows)


def passage(rng, sizes):
    return " ".join("".join(rng.choice(list("abcdefghij"), n)) for n in sizes)


def test_passages_of_over_fifty_words_go(spark):
    """52 words of 306 bytes, 51 words of one letter; 50 words stay where they are."""
    rng = np.random.default_rng(22)
    longer = passage(rng, [5] * 47 + [4] * 5)
    least, fewer = passage(rng, [1] * 51), passage(rng, [5] * 50)
    assert len(longer) == 306 and len(least) == 101 and 101 < len(fewer) < 400
    around = [(passage(rng, [9] * 30), passage(rng, [9] * 30)) for _ in range(10)]
    planted = [longer] * 4 + [least] * 3 + [fewer] * 3
    # Unlike letters beside the passage, so that the repeat ends where the passage does.
    rows = [(i, f"{a}{'klmnopqrst'[i]}\n{p}\n{'klmnopqrst'[i]}{b}") for i, ((a, b), p) in enumerate(zip(around, planted))]
    out = STAGES["suffix-array dedup"](spark, documents(spark, rows), "").collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1]
        assert r.text == (text if r.doc_id >= 7 else text.replace("\n" + planted[r.doc_id] + "\n", ""))
        assert r.n_chars == len(r.text)


def test_one_row_stays_of_repeated_rows(spark):
    """Repeated rows and rows without ids are one document, and its text is whole after the next stage."""
    rng = np.random.default_rng(23)
    twice, unnamed, mixed, alone = (prose(rng, 90) for _ in range(4))
    rows = [(1, twice)] * 3 + [(None, unnamed)] * 4 + [(2, mixed), (None, mixed), (2, mixed), (3, alone)]
    rows += [(4, None)] * 2 + [(5, None), (None, None), (None, None), (6, " "), (6, " ")]
    docs = STAGES["n-gram Jaccard join"](spark, documents(spark, rows), "")
    want = [(1, twice), (2, mixed), (3, alone), (4, None), (5, None), (6, " "), (None, None), (None, unnamed)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert docs.columns == ["doc_id", "text", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=order) == want
    after = STAGES["suffix-array dedup"](spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in after), key=order) == want
