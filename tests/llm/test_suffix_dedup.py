"""Suffix arrays and repeated strings against brute force."""

from collections import Counter

import numpy as np
import pytest

from hearthstat.llm import suffix_dedup
from hearthstat.llm.induced import suffixes

from .conftest import prose


def sorted_suffixes(text, cap):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = []
    for a, b in zip(order, order[1:]):
        n = 0
        while n < min(cap, len(text) - max(a, b)) and text[a + n] == text[b + n]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("limit", [3, 1000])
def test_suffix_and_prefix_arrays(limit):
    """A limit of 3 sends queues to disk and names to recursion."""
    rng = np.random.default_rng(limit)
    for k in range(250):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(1, 60)).astype(np.uint8)
        if k % 3 == 0:
            text = np.tile(text[: max(1, len(text) // 4)], 5)
        found = list(suffixes(text, 8, limit))
        order, common = sorted_suffixes(text.tolist(), 8)
        assert np.concatenate([p for _, p, _ in found]).tolist() == order[::-1]
        assert np.concatenate([c for *_, c in found]).tolist()[1:] == common[::-1]


def covered(raws, length):
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def test_spans_in_spark(spark, odd_rows):
    rng = np.random.default_rng(4)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = [t for _, t in odd_rows]
    texts += [prose(rng, 30) + " " + shared[i % 4][i % 7 :] + prose(rng, 20) for i in range(40)]
    texts += ["ab" * 150, "x" * 120, shared[0] + shared[0], shared[1][:59], shared[1][:61]]
    docs = spark.createDataFrame([(i % 50, t, i) for i, t in enumerate(texts)], "doc_id int, text string, uid int")
    rows = suffix_dedup.deduplicated(docs, length=60, gram=20, shard_bytes=3000).collect()
    assert len(rows) == len(texts)
    want = covered([(t or "").encode() for t in texts], 60)
    for r in rows:
        gone = want[r.uid]
        assert (r._dedup.n_bytes, r._dedup.n_removed) == (len(gone), sum(gone))
        assert r._dedup.n_spans == sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))


def test_empty_and_clashing_columns(spark, odd_docs):
    assert suffix_dedup.deduplicated(odd_docs.limit(0)).count() == 0
    rows = suffix_dedup.deduplicated(odd_docs.drop("_task")).collect()
    removed = sorted(r._dedup.n_removed for r in rows if r.doc_id in (6, 8))
    assert len(rows) == 11 and removed[0] == removed[1] > 0
    assert all(r._dedup.n_removed == 0 for r in rows if r.doc_id not in (6, 7, 8))


def test_names_used_inside_stay_what_they_are(spark, odd_docs):
    named = odd_docs.selectExpr("doc_id", "text", "n_chars AS uid", "lang AS _uid", "source AS spans", "node AS _spans", "length AS owner", "length AS row", "lang AS _u")
    rows = suffix_dedup.deduplicated(named)
    assert rows.columns == [*named.columns, "_dedup"]
    assert {(r._uid, r.spans, r._spans, r.owner, r.row, r.uid) for r in rows.collect()} == {("en", "s", "x", 2, 2, 1)}


def test_copies_of_a_row_send_one_piece(spark, monkeypatch):
    """3,000 equal rows with a shared passage: the shard gets the pieces of different rows only."""
    rng = np.random.default_rng(6)
    shared = prose(rng, 60)
    rows = [(1, prose(rng, 30) + shared + prose(rng, 30))] * 3000 + [(i, prose(rng, 30) + shared + prose(rng, 30)) for i in (2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    seen = []
    whole = suffix_dedup._sorted_shard

    def spied(length):
        seen.append(length)
        return whole(length)

    monkeypatch.setattr(suffix_dedup, "_sorted_shard", spied)
    found = suffix_dedup.deduplicated(docs, length=100, gram=40).collect()
    assert seen and len(found) == 3003
    assert all(r._dedup.n_removed == r._dedup.n_bytes for r in found if r.doc_id == 1)  # copies of each other
    assert all(len(shared.encode()) <= r._dedup.n_removed < r._dedup.n_bytes for r in found if r.doc_id > 1)


def test_both_sorts_find_the_same_starts():
    rng = np.random.default_rng(5)
    for length in (3, 8, 9, 40, 101, 400):
        for letters in (2, 30):
            pieces = [bytes(rng.integers(0, letters, rng.integers(1, 3 * length), dtype=np.uint8)) for _ in range(12)]
            pieces += [p[rng.integers(0, len(p)) :] + pieces[0] for p in pieces[:6]] + [b"\0" * 2 * length, b"", pieces[1]]
            text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
            size = np.array([len(p) for p in pieces])
            begin = np.cumsum(size + 1) - size - 1
            starts = [(int(b) + i, p[i : i + length]) for b, p in zip(begin, pieces) for i in range(len(p) - length + 1)]
            seen = Counter(s for _, s in starts)
            expected = [i for i, s in starts if seen[s] > 1]
            for found in (suffix_dedup._starts_in_memory, suffix_dedup._starts_on_disk):
                assert found(text, begin, begin + size, length).tolist() == expected


def test_a_shard_is_sorted_in_memory_up_to_its_limit(monkeypatch):
    text = np.frombuffer(b"abcabc\0", np.uint8)
    ends = np.array([0]), np.array([6])
    with monkeypatch.context() as m:
        m.setattr(suffix_dedup, "suffixes", None)
        assert [x.tolist() for x in suffix_dedup.repeats(text, *ends, 3)] == [[0], [6]]
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 6)
    monkeypatch.setattr(suffix_dedup, "_starts_in_memory", None)
    assert [x.tolist() for x in suffix_dedup.repeats(text, *ends, 3)] == [[0], [6]]
