"""Packing: exact cover of the histogram, near the bound, gapless sequences."""

import numpy as np
import public_tokenizers
import pytest

from hearthstat.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 40, 700, 30000])
def test_solution_holds_the_histogram(n):
    lengths = np.minimum(256, np.maximum(1, np.random.default_rng(n).lognormal(4.5, 1.2, n).astype(int)))
    histogram = np.bincount(lengths, minlength=257)
    solution, held = packing.solve(histogram, 256), np.zeros(257, int)
    for times, copies in solution:
        assert times > 0 and sum(l * k for l, k in copies.items()) <= 256
        for l, k in copies.items():
            held[l] += times * k
    assert (held == histogram).all()
    bound = -(-int(lengths.sum()) // 256) if n else 0
    assert sum(t for t, _ in solution) <= 1.003 * bound + 1


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 9, 3))
        price = rng.random(len(lengths))
        best = packing.knapsack(lengths, price, 12)
        assert best @ lengths <= 12
        every = [np.array(c) for c in np.ndindex(*(13 // l + 1 for l in lengths)) if np.array(c) @ lengths <= 12]
        assert best @ price == pytest.approx(max(c @ price for c in every))


def test_sequences_have_no_gap(spark, odd_docs):
    pieces = packing.token_pieces(odd_docs, PATH, with_crc32=True)
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count() and sum(r.doc_id is None for r in rows) == 2
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length and 1 <= r.length <= 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    by_doc = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 6)
    assert all(length == 1024 for _, _, length in by_doc[1:]) and by_doc[1][1] == by_doc[0][2]


def test_other_columns_pass_and_empty_tables(spark):
    table = spark.createDataFrame([(5, "a"), (1020, "b"), (5, "c")], "length long, rank string")
    rows = packing.pack(table).collect()
    assert sorted(r["rank"] for r in rows) == ["a", "b", "c"]
    assert packing.pack(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fit"):
        packing.pack(spark.createDataFrame([(2000,)], "length long"))
