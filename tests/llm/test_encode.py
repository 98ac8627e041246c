"""Ids against the tokenizers library, byte for byte."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthstat.llm.encode import Encoder
from hearthstat.llm.token_counts import section_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Encoder(PATH), Tokenizer.from_file(PATH)


def ids(encoder, texts):
    return [found[first[i] : first[i + 1]].tolist() for _, offsets, _, found, first in encoder.slices(pa.array(texts, pa.string())) for i in range(len(offsets) - 1)]


def test_random_texts(both):
    rnd = random.Random(3)
    alphabet = [*"ab'stre vmld\n\t  .,!12é中😀ß\r", "'ll", "'ve", " 're", " ", "½", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14))) for _ in range(3000)]
    assert ids(both[0], texts) == [both[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_null_is_empty_and_forgetting_changes_nothing(both):
    assert ids(both[0], [None, "", "a b"]) == [[], [], both[1].encode("a b").ids]
    texts = [" ".join(f"x{i}y" for i in range(300))]
    before = ids(both[0], texts)
    both[0]._clear()
    assert ids(both[0], texts) == before


def test_sections_hold_all_tokens_once(spark, odd_docs, odd_rows, both):
    texts = [*(t for _, t in odd_rows), "a\n\n\nb", "x\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = section_token_counts(docs, PATH).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.section)
        lines = (text or "").split("\n")
        assert len(mine) == len(lines)
        assert sum(r.n_tokens for r in mine) == len(both[1].encode(text or "", add_special_tokens=False).ids)
        assert sum(r.n_chars for r in mine) == len(text or "")
        assert [r.start_char for r in mine] == np.cumsum([0, *(len(x) + 1 for x in lines)])[:-1].tolist()
    assert section_token_counts(odd_docs.limit(0), PATH).count() == 0
    assert section_token_counts(odd_docs, PATH).filter("doc_id is null").count() == 2


def test_crossing_token_goes_to_the_larger_share_then_the_earlier():
    from hearthstat.llm.token_counts import attribute

    chars = np.arange(20)
    owner, crossing = attribute(np.array([0, 3, 8]), np.array([3, 8, 10]), np.array([0, 4, 9]), chars)
    assert owner.tolist() == [0, 1, 1] and crossing.tolist() == [0, 1, 1, 2]
