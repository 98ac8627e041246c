"""Token files: ids against the tokenizers library, round trip, encodings, selective reads."""

import glob
import os
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthstat.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows, end_id=1):
    """Ids of each row, in ascending order of ids with NULL first."""
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end_id]) for i, t in texts]


def test_ids_equal_the_library(library):
    rnd = random.Random(4)
    alphabet = [*"abSTrévmlD\n\t  .,!12é中😀ßǅⅷ²̸́=<>'  ", "'ll", "'VE", " 're", "½", "<|endoftext|>", "<|startoftext|>", "don't", "ﬁ", "İ", "Σ", "ς"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 16))) for _ in range(6000)]
    plain = [t.replace("<|", "<").replace("|>", ">") for t in texts]
    encoder = token_files.PieceEncoder(PATH)
    for batch in (plain, texts, plain):
        found = []
        for _, offsets, _, ids, first in encoder.slices(pa.array(batch)):
            found += [ids[first[i] : first[i + 1]].tolist() for i in range(len(offsets) - 1)]
        assert found == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_forgetting_and_growing_change_nothing(library):
    encoder = token_files.PieceEncoder(PATH)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i}x" for i in range(4000))]
    want = library.encode(texts[0], add_special_tokens=False).ids
    for places in (1 << 21, 64):
        encoder._clear(places)
        ((_, _, _, ids, _),) = encoder.slices(pa.array(texts))
        assert ids.tolist() == want


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_round_trip(spark, odd_docs, odd_rows, library, tmp_path, encoding):
    path = f"{tmp_path}/{encoding}"
    token_files.write_token_files(odd_docs.repartition(3), path, PATH, 1, meta=["lang", "length", "_task"], encoding=encoding)
    read = token_files.read_tokens(spark, path).orderBy("start").collect()
    want = expected(library, odd_rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in read) == sorted((str(i), x) for i, x in want)
    assert [r.doc_id for r in read] == [i for i, _ in want]  # ascending, NULL first
    starts = [sum(r.n_tokens for r in read[:k]) for k in range(len(read))]
    assert [r.start for r in read] == starts
    assert all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and r.n_tokens == len(r.ids) for r in read)
    assert all(r.meta.lang == "en" for r in read)
    again = token_files.token_digests(token_files.read_tokens(spark, path)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in again] == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read]
    assert token_files.damaged(spark, path).count() == 0
    columns = [pq.ParquetFile(f).metadata.row_group(0).column(i) for f in glob.glob(f"{path}/tokens/*.parquet") for i in range(6) if pq.ParquetFile(f).metadata.num_row_groups]
    ids = [c for c in columns if c.path_in_schema == "ids.list.element"]
    assert ids and all(c.has_offset_index for c in columns)
    assert all(("RLE_DICTIONARY" in c.encodings) == (encoding == "dictionary") for c in ids)
    assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "doc_id")


def test_row_groups_pages_and_selective_reads(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("some other words "), 20)).alias("text"))
    token_files.write_token_files(docs.coalesce(1), str(tmp_path / "t"), PATH, 1, row_group_bytes=8_000, page_rows=100)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/t/tokens/*.parquet")]
    assert sum(f.num_row_groups for f in files) > len(files) * 2
    some = token_files.read_tokens(spark, str(tmp_path / "t"), F.col("doc_id").between(1000, 1009))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan
    assert sorted(r.doc_id for r in some.collect()) == list(range(1000, 1010))
    index = token_files.read_index(spark, str(tmp_path / "t"))
    assert "ids:array" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert index.agg(F.sum("n_tokens")).first()[0] == 4000 * 62 and index.agg(F.max("start")).first()[0] == 3999 * 62


def test_empty_table_and_damage(spark, odd_docs, tmp_path):
    token_files.write_token_files(odd_docs.limit(0), str(tmp_path / "e"), PATH, 1)
    assert token_files.token_digests(token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0
    token_files.write_token_files(odd_docs, str(tmp_path / "d"), PATH, 1)
    rows = spark.read.parquet(str(tmp_path / "d/tokens"))
    hurt = rows.withColumn("ids", F.when(F.col("doc_id") == 5, F.transform("ids", lambda x: x + 1)).otherwise(F.col("ids")))
    hurt.write.parquet(str(tmp_path / "h/tokens"))
    spark.read.parquet(str(tmp_path / "d/parts")).write.parquet(str(tmp_path / "h/parts"))
    assert [r.doc_id for r in token_files.damaged(spark, str(tmp_path / "h")).collect()] == [5]
    with pytest.raises(ValueError):
        token_files.write_token_files(odd_docs, str(tmp_path / "x"), PATH, 1, encoding="plain")
    assert not os.path.exists(tmp_path / "x")
