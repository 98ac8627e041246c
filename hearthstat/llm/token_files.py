"""Token ids as Parquet list columns, written in id order and read selectively.

A folder holds ``tokens``, one row for each document in ascending order of ids, and ``parts``,
a row for each written partition with the number of ids before it.  Spark's own Parquet
writer is steered by its options: ids as a dictionary or in delta encoding, ids of documents
and running numbers in delta encoding (they ascend), row groups of a chosen size and pages of
a chosen number of rows, with page indexes.  So

- the metadata (``read_index``) is read without touching a page of ids, and
- the ids of some documents (``read_tokens`` with a condition) without the row groups and pages
  that cannot hold them.

``start`` counts the ids of all documents before one.  A task knows those of its own
partition; the rest is a running sum over ``parts``, of one row for each partition.

Texts are encoded by ``tokenizers``.  A worker cuts a text at white space and behind ASCII
letters, where the vocabulary's own splitting always cuts too, and asks ``tokenizers`` once for
each new piece.

Defined results: NULL text is the empty text, which holds the end id only; documents with equal
ids stand in the order of a hash of their texts, equal rows in any; NULL ids come first; other
columns are kept only as asked, inside the column ``meta``, so their names cannot clash; an
empty table gives folders without rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hearthstat.operators.numbering import starts
from hearthstat.workspace import hint_if, local_if_small

from .arrays import SEPARATOR, prefix_sums, span_hashes
from .encode import Encoder

ENCODINGS = ("dictionary", "delta")
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 1000
PIECES_AT_ONCE = 500

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BEHIND = np.zeros(256, bool)  # ASCII that ends a run of letters
_BEHIND[:128] = ~_LETTER[:128]


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that are encoded alone, and each row's first one."""
    n = len(data)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= _LETTER[data[:-1]] & _BEHIND[data[1:]]
    before = edge[:n].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    begins = np.flatnonzero(inside & before)
    return begins, np.flatnonzero(inside & after) + 1, np.searchsorted(begins, offsets)


class PieceEncoder(Encoder):
    """Ids of whole columns by a vocabulary with word ends that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark divides the work
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        suffix = model["model"]["end_of_word_suffix"]
        vocabulary = self.whole.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self._clear()

    def _slice(self, offsets, data):
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return _flat(found), np.concatenate(([0], np.cumsum([len(x) for x in found])))
        begins, ends, firsts = pieces(offsets, data)
        hashes = span_hashes(prefix_sums(data, False), begins, ends)
        if self.pieces > self.mask // 4:
            self._clear()
        slots = self._find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            values, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.pieces + len(values) > self.mask // 2:  # a text of very many pieces
                self._clear(4 * len(values))
                return self._slice(offsets, data)
            at = new[first]
            self._learn_all(values, [raw[a:b].decode() for a, b in zip(begins[at].tolist(), ends[at].tolist())])
            slots[new] = self._find(values)[back]
        counts, begin = self.count[slots], self.begin[slots]
        total = np.concatenate(([0], np.cumsum(counts)))
        at = np.arange(total[-1]) + np.repeat(begin - total[:-1], counts)
        return self.ids[at], total[firsts]

    def _learn_all(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new pieces and file their ids under their hashes."""
        ids, counts = self._encoded(texts)
        n = len(texts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.pieces + n > len(self.begin):
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        mine = slice(self.pieces, self.pieces + n)
        self.begin[mine], self.count[mine] = self.used + np.cumsum(counts) - counts, counts
        slot, open_ = np.arange(self.pieces, self.pieces + n, dtype=np.int32), np.arange(n)
        place = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(open_):  # one piece takes a free place, others that want it go on
            taken, winner = np.unique(np.where(self.slots[place] < 0, place, -1), return_index=True)
            winner = winner[taken >= 0]
            self.keys[place[winner]], self.slots[place[winner]] = hashes[open_[winner]], slot[open_[winner]]
            rest = np.ones(len(open_), bool)
            rest[winner] = False
            open_, place = open_[rest], (place[rest] + (self.slots[place[rest]] >= 0)) & self.mask
        self.pieces += n
        self.used += len(ids)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        # Letters alone are one word each, so many of them may share a line.
        plain = np.array([t.isalpha() for t in texts], bool)
        out: list = [None] * len(texts)
        where = np.flatnonzero(plain)
        groups = [where[i : i + PIECES_AT_ONCE] for i in range(0, len(where), PIECES_AT_ONCE)]
        lines = self.whole.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        alone = np.flatnonzero(~plain).tolist()
        for group, line in zip(groups, lines):
            ids = np.array(line.ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):  # a letter that this vocabulary splits off
                alone += group.tolist()
                continue
            for i, a, b in zip(group.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                out[i] = ids[a:b]
        for i, e in zip(alone, self.whole.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.int32)
        return _flat(out), np.array([len(x) for x in out], np.int64)


def _flat(found) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in found)])


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary in a worker process."""
    return PieceEncoder(path)


def _crc32(ids: np.ndarray, begins: np.ndarray) -> list[int]:
    """CRC-32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<i4").tobytes())
    edges = (4 * begins).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta: Sequence[str] = (),
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write the ids of each text and ``end_id`` to the new folder ``path``, in ascending order of ``id_col``.

    ``tokens`` has ``doc_id``, ``part``, ``start_in_part``, ``n_tokens``, ``ids_crc32``, ``ids``
    and, if asked for, ``meta``.  Reading needs ``parts``, which is written last.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")]
    if meta:
        columns.append(F.struct(*meta).alias("meta"))
    rows = docs.select(*columns)
    encoded = _encode(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text"), vocabulary, end_id)
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    for key, value in {
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start_in_part", "ids_crc32")},
    }.items():
        writer = writer.option(key, value)
    writer.parquet(f"{path}/tokens")
    written = spark.read.schema(encoded.schema).parquet(f"{path}/tokens")
    parts = written.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"), F.count(F.lit(1)).alias("documents"))
    starts(parts, ["part"], "ids_in_part", "part_start").write.parquet(f"{path}/parts")


def _encode(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    kept = rows.schema.fields[2:]
    numbers = [T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start_in_part", "n_tokens", "ids_crc32"))]
    schema = T.StructType([rows.schema["doc_id"], *numbers, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *kept])
    names = schema.names

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row, _, _, ids, first in piece_encoder(vocabulary).slices(batch.column(1)):
                n = len(first) - 1
                begins = first + np.arange(n + 1)
                ids = np.insert(ids, first[1:], end_id).astype(np.int32)
                columns = [
                    batch.column(0).slice(row, n),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(before + begins[:-1]),
                    pa.array(np.diff(begins)),
                    pa.array(_crc32(ids, begins), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids)),
                    *(batch.column(2 + i).slice(row, n) for i in range(len(kept))),
                ]
                before += int(begins[-1])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(encode, schema)


def _tokens(spark: SparkSession, path: str, where: Column | None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/tokens")
    if where is not None:
        rows = rows.filter(where)
    parts, small = local_if_small(spark.read.parquet(f"{path}/parts").select("part", "part_start"))
    joined = rows.join(hint_if(parts, small), "part")
    return joined.withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part", "part_start", "start_in_part")


def read_index(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, [meta,] start``, without a page of ids being read."""
    return _tokens(spark, path, where).drop("ids")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids, [meta,] start``; only pages that may hold rows of ``where``."""
    return _tokens(spark, path, where)


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` counted anew from the ids."""
    rows = tokens.select("doc_id", "start", "ids")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    names = schema.names

    def digest(batches):
        for batch in batches:
            ids = batch.column(2)
            begins = ids.offsets.to_numpy().astype(np.int64)
            values = ids.values.to_numpy()[begins[0] : begins[-1]]
            crcs = pa.array(_crc32(values, begins - begins[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(begins)), crcs], names=names)

    return rows.mapInArrow(digest, schema)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Documents whose stored ids no longer are those that were written."""
    rows = _tokens(spark, path, None)
    held = rows.select(F.struct("doc_id", "n_tokens", "ids_crc32").alias("doc_id"), "start", "ids")
    found = token_digests(held)
    same = (F.col("doc_id.n_tokens") == F.col("n_tokens")) & (F.col("doc_id.ids_crc32") == F.col("ids_crc32"))
    return found.filter(~same).select(F.col("doc_id.doc_id").alias("doc_id"), "start")
