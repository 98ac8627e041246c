"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import os

import corpus_pipeline
import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
from checks.compare import database, difference
from hearthstat.llm.queries import QUERIES, SQL, table

from .test_jaccard_join import brute
from .test_suffix_dedup import covered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", SQL)
def test_equal_to_sql(spark, name):
    found = difference(driver.queries()[name](spark, SF_DIR), database(SF_DIR).execute(SQL[name]))
    assert found in (None, "no rows")


def test_language_is_right_on_held_out_documents(spark):
    docs = dict(duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF_DIR}/documents.parquet' WHERE length(text) > 50").fetchall())
    rows = [r for r in driver.queries()["op9_language_id"](spark, SF_DIR).collect() if r.held_out and docs.get(r.doc_id)]
    assert sum(r.lang_pred == docs[r.doc_id] for r in rows) > 0.95 * len(rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF_DIR)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
            assert all(after[i] == before[i] for i in after)
            good = [i for i in before if labels.get(i) == 1 and len(before[i].text.split()) >= 50]
            assert sum(i in after for i in good) > 0.95 * len(good)
        if k == 1:
            assert set(after) == {c for _, _, c in brute([(i, r.text) for i, r in before.items()], 80, 5)}
        if k == 2:
            ids = list(before)
            gone = covered([before[i].text.encode() for i in ids], 101)
            for i, g in zip(ids, gone):
                raw = before[i].text.encode()
                edges = np.flatnonzero(np.diff(np.concatenate(([0], list(g), [0]))))
                long = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= 400 or len(raw[a:b].split()) > 50]
                kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in long)], [*(a for a, _ in long), len(raw)]))
                assert after[i].text == (kept.decode("utf-8", "ignore") if long else before[i].text)
        if k == 3:
            plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
            items = [plain(r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
            leaked = {i for i, r in before.items() if any(x in plain(r.text) for x in items)}
            assert leaked.isdisjoint(after) and len(before) - len(after) <= len(leaked) + 2
        if k == 4:
            assert set(after) == set(before)
