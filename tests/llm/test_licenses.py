"""Licence digests: the table itself, and the same rows from SQL."""

import duckdb
from pyspark.sql import functions as F

from hearthstat.llm import licenses


def test_every_known_text_bears_a_mark(spark):
    assert all(any(m in text.lower() for m in licenses.MARKS) for _, text in licenses.KNOWN)


def test_variants_match_and_sql_agrees(spark, odd_rows):
    mit = dict((n, t) for n, t in licenses.KNOWN[:1])["MIT"]
    texts = [t for _, t in odd_rows]
    texts += [mit, mit.upper().replace("\n\n", "\n"), "Copyright (c) 2019 A. Person\n" + mit.replace("sublicense", "sub-licence"), mit + " no", "x\nReleased under the MIT Licence!\ny", "  licensed under cc by 4.0  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = licenses.license_matches(docs).collect()
    assert {(r.doc_id - 11, r.unit, r.line, r.license) for r in rows} == {
        (0, "text", None, "MIT"), (1, "text", None, "MIT"), (2, "text", None, "MIT"),
        (4, "line", 1, "MIT"), (5, "text", None, "CC-BY-4.0"), (5, "line", 0, "CC-BY-4.0"),
    }
    con = duckdb.connect()
    documents = docs.toArrow()
    con.register("documents", documents)
    same = con.execute(licenses.license_sql()).fetchall()
    assert sorted(map(str, same)) == sorted(str(tuple(r)) for r in rows)


def test_no_python_in_the_plan(spark, odd_docs):
    plan = licenses.license_matches(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[doc_id", "")
    assert licenses.license_matches(odd_docs.filter(F.lit(False))).count() == 0
