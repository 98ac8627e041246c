"""Whole licence texts, identifiers, and tables of the caller's own."""

from hearthstat.llm import licenses


def test_every_text_of_the_package_bears_a_mark():
    assert all(any(m in text.lower() for m in licenses.MARKS) for _, text in licenses.package_texts())


def test_whole_licences_and_identifiers(spark):
    whole = [(n, t) for n, t in licenses.package_texts() if len(t) > 800 and (n, t) not in licenses.KNOWN]
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0"} <= {n for n, _ in whole}
    texts = [(n, "Copyright (c) 2020 A. Person\n" + t.replace("\n", "\n  ").upper()) for n, t in whole]
    texts += [(n, f"# SPDX-License-Identifier: {n}") for n in ("MPL-2.0", "GPL-3.0-or-later", "AGPL-3.0-only")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    rows = licenses.license_matches(docs).filter("unit = 'text'").collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(i, n) for i, (n, _) in enumerate(texts)]


def test_own_table_without_marks(spark):
    known = spark.createDataFrame([("own", "Use it as you like."), ("own", " "), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "x\nUSE IT, as you like!"), (2, "Released under the MIT License."), (3, ""), (4, None)], "doc_id int, text string")
    found = licenses.license_matches(docs, known=known).collect()
    assert [(r.doc_id, r.unit, r.line, r.license) for r in found] == [(1, "line", 1, "own")]
