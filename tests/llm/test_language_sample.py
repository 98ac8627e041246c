"""The labelled sample when texts are repeated or have no letter."""

from hearthstat.llm import language


def test_copies_and_letterless_texts_take_no_places(spark):
    rows = [(f"text number {i}", "x") for i in range(30)] + [(f"copied {c}", "x") for c in "abc" for _ in range(200)]
    rows += [(f"{i} !", "x") for i in range(300)] + [("copied a", "y"), ("Ω", "y"), ("", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    sample = language.labelled_sample(docs, "text", "lang", 33)
    assert len(sample) == len(set(sample)) == 35
    assert {t for t, lang in sample if lang == "x"} == {t for t, lang in rows if lang == "x" and any(c.isalpha() for c in t)}
    assert {t for t, lang in sample if lang == "y"} == {"copied a", "Ω"}
