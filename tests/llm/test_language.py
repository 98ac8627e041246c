"""Language identification on held-out texts, and odd rows."""

import numpy as np

from hearthstat.llm import language

PARTS = {"x": "the of and ing tion er".split(), "y": "der und sch ung keit ü".split(), "z": "que de la eux é ou".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(PARTS[lang], rng.integers(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_und(spark, odd_docs):
    rng = np.random.default_rng(6)
    rows = [(i, text(rng, "xyz"[i % 3], 5 + i % 40), "xyz"[i % 3]) for i in range(600)]
    train = spark.createDataFrame([*rows[:300], (None, None, "x"), (1, "text", None), (2, "123", "y")], "doc_id long, text string, lang string")
    test = spark.createDataFrame(rows[300:], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(test, train).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows[300:]]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = language.identify(odd_docs, train).collect()
    assert len(odd) == 11
    kernel = language.fit([(t, lang) for _, t, lang in rows[:100]])
    texts = [None, "", "12 !?", "\n", "der und"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = [r.p.lang_pred for r in docs.select(language.predict("text", kernel).alias("p")).collect()]
    assert names[:4] == ["und"] * 4 and names[4] in PARTS


def test_without_labels(spark, odd_docs):
    none = language.identify(odd_docs, odd_docs.limit(0)).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}
    assert language.identify(odd_docs.limit(0), odd_docs).count() == 0


def test_similarity_is_the_presence_kernel():
    kernel = language.fit([("abc abd", "x"), ("abc", "y")], landmarks=2)
    grams = lambda t: {f" {t} "[i : i + n] for n in language.N_GRAMS for i in range(len(t) + 3 - n)}
    texts = ["abd", "cab"]
    folded = [np.array([0, *map(ord, t), 0]) for t in texts]
    want = [[len(grams(t) & grams(m)) / np.sqrt(len(grams(t)) * len(grams(m))) for m in ("abc abd", "abc")] for t in texts]
    assert np.allclose(kernel.similarity(folded), want)
