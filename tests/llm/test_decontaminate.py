"""Benchmark decontamination: exact distances, recall on edited items, clean texts."""

import random

import numpy as np
import pytest

from hearthstat.llm import decontaminate

from .conftest import column, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_to_the_best_stretch():
    rnd = random.Random(1)
    for _ in range(150):
        a = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 9))).encode()
        b = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 11))).encode()
        best = min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.edit_distance_within(a, b) == best


def edited(rnd, text, rate):
    out = []
    for c in text:
        u = rnd.random()
        if u >= rate / 3:
            out.append(rnd.choice("etaoinsh") if u < 2 * rate / 3 else c)
        if 2 * rate / 3 <= u < rate:
            out.append(rnd.choice("etaoinsh"))
    return "".join(out)


def replaced(rnd, text, rate):
    """All edits in one place."""
    n = int(len(text) * rate)
    at = rnd.randrange(len(text) - n + 1)
    return text[:at] + "".join(rnd.choice("etaoinsh ") for _ in range(n)) + text[at + n :]


def recall(index, texts, ids):
    """Share of the items found among those that brute force finds within the limit."""
    found, within = [], []
    for item_id, text, matches in zip(ids, texts, index.matches(column(texts))):
        item = index.items[index.ids.index(item_id)]
        raw = np.frombuffer(text.encode(), np.uint8)
        near = decontaminate.edit_distance_within(item, decontaminate.plain(np.array([0, len(raw)]), raw)[1].tobytes())
        limit = int(decontaminate.ERRORS * len(item))
        within.append(near <= limit)
        found.append(any(index.ids[k] == item_id for k in matches))
        assert all(d <= limit for k, d in matches.items() if index.ids[k] == item_id)
    return np.mean(np.array(found)[within])


@pytest.mark.parametrize("edit", (edited, replaced))
@pytest.mark.parametrize("rate, least", ((0.0, 1.0), (0.05, 0.95), (0.1, 0.95), (0.15, 0.9), (0.18, 0.9)))
def test_recall_over_the_whole_limit(edit, rate, least):
    rng, rnd = np.random.default_rng(3), random.Random(3)
    items = [(i, prose(rng, int(rng.integers(15, 55)))) for i in range(80)]
    texts = [prose(rng, 60) + " " + edit(rnd, t, rate).upper() + ", " + prose(rng, 60) for _, t in items]
    assert recall(decontaminate.Index(items), texts, [i for i, _ in items]) >= least


def test_recall_of_short_items_and_of_items_run_into_text():
    rng, rnd = np.random.default_rng(5), random.Random(5)
    short = [(i, prose(rng, 9)[:60].strip()) for i in range(80)]
    short = [(i, t) for i, t in short if len(t) > decontaminate.SHORT]
    texts = [prose(rng, 40) + " " + edited(rnd, t, 0.1) + " " + prose(rng, 40) for _, t in short]
    assert recall(decontaminate.Index(short), texts, [i for i, _ in short]) >= 0.9
    items = [(i, prose(rng, 30)) for i in range(40)]
    texts = [prose(rng, 40) + t + prose(rng, 40) for _, t in items]
    assert recall(decontaminate.Index(items), texts, [i for i, _ in items]) == 1
    marks = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200)) for _ in range(20)]
    items = [(i, t[70:120]) for i, t in enumerate(marks)]
    assert recall(decontaminate.Index(items), marks, [i for i, _ in items]) == 1


def test_clean_texts_and_one_text_for_many_items():
    rng = np.random.default_rng(3)
    items = [(i, prose(rng, int(rng.integers(15, 55)))) for i in range(40)]
    clean = [prose(rng, 200) for _ in range(100)]
    assert not any(decontaminate.Index(items).matches(column(clean)))
    common = prose(rng, 25)
    alike = [(i, f"{common} {prose(rng, 2)}") for i in range(50)]
    text = f"{prose(rng, 30)} {common} {prose(rng, 30)}"
    (found,) = decontaminate.Index(alike).matches(column([text]))
    plain = text.encode()
    assert set(found) == {i for i, (_, t) in enumerate(alike) if decontaminate.edit_distance_within(t.encode(), plain) <= len(t) // 5}


def test_rows_in_spark(spark, odd_docs, odd_rows):
    rng = np.random.default_rng(4)
    item = prose(rng, 30)
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only one"), (5, item), (None, "!?")], "item_id int, text string")
    docs = odd_docs.unionByName(odd_docs.limit(1).selectExpr("77L doc_id", f"'{prose(rng, 50)} {item} {prose(rng, 5)}' text", "lang", "source", "n_chars", "length", "uid", "node", "_task"))
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert found == {(77, 1, 0), (77, 5, 0), (None, 4, 0)}
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows) - 1
    assert decontaminate.contamination(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), benchmark).count() == 0


def test_agreement_counts_and_early_ends_change_no_verdict():
    rng = np.random.default_rng(3)
    one, other = rng.integers(0, 3, (2, 500, decontaminate.CHECKED), dtype=np.uint8)
    other[0] = one[0]
    assert decontaminate._agreeing(one, other).tolist() == (one == other).sum(axis=1).tolist()
    items = [(i, prose(rng, 40)) for i in range(6)]
    index = decontaminate.Index(items)
    data = np.frombuffer((" " + " ".join([t[7:] for _, t in items] + [prose(rng, 300)]) + " ").encode(), np.uint8)
    starts, entries = (x.ravel() for x in np.meshgrid(decontaminate.window_starts(data)[:-1], np.arange(len(index.owner))))
    far = []

    def take(a, at):
        return int(a[min(max(at, 0), len(a) - 1)])

    for start, entry in zip(starts.tolist(), entries.tolist()):
        item, place = int(index.owner[entry]), int(index.place[entry])
        here, size, same = int(index.begin[item]) + place, int(index.sizes[item]), 0
        for way, steps, x, y in ((1, 2 * (size - place), start, here), (-1, 2 * place, start - 1, here - 1)):
            for t in range(steps):
                a, b = take(data, x), take(index.text, y)
                same += a == b
                x, y = x + way * int(index.far[t][a]), y + way * int(index.far[t][b])
        far.append(same / (2 * size))
        if len(far) == 400:
            break
    far = np.array(far)
    found = index._agreement(data, starts[: len(far)], entries[: len(far)])
    assert ((found >= decontaminate.WHOLE) == (far >= decontaminate.WHOLE)).all()
    assert (found[far >= decontaminate.WHOLE] == far[far >= decontaminate.WHOLE]).all() and (far >= decontaminate.WHOLE).any()
    assert (found < far).any()  # a walk that cannot reach the limit ends early


def test_two_steps_of_a_walk_are_taken_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    index = decontaminate.Index([(1, prose(rng, 20))])
    text = rng.integers(0, 256, 300, dtype=np.uint8)
    starts = np.array([0, 3, 3, 150, 250, 299, 400])
    want = np.empty((decontaminate.WALKS * decontaminate.STEPS, len(starts)), np.uint8)
    for i, start in enumerate(starts.tolist()):
        for w in range(decontaminate.WALKS):
            at = start
            for t in range(decontaminate.STEPS):
                want[w * decontaminate.STEPS + t, i] = byte = text[min(at, len(text) - 1)]
                at += int(index.moves[w, t, byte])
    takes, take = [], np.take
    monkeypatch.setattr(np, "take", lambda *a, **k: takes.append(1) or take(*a, **k))
    assert (index.embedded(text, starts) == want).all()
    assert len(takes) <= decontaminate.WALKS * decontaminate.STEPS
    assert index.embedded(text, starts[:0]).shape == (len(want), 0)
