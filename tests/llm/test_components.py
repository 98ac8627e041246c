"""Connected components, broadcast and shuffled rounds, against a search by hand."""

import numpy as np
import pytest

from hearthstat.llm import components as module


def by_hand(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def shapes():
    rng = np.random.default_rng(31)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(200 + i, 200) for i in range(1, 60)] + [(900 - i, 900) for i in range(1, 60)]
    mixed = [tuple(map(int, rng.integers(-300, 0, 2))) for _ in range(150)]
    return path[::-1] + star + mixed + [(5, 5), (1, 2), (2, 1), (1, 2)]


@pytest.mark.parametrize("local_rows", [50_000, 0])
def test_both_kinds_of_rounds(spark, monkeypatch, local_rows):
    monkeypatch.setattr(module, "LOCAL_ROWS", local_rows)
    found = module.components(spark.createDataFrame(shapes(), "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == by_hand(shapes())


def test_a_round_of_few_edges_has_few_shuffles_and_tasks(spark, monkeypatch):
    """The driver keeps a record of each task of each stage, so rounds on little data must have few."""
    rounds, parts, whole = [], [], module.staged

    def planned(df, name, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        rounds.append(sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines()))
        out = whole(df, name, **options)
        parts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "staged", planned)
    # Reused exchanges show before the run; tables are not small by Spark's own measure.
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "30"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = module.components(spark.createDataFrame(shapes(), "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in found} == by_hand(shapes())
    assert len(rounds) > 2 and max(rounds[1:]) <= 3 and max(parts[1:]) == 1, (rounds, parts)
