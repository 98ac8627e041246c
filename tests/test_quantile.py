"""Weighted quantiles against brute force, whatever the distribution and the cell size."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hearthstat.functions.deciles import PROBS
from hearthstat.operators import quantile as module
from hearthstat.operators.design import Design
from hearthstat.operators.interval import _t_cdf, _t_table, svy_quantile_ci
from hearthstat.operators.quantile import svy_quantile


def brute_force(x, w, probs):
    values = np.unique(x)
    cumulative = np.cumsum([w[x == v].sum() for v in values])
    return [values[np.argmax(cumulative >= p * cumulative[-1] * (1 - 1e-12))] for p in probs]


def frame(spark, x, w, g=None):
    data = {"x": np.asarray(x, float), "peso": np.asarray(w, float)}
    if g is not None:
        data["g"] = g
    return Design(spark.createDataFrame(pd.DataFrame(data)))


RNG = np.random.default_rng(7)
SHAPES = {
    "lognormal": RNG.lognormal(10, 1, 1500),
    "around zero": RNG.normal(0, 100, 1500).round(1),
    "a third on one value": np.where(RNG.random(1500) < 0.34, 1200.0, RNG.lognormal(7, 1, 1500)),
    "tiny": RNG.random(1500) * 1e-3,
    "close together": 1e6 + RNG.random(1500) * 1e-4,
    "constant": np.full(40, 7.0),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("rows_per_cell", [10**6, 20])
def test_against_brute_force(spark, name, rows_per_cell):
    x = SHAPES[name]
    w = RNG.random(len(x)) * 3
    g = RNG.choice(["a", "b", None], len(x), p=[0.9, 0.05, 0.05])
    design = frame(spark, x, w, g)
    rows = svy_quantile(design, "x", PROBS, rows_per_cell=rows_per_cell).collect()
    assert [r.quantile for r in sorted(rows, key=lambda r: r.p)] == brute_force(x, w, PROBS)
    rows = svy_quantile(design, "x", PROBS, ["g"], rows_per_cell=rows_per_cell).collect()
    found = {(r.g, r.p): r.quantile for r in rows}
    for level in ("a", "b", None):
        at = np.array([v == level for v in g])
        assert [found[(level, p)] for p in PROBS] == brute_force(x[at], w[at], PROBS)


def test_many_groups_without_local_tables(spark, monkeypatch):
    """The way taken when the groups are too many for a local table."""
    whole = module.local_rows
    monkeypatch.setattr(module, "local_rows", lambda df, *a, **k: whole(df, max_rows=5))
    x, w = RNG.lognormal(3, 1, 400), RNG.random(400)
    g = RNG.integers(0, 20, 400)
    rows = svy_quantile(frame(spark, x, w, g), "x", [0.25, 0.5], ["g"]).collect()
    found = {(r.g, r.p): r.quantile for r in rows}
    assert len(found) == 40
    for level in range(20):
        at = g == level
        assert [found[(level, p)] for p in (0.25, 0.5)] == brute_force(x[at], w[at], (0.25, 0.5))


def test_several_columns_with_own_probabilities(spark):
    x = RNG.lognormal(3, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": -x, "peso": np.ones(300)}))
    probs = spark.createDataFrame([("x", 0.25), ("x", 0.5), ("y", 0.5)], "variable string, p double")
    rows = svy_quantile(Design(df), ["x", "y"], probs).collect()
    found = {(r.variable, r.p): r.quantile for r in rows}
    ones = np.ones(300)
    assert found == {
        ("x", 0.25): brute_force(x, ones, [0.25])[0],
        ("x", 0.5): brute_force(x, ones, [0.5])[0],
        ("y", 0.5): brute_force(-x, ones, [0.5])[0],
    }


def test_partitioning_and_scale_do_not_matter(spark):
    x, w = RNG.lognormal(3, 1, 500), RNG.integers(1, 9, 500)
    design = frame(spark, x, w)
    expected = brute_force(x, w, PROBS)
    for d in (design, design.on(design.df.repartition(7)), frame(spark, x, w * 12.5)):
        rows = sorted(svy_quantile(d, "x", PROBS).collect(), key=lambda r: r.p)
        assert [r.quantile for r in rows] == expected


def test_infinities_and_empty_input(spark):
    design = frame(spark, [-np.inf, 1.0, 2.0, np.inf], [1, 1, 1, 1])
    rows = sorted(svy_quantile(design, "x", [0.25, 0.5, 0.75, 1.0]).collect(), key=lambda r: r.p)
    assert [r.quantile for r in rows] == [-np.inf, 1.0, 2.0, np.inf]
    empty = design.on(design.df.limit(0))
    assert [r.quantile for r in svy_quantile(empty, "x", [0.5]).collect()] in ([], [None])


def test_unknown_rule(spark):
    with pytest.raises(ValueError, match="rule"):
        svy_quantile(frame(spark, [1.0], [1.0]), "x", [0.5], rule="midpoint")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.floats(-1e9, 1e9, allow_nan=False).map(lambda v: v + 0.0), st.integers(1, 20)
        ),
        min_size=1,
        max_size=60,
    )
)
def test_any_values(spark, pairs):
    x, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], float)
    rows = svy_quantile(frame(spark, x, w), "x", [0.3, 0.5, 1.0], rows_per_cell=3).collect()
    assert [r.quantile for r in sorted(rows, key=lambda r: r.p)] == brute_force(x, w, [0.3, 0.5, 1.0])


def test_t_quantiles():
    # Published two-sided 5 % points.
    table = _t_table(0.975)
    for df, value in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (30, 2.0423), (100, 1.9840)):
        assert table[df - 1] == pytest.approx(value, abs=1e-4)
    assert _t_cdf(2.0, 1) == pytest.approx(0.5 + np.arctan(2.0) / np.pi)


def test_interval_surrounds_the_quantile(spark):
    n = 600
    df = spark.createDataFrame(
        pd.DataFrame(
            {
                "x": RNG.lognormal(3, 1, n),
                "peso": RNG.random(n) + 0.5,
                "estrato_pof": RNG.integers(0, 5, n),
                "cod_upa": RNG.integers(0, 40, n),
                "g": RNG.integers(0, 2, n),
            }
        )
    )
    whole = svy_quantile_ci(Design(df), "x", [0.25, 0.5]).collect()
    grouped = svy_quantile_ci(Design(df), "x", [0.25, 0.5], ["g"]).collect()
    assert len(whole) == 2 and len(grouped) == 4
    for r in whole + grouped:
        assert r.ci_low < r.quantile < r.ci_high and r.se > 0


def test_nan_counts_as_missing(spark):
    d = frame(spark, [1.0, 2.0, float("nan"), 4.0], [1, 1, 1, 1])
    assert svy_quantile(d, "x", [0.5]).first().quantile is None
    assert svy_quantile(d, "x", [0.5], na_rm=True).first().quantile == 2.0


def test_a_row_for_each_probability(spark):
    d = frame(spark, [1.0, 2.0, 3.0], [1, 1, 1], ["a", "a", "b"])
    assert [(r.p, r.quantile) for r in svy_quantile(d, "x", [0.5, 0.1, 0.5]).collect()] == [(0.5, 2.0), (0.1, 1.0), (0.5, 2.0)]
    grouped = svy_quantile(d, "x", [0.5, 0.5], ["g"]).collect()
    assert sorted((r.g, r.quantile) for r in grouped) == [("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)]
    empty = d.on(d.df.limit(0))
    assert [(r.p, r.quantile) for r in svy_quantile(empty, "x", [0.1, 0.5]).collect()] == [(0.1, None), (0.5, None)]


def test_many_groups_are_refined_to_the_end(spark, monkeypatch):
    """More groups than a local table may have, and one with many values in a small range."""
    monkeypatch.setattr(module.local_rows, "__defaults__", (20, False))
    rng, seen = np.random.default_rng(3), []
    hot = 1e6 + rng.random(3000) * 1e-5
    x, g = np.concatenate((hot, rng.random(400))), np.concatenate((np.zeros(3000), np.repeat(np.arange(1, 41), 10)))
    refine = module._refine
    monkeypatch.setattr(module, "_refine", lambda *a: seen.append(1) or refine(*a))
    d = frame(spark, x, np.ones(len(x)), g.astype(int))
    found = {r.g: r.quantile for r in svy_quantile(d, "x", [0.5], ["g"], rows_per_cell=5).collect()}
    assert all(found[k] == brute_force(x[g == k], np.ones((g == k).sum()), [0.5])[0] for k in range(41))
    assert len(seen) >= 1


def test_the_widest_doubles(spark):
    x = [-1.7e308, -1e308, 1e308, 1.7e308]
    assert svy_quantile(frame(spark, x, [1, 1, 1, 1]), "x", [0.5], rows_per_cell=1).first().quantile == -1e308


def test_the_whole_from_the_cells_of_its_groups(spark):
    """One more level of all rows equals a run on all rows, also through refinements, and no row is doubled."""
    rows = [(i % 4 if i % 9 else None, float((i * 7919) % 500) - 100 if i % 31 else 42.0, 1.0 + i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, x double, peso double").selectExpr("*", "1 as cod_upa", "1 as estrato_pof", "2 * x as y")
    design = Design(df)
    for per_cell in (1_000_000, 50):
        both = svy_quantile(design, ["x", "y"], [0.1, 0.5], ["g"], whole=99, rows_per_cell=per_cell).collect()
        alone = svy_quantile(design, ["x", "y"], [0.1, 0.5], rows_per_cell=per_cell).collect()
        groups = svy_quantile(design, ["x", "y"], [0.1, 0.5], ["g"], rows_per_cell=per_cell).collect()
        want = {(99, r.variable, r.p): r.quantile for r in alone} | {(r.g, r.variable, r.p): r.quantile for r in groups}
        assert {(r.g, r.variable, r.p): r.quantile for r in both} == want and len(both) == len(want)
    with pytest.raises(ValueError, match="one group column"):
        svy_quantile(design, "x", [0.5], whole=99)


def test_interval_by_brute_force(spark, space):
    """Quantile, limits and error against plain Python, by group, where values repeat."""
    import math
    import random

    rnd = random.Random(11)
    rows = [(rnd.randrange(2), h, rnd.randrange(1, 4), float(rnd.randrange(0, 60)) ** 2 / 7, 1.0 + rnd.randrange(3)) for h in range(6) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, estrato_pof int, cod_upa int, gasto double, peso double")
    found = {(r.g, r.p): r for r in svy_quantile_ci(Design(df), "gasto", [0.25, 0.5], ["g"]).collect()}
    everyone = {r.p: r for r in svy_quantile_ci(Design(df), "gasto", [0.25, 0.5]).collect()}

    def reach(mine, p):
        total = sum(w for *_, w in mine)
        values = sorted({x for *_, x, _ in mine})
        share = lambda x: sum(w for *_, v, w in mine if v <= x) / total
        at = lambda s: next(x for x in values if share(x) >= s * (1 - 1e-12))
        q = at(p)
        f = share(q)
        psus = {}
        for _, h, i, x, w in mine:
            psus[h, i] = psus.get((h, i), 0.0) + w * ((x <= q) - f) / total
        variance = 0.0
        for h in {h for h, _ in psus}:
            z = [v for (k, _), v in psus.items() if k == h]
            mean = sum(z) / len(z)
            variance += len(z) / (len(z) - 1) * sum((v - mean) ** 2 for v in z)
        t = TEXTBOOK_T[len(psus) - len({h for h, _ in psus})]
        low, high = at(max(p - t * math.sqrt(variance), 0)), at(min(p + t * math.sqrt(variance), 1))
        return q, low, high, (high - low) / (2 * t)

    for p in (0.25, 0.5):
        for r, mine in [(found[g, p], [x for x in rows if x[0] == g]) for g in (0, 1)] + [(everyone[p], rows)]:
            q, low, high, se = reach(mine, p)
            assert (r.quantile, r.ci_low, r.ci_high) == (q, low, high) and r.se == pytest.approx(se, rel=1e-4)


# Two-sided 95 percent points of Student's distribution.
TEXTBOOK_T = {1: 12.706, 2: 4.3027, 5: 2.5706, 10: 2.2281, 12: 2.1788, 20: 2.0860, 30: 2.0423, 60: 2.0003, 120: 1.9799}


def test_textbook_t_values(spark):
    from checks.oracles import student_t
    from hearthstat.operators.interval import t_quantile

    table = spark.createDataFrame([(df,) for df in TEXTBOOK_T], "df int")
    for r in table.select("df", t_quantile(0.975, F.col("df")).alias("t")).collect():
        assert r.t == pytest.approx(TEXTBOOK_T[r.df], abs=6e-5 if r.df > 1 else 6e-4)
        assert student_t(r.df) == pytest.approx(r.t, rel=1e-9)
