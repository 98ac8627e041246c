"""SQL twins of the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

import functools
import math

# Added before rounding, here and in the queries: means over whole-number weights often lie
# exactly between two rounded values, where the last bit of a sum would decide.
OFFSET = 1.23e-6

FUEL = ", ".join(str(c) for c in range(2300001, 2300006))
PUBLIC = ", ".join(str(c) for c in range(2300006, 2300038))
CODES = {"fuel": FUEL, "public": PUBLIC, "all": f"{FUEL}, {PUBLIC}"}

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
FAMILY = """
    c_nationkey AS estrato_pof, c_nationkey % 5 AS uf,
    CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_custkey % 4 END AS cod_upa,
    c_custkey AS num_dom,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 3 + 1 END AS num_uc,
    CAST(1 + c_custkey % 7 AS DOUBLE) AS peso,
    CAST((1 + c_custkey % 7) * (1 + c_nationkey % 3) AS DOUBLE) AS peso_final,
    c_acctbal AS renda_total"""
CONDITIONS = f"""conditions AS (
  SELECT c_custkey AS household, {FAMILY}, c_custkey % 5 AS v61058, c_mktsegment AS pos_estrato
  FROM customer)"""
ITEMS = f"""items AS (
  SELECT o_custkey AS household, {ORDER}, {FAMILY},
    2300000 + l_partkey % 40 AS v9001, l_extendedprice AS v8000_defla,
    CASE WHEN l_partkey % 2 = 0 THEN 12 ELSE 4 END AS fator_anualizacao,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber END AS v9011,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(1 AS DOUBLE) + l_discount END AS deflator,
    l_linenumber AS cod_informante
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
VALUED = """valued AS (
  SELECT *,
    CASE WHEN v9011 IS NULL THEN v8000_defla * fator_anualizacao
         ELSE v8000_defla * fator_anualizacao * v9011 END AS gasto,
    CASE WHEN deflator IS NULL THEN renda_total * 12
         ELSE renda_total * 12 * deflator END AS renda_anual
  FROM items)"""
PROBS = """probs AS (
  SELECT CAST(0.1 AS DOUBLE) + k * CAST(0.1 AS DOUBLE) AS p, k + 1 AS k FROM range(10) t(k))"""
MEDIAN = "(SELECT CAST(0.5 AS DOUBLE) AS p)"
FIXED = (1232.61, 1697.72, 2227.73, 2706.64, 3323.68, 4098.24, 5239.78, 6944.56, 10941.71)
DIM = """dim AS (
  SELECT CAST(k AS INTEGER) AS decil, CAST(k AS VARCHAR) || 'º Decil' AS label
  FROM range(1, 11) t(k))"""


def base(codes: str, plus: str = "") -> str:
    return f"""{ITEMS}, {VALUED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY household ORDER BY {ORDER}) AS rn,
    sum(gasto) OVER (PARTITION BY household) AS total
  FROM valued WHERE v9001 IN ({CODES[codes]})),
base AS (
  SELECT household, total {plus} AS gasto_total, renda_anual, estrato_pof, uf, cod_upa,
    peso, peso_final, c_mktsegment AS pos_estrato
  FROM ranked JOIN customer ON household = c_custkey WHERE rn = 1)"""


def quantile(name: str, src: str, x: str, probs: str, by: str = "") -> str:
    """CTE ``name(by, p, q)``: smallest x whose cumulative weight reaches p."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{name}_v AS (SELECT {g}{x} AS x, sum(peso) AS w FROM {src} GROUP BY {g}{x}),
{name}_c AS (SELECT *, sum(w) OVER ({part} ORDER BY x) AS cw, sum(w) OVER ({part}) AS tw
  FROM {name}_v),
{name} AS (SELECT {g}p, min(x) AS q FROM {name}_c CROSS JOIN {probs}
  WHERE cw >= p * tw * (1 - CAST(1e-12 AS DOUBLE)) GROUP BY {g}p)"""


def decile_case(x: str, cut) -> str:
    arms = [f"WHEN {x} >= 0 AND {x} <= {cut(1)} THEN 1"]
    arms += [f"WHEN {x} > {cut(k - 1)} AND {x} <= {cut(k)} THEN {k}" for k in range(2, 10)]
    return "CASE " + " ".join(arms) + f" WHEN {x} > {cut(9)} THEN 10 END"


def with_deciles(codes: str, plus: str = "") -> str:
    """CTEs up to ``dec``: households with their income decile."""
    return f"""{base(codes, plus)}, {PROBS}, {quantile("cutq", "base", "renda_anual", "probs")},
cuts AS (SELECT {", ".join(f"max(CASE WHEN k = {k} THEN q END) AS c{k}" for k in range(1, 10))}
  FROM cutq JOIN probs USING (p)),
dec AS (SELECT base.*, {decile_case("renda_anual", lambda k: f"c{k}")} AS decil
  FROM base CROSS JOIN cuts)"""


FIXED_DECILE = decile_case("renda_total", lambda k: f"CAST({FIXED[k - 1]} AS DOUBLE)")
CONDITIONS_DEC = f"{CONDITIONS}, dec AS (SELECT *, {FIXED_DECILE} AS decil FROM conditions)"

TRANSPORT = with_deciles("all", "+ 1")
NATIONAL_MEDIAN = quantile("med", "dec", "gasto_total", MEDIAN)
OWN = f"""{quantile("own", "(SELECT * FROM dec WHERE decil IS NOT NULL)", "gasto_total", MEDIAN, "decil")},
thr AS (SELECT dec.*, own.q AS threshold FROM dec JOIN own USING (decil))"""
BELOW = f"""{TRANSPORT}, {NATIONAL_MEDIAN},
low AS (SELECT dec.*, q - gasto_total AS gap FROM dec CROSS JOIN med WHERE gasto_total < q)"""
POOR = f"""{TRANSPORT}, {NATIONAL_MEDIAN},
poor AS (SELECT dec.*, q / 2 - gasto_total AS gap FROM dec CROSS JOIN med
  WHERE gasto_total < q / 2)"""


def errors(src: str, y: str, stat: str, by: str = "", centred: bool = True, full: str = "") -> str:
    """CTE chain ending in ``res(by, estimate, se, df)``; ``full`` keeps PSUs of that table."""
    g = by or "one"
    rows = f"(SELECT {g} AS grp, estrato_pof AS h, cod_upa AS i, peso AS w, {y} AS y FROM {src})"
    if not by:
        rows = rows.replace("one AS grp", "1 AS grp")
    z = "sy" if stat == "total" else "(sy - mean * sw) / tw"
    est = "ty" if stat == "total" else "mean"
    size = "n" if not full else "coalesce(nf, n)"
    counts = ""
    if full:
        counts = f""",
nfull AS (SELECT estrato_pof AS h, count(DISTINCT cod_upa) AS nf FROM {full} GROUP BY 1)"""
    join_full = "LEFT JOIN nfull USING (h)" if full else ""
    m = "(SELECT sum(nf) FROM nfull)" if full else "m"
    centre = f"gsum / {m}" if centred else "0"
    return f"""psu AS (SELECT grp, h, i, sum(w) AS sw, sum(w * y) AS sy FROM {rows} GROUP BY 1, 2, 3),
tot AS (SELECT grp, sum(sw) AS tw, sum(sy) AS ty, sum(sy) / sum(sw) AS mean, count(*) AS m,
  count(DISTINCT h) AS strata FROM psu GROUP BY 1){counts},
z AS (SELECT psu.grp, h, {z} AS z, m FROM psu JOIN tot ON psu.grp IS NOT DISTINCT FROM tot.grp),
gz AS (SELECT grp, sum(z) AS gsum FROM z GROUP BY 1),
st AS (SELECT grp, h, count(*) AS n, sum(z) AS s FROM z GROUP BY 1, 2),
sized AS (SELECT st.grp, h, n, s, {size} AS nh FROM st {join_full}),
dev AS (SELECT z.grp, h, m, nh, n, s, sum(CASE WHEN nh > 1 THEN (z - s / nh) * (z - s / nh)
    ELSE (z - {centre}) * (z - {centre}) END) AS ss
  FROM z JOIN sized USING (h) JOIN gz ON z.grp IS NOT DISTINCT FROM gz.grp
  WHERE z.grp IS NOT DISTINCT FROM sized.grp GROUP BY z.grp, h, m, nh, n, s, gsum),
var AS (SELECT grp, sum(CASE WHEN nh > 1
    THEN CAST(nh AS DOUBLE) / (nh - 1) * (ss + (nh - n) * (s / nh) * (s / nh)) ELSE ss END) AS v
  FROM dev GROUP BY 1),
res AS (SELECT tot.grp, {est} AS estimate, sqrt(v) AS se, m - strata AS df
  FROM tot JOIN var ON tot.grp IS NOT DISTINCT FROM var.grp)"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def item_rows(codes: str) -> str:
    return q(
        ITEMS,
        f"SELECT l_orderkey, l_linenumber, l_partkey, v9001 FROM items WHERE v9001 IN ({CODES[codes]})",
    )


def national(src: str, y: str, stat: str, digits: int, se_digits: int) -> str:
    return f"SELECT round(estimate, {digits}) AS estimate, round(se, {se_digits}) AS se FROM res"


def national_rows(*measures: tuple[str, str, str, str, str]) -> str:
    """``(measure, estimate, se)`` of (name, CTEs, table, column, statistic)."""
    parts = [
        f"(SELECT '{name}' AS measure, round(estimate, 2) AS estimate, round(se, 0) AS se FROM ("
        f"{q(f'{ctes}, {errors(src, y, stat)}', 'SELECT estimate, se FROM res')}))"
        for name, ctes, src, y, stat in measures
    ]
    return "\nUNION ALL\n".join(parts)


def decile_mean(codes: str, y: str) -> str:
    return q(
        f"{with_deciles(codes)}, {errors('(SELECT * FROM dec WHERE decil IS NOT NULL)', y, 'mean', 'decil')}",
        "SELECT grp AS decil, round(estimate, 4) AS estimate, round(se, 4) AS se FROM res",
    )


SPEND = """SELECT d.decil, round(sum(peso * renda_anual) / sum(peso), 4) AS media_renda,
    round(sum(peso * gasto_total) / sum(peso), 4) AS media_gasto
  FROM dim d LEFT JOIN dec USING (decil) GROUP BY 1"""
POOR_MEDIANS = f"""{quantile("mg", "poor", "gasto_total", MEDIAN, "decil")},
{quantile("md", "poor", "gap", MEDIAN, "decil")}"""


def calibrated() -> str:
    return """ratio AS (SELECT v61058, pos_estrato, sum(peso_final) / sum(peso) AS r
  FROM dec GROUP BY 1, 2),
cal AS (SELECT dec.*, peso * r AS w2 FROM dec JOIN ratio USING (v61058, pos_estrato))"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    # Sources and sinks
    sql["s1_read_living_conditions"] = q(
        CONDITIONS,
        """SELECT CAST(household AS INTEGER) AS v6102, uf, estrato_pof, cod_upa,
          CAST(household % 100 AS INTEGER) AS num_dom, CAST(num_uc AS INTEGER) AS num_uc,
          CAST(v61058 AS INTEGER) AS v61058, peso, peso_final, renda_total FROM conditions""",
    )
    sql["s2_read_expenses"] = q(
        ITEMS,
        """SELECT CAST(household % 100000 AS INTEGER) AS v9004, uf, estrato_pof, cod_upa,
          CAST(num_uc AS INTEGER) AS num_uc, cod_informante, CAST(v9001 AS INTEGER) AS v9001, v9011, fator_anualizacao, round(v8000_defla, 2) AS v8000_defla,
          round(deflator, 2) AS deflator, peso, peso_final, renda_total FROM items""",
    )
    lines = f"""{ITEMS}, lines AS (SELECT row_number() OVER (ORDER BY {ORDER}) AS src_line,
        CAST(household % 100000 AS INTEGER) AS v9004, CAST(v9001 AS INTEGER) AS v9001, cod_informante, renda_total, peso FROM items)"""
    sql["s2_line_numbers"] = q(lines, "SELECT src_line, v9004, v9001, cod_informante FROM lines")
    sql["a7_first_line"] = q(
        lines,
        """SELECT v9004, src_line, v9001, renda_total, peso FROM lines
        WHERE src_line IN (SELECT min(src_line) FROM lines GROUP BY v9004)""",
    )
    sql["s3_missing_values"] = q(
        ITEMS,
        """SELECT count(*) AS n, count(*) - count(v9011) AS na_v9011,
          count(*) - count(deflator) AS na_deflator, count(*) - count(num_uc) AS na_num_uc,
          count(*) FILTER (WHERE uf = 0) AS na_uf, count(*) AS na_v8000
        FROM items""",
    )
    sql["s4_lower_names"] = "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"
    sql["s5_save_table"] = q(
        CONDITIONS,
        "SELECT uf, count(*) AS n, sum(peso) AS peso FROM conditions GROUP BY 1",
    )
    sql["s6_load_table"] = q(
        CONDITIONS, "SELECT household, estrato_pof, cod_upa, peso, renda_total FROM conditions"
    )
    sql["s8_write_report"] = q(
        f"{with_deciles('fuel')}, {DIM}, wide AS ({SPEND})",
        """SELECT 'Resultado_1' AS sheet, decil, label, media_renda AS value
           FROM wide JOIN dim USING (decil)
           UNION ALL SELECT 'Resultado_2', decil, label, media_gasto FROM wide JOIN dim USING (decil)""",
    )
    sql["s9_write_csv2"] = q(
        f"{BELOW}, {errors('low', 'gap', 'total')}", national("low", "gap", "total", 3, 0)
    )
    # Projections
    sql["p1_ids_to_string"] = q(
        CONDITIONS,
        """SELECT household, CAST(cod_upa AS VARCHAR) AS cod_upa, CAST(num_dom AS VARCHAR) AS num_dom,
          CAST(num_uc AS VARCHAR) AS num_uc FROM conditions""",
    )
    hh_id = """CAST(cod_upa AS VARCHAR) || CAST(num_dom AS VARCHAR)
          || coalesce(CAST(num_uc AS VARCHAR), 'NA')"""
    sql["p2_household_id"] = q(
        CONDITIONS, f"SELECT household, {hh_id} AS domicilio_id FROM conditions"
    )
    sql["p3_person_id"] = q(
        ITEMS,
        f"""SELECT {hh_id} || CAST(cod_informante AS VARCHAR) AS morador_id, count(*) AS n
        FROM items GROUP BY 1""",
    )
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    sql["p4_annual_value"] = q(
        f"{ITEMS}, {VALUED}", f"SELECT {key}, round(gasto, 4) AS gasto FROM valued"
    )
    sql["p5_annual_income"] = q(
        f"{ITEMS}, {VALUED}", f"SELECT {key}, round(renda_anual, 4) AS renda_anual FROM valued"
    )
    sql["p6_analysis_columns"] = q(
        CONDITIONS,
        f"""SELECT estrato_pof, uf, cod_upa, {hh_id} AS domicilio_id, v61058, peso, peso_final,
          renda_total FROM conditions""",
    )
    sql["p7_income_decile"] = q(with_deciles("fuel"), "SELECT household, decil FROM dec")
    sql["p8_fixed_cut_decile"] = q(CONDITIONS_DEC, "SELECT household, decil FROM dec")
    sql["p9_decile_levels"] = q(
        f"{CONDITIONS_DEC}, {DIM}",
        """SELECT dim.decil, label, count(household) AS n FROM dim LEFT JOIN dec USING (decil)
        GROUP BY 1, 2""",
    )
    sql["p10_gap_to_median"] = q(
        f"{BELOW}, {OWN}",
        """SELECT 0 AS decil, household, round(gap, 4) AS valor_total FROM low
        UNION ALL SELECT decil, household, round(threshold - gasto_total, 4) FROM thr
        WHERE gasto_total < threshold""",
    )
    sql["p11_gap_to_half_median"] = q(
        POOR, "SELECT household, decil, round(gap, 4) AS valor_total FROM poor"
    )
    sql["p12_constant_one"] = q(base("all", "+ 1"), "SELECT sum(peso) AS total FROM base")
    # Filters
    for name, codes in (("f1_fuel", "fuel"), ("f2_public", "public"), ("f3_all", "all")):
        sql[f"{name}_items"] = item_rows(codes)
    sql["f4_answer_groups"] = q(
        CONDITIONS,
        """SELECT v61058, count(*) AS n, sum(peso) AS peso FROM conditions
        WHERE v61058 BETWEEN 1 AND 4 GROUP BY 1""",
    )
    sql["f5_decile_groups"] = q(
        with_deciles("fuel"),
        "SELECT decil, count(*) AS n, sum(peso) AS peso FROM dec WHERE decil IS NOT NULL GROUP BY 1",
    )
    spend = "round(gasto_total, 4) AS gasto_total"
    sql["f6_below_median"] = q(BELOW, f"SELECT household, {spend} FROM low")
    sql["f7_below_decile_median"] = q(
        f"{TRANSPORT}, {OWN}",
        f"SELECT household, decil, {spend} FROM thr WHERE gasto_total < threshold",
    )
    side = "CASE WHEN decil = 10 THEN gasto_total > threshold ELSE gasto_total < threshold END"
    sql["f8_decile_median_side"] = q(
        f"{TRANSPORT}, {OWN}", f"SELECT household, decil, {spend} FROM thr WHERE {side}"
    )
    sql["f9_below_half_median"] = q(POOR, f"SELECT household, {spend} FROM poor")
    sql["f10_decile_below_half_median"] = q(
        POOR,
        "SELECT decil, count(*) AS n, sum(peso) AS peso FROM poor WHERE decil IS NOT NULL GROUP BY 1",
    )
    # Joins
    j1 = q(base("fuel"), f"SELECT household, pos_estrato, {spend}, peso_final FROM base")
    sql["j1_post_strata"] = j1
    sql["j2_post_strata_again"] = j1
    sql["j3_decile_threshold"] = q(
        f"{TRANSPORT}, {OWN}",
        f"SELECT household, decil, {spend}, round(threshold, 4) AS threshold FROM thr",
    )
    # Unweighted aggregates
    sql["a1_answer_frequency"] = q(
        CONDITIONS,
        """SELECT v61058, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT v61058, count(*) AS n FROM conditions GROUP BY 1
        UNION ALL SELECT NULL, 0) t GROUP BY 1""",
    )
    sql["a2_answer_by_decile"] = q(
        CONDITIONS_DEC,
        f"""SELECT v61058, {", ".join(f"count(*) FILTER (WHERE decil = {k}) AS d{k}" for k in range(1, 11))}
        FROM dec WHERE v61058 IS NOT NULL GROUP BY 1""",
    )
    sql["a3_population_totals"] = q(
        base("fuel"), "SELECT pos_estrato, sum(peso_final) AS freq FROM base GROUP BY 1"
    )
    sql["a4_plain_means"] = q(
        with_deciles("fuel"),
        """SELECT decil, round(avg(renda_anual), 4) AS media_renda_anual,
          round(avg(gasto_total), 4) AS media_gasto_total FROM dec GROUP BY 1""",
    )
    for name, plus in (("a5_household_total", ""), ("a6_household_total_plus_one", "+ 1")):
        sql[name] = q(base("all", plus), f"SELECT household, {spend} FROM base")
    sql["a7_first_row"] = q(
        base("fuel"),
        """SELECT household, estrato_pof, uf, cod_upa, round(renda_anual, 4) AS renda_anual, peso
        FROM base""",
    )
    # Designs
    sql["e1_design_strata"] = q(
        base("all", "+ 1"),
        """SELECT estrato_pof, count(DISTINCT cod_upa) AS psus, count(*) AS n, sum(peso) AS peso
        FROM base GROUP BY 1""",
    )
    sql["e2_design_check"] = q(
        base("all", "+ 1"),
        """SELECT count(*) AS n_rows, count(*) - count(cod_upa) AS na_psu,
          count(*) - count(estrato_pof) AS na_strata, count(*) - count(peso) AS na_weight FROM base""",
    )
    uncentred = errors("base", "gasto_total", "total", centred=False)
    sql["e3_lonely_psu"] = " UNION ALL ".join(
        f"""SELECT * FROM ({q(f"{base('fuel')}, {ctes}",
            f"SELECT '{name}' AS lonely_psu, round(estimate, 3) AS estimate, round(se, 0) AS se FROM res")})"""
        for name, ctes in (
            ("adjust", errors("base", "gasto_total", "total")),
            ("uncentred", uncentred),
        )
    )
    sql["e4_post_stratified_weights"] = q(
        f"{CONDITIONS_DEC}, {calibrated()}",
        "SELECT household, v61058, round(w2, 6) AS peso_calibrado FROM cal",
    )
    sql["e5_families_by_decile"] = q(
        f"{CONDITIONS_DEC}, {DIM}",
        """SELECT dim.decil, coalesce(sum(peso), 0) AS freq FROM dim LEFT JOIN dec USING (decil)
        GROUP BY 1""",
    )
    sql["e6_families_by_answer"] = q(
        CONDITIONS, "SELECT v61058, sum(peso) AS freq FROM conditions GROUP BY 1"
    )
    sql["e7_calibrated_by_answer"] = q(
        f"{CONDITIONS_DEC}, {calibrated()}",
        """SELECT v61058, decil, round(sum(w2), 4) AS freq FROM cal WHERE decil IS NOT NULL
        GROUP BY 1, 2""",
    )
    # Estimates
    sql["e8_families"] = q(
        f"{BELOW}, {errors('dec', '1.0', 'total')}, below AS (SELECT sum(peso) AS b FROM low)",
        "SELECT estimate, round(se, 4) AS se, b AS below FROM res CROSS JOIN below",
    )
    sql["e9_families_by_decile"] = q(
        f"{TRANSPORT}, {OWN}",
        """SELECT decil, sum(peso) AS familias,
          sum(CASE WHEN gasto_total < threshold THEN peso ELSE 0 END) AS familias_abaixo
        FROM thr GROUP BY 1""",
    )
    sql["e10_total_gap"] = q(
        f"{BELOW}, {errors('low', 'gap', 'total')}", national("low", "gap", "total", 3, 0)
    )
    sql["e11_total_gap_by_decile"] = q(
        f"{POOR}, {errors('(SELECT * FROM poor WHERE decil IS NOT NULL)', 'gap', 'total', 'decil')}",
        "SELECT grp AS decil, round(estimate, 3) AS estimate, round(se, 1) AS se FROM res",
    )
    sql["e12_mean_income_by_decile"] = decile_mean("fuel", "renda_anual")
    sql["e13_mean_spend_by_decile"] = decile_mean("public", "gasto_total")
    sql["e14_mean_spend_below"] = q(
        f"{TRANSPORT}, {OWN}",
        f"""SELECT decil, round(sum(peso * gasto_total) / sum(peso), 4) AS gasto_medio
        FROM thr WHERE {side} GROUP BY 1""",
    )
    sql["e15_mean_gap"] = q(
        f"{POOR}, {errors('(SELECT * FROM poor WHERE decil IS NOT NULL)', 'gap', 'mean', 'decil')}",
        "SELECT grp AS decil, round(estimate, 4) AS estimate, round(se, 3) AS se FROM res",
    )
    sql["e16_income_deciles"] = q(
        f"{base('fuel')}, {PROBS}, {quantile('r', 'base', 'renda_anual', 'probs')}",
        "SELECT round(p, 4) AS p, round(q, 4) AS quantile FROM r",
    )
    sql["e17_spend_deciles"] = q(
        f"{base('all', '+ 1')}, {PROBS}, {quantile('r', 'base', 'gasto_total', 'probs')}",
        "SELECT round(p, 4) AS p, round(q, 4) AS quantile FROM r",
    )
    sql["e18_median_spend"] = q(
        f"{base('all', '+ 1')}, {quantile('r', 'base', 'gasto_total', MEDIAN)}",
        "SELECT p, round(q, 4) AS quantile FROM r",
    )
    sql["e19_median_spend_by_decile"] = q(
        f"{TRANSPORT}, {OWN}", "SELECT decil, p, round(q, 4) AS quantile FROM own"
    )
    both = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, coalesce(decil, 0) AS decil, round(q, 4) AS quantile FROM {c}"
        for v, c in (("gasto_total", "mg"), ("valor_total", "md"))
    )
    nat = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, 11 AS decil, round(q, 4) AS quantile FROM {c}"
        for v, c in (("gasto_total", "ng"), ("valor_total", "nd"))
    )
    sql["e20_medians_below_half"] = q(
        f"""{POOR}, {POOR_MEDIANS}, {quantile("ng", "poor", "gasto_total", MEDIAN)},
        {quantile("nd", "poor", "gap", MEDIAN)}""",
        f"{both} UNION ALL {nat}",
    )
    sql["e21_standard_errors"] = " UNION ALL ".join(
        f"""SELECT * FROM ({q(f"{TRANSPORT}, {errors('(SELECT * FROM dec WHERE decil IS NOT NULL)', 'gasto_total', 'mean', 'decil', full=full)}",
            f"SELECT '{name}' AS psus, grp AS decil, round(estimate, 4) AS estimate, round(se, 3) AS se FROM res")})"""
        for name, full in (("subset", ""), ("domain", "dec"))
    )
    placed = f"{TRANSPORT}, fam AS (SELECT * FROM dec WHERE decil IS NOT NULL)"
    sql["e22_quantile_interval"] = interval_sql(placed, "decil", MEDIAN, 4)
    two = "(SELECT unnest([CAST(0.25 AS DOUBLE), 0.5]) AS p)"
    sql["e22_national_interval"] = interval_sql(f"{POOR}, fam AS (SELECT * FROM poor)", "", two, 3)
    sql["e23_svyby"] = decile_mean("fuel", "gasto_total")
    # Windows
    sql["w1_total_on_items"] = q(
        f"{ITEMS}, {VALUED}",
        f"""SELECT {key}, household, round(sum(gasto) OVER (PARTITION BY household), 4) AS gasto_total
        FROM valued WHERE v9001 IN ({FUEL})""",
    )
    sql["w2_first_item"] = q(
        f"{ITEMS}, {VALUED}",
        f"""SELECT household, l_orderkey, l_linenumber, l_partkey, round(gasto, 4) AS gasto FROM (
          SELECT *, row_number() OVER (PARTITION BY household ORDER BY {ORDER}) AS rn
          FROM valued WHERE v9001 IN ({CODES["all"]})) t WHERE rn = 1""",
    )
    sql["w3_report_order"] = q(
        f"{with_deciles('fuel')}, {DIM}, wide AS ({SPEND})",
        """SELECT CAST(row_number() OVER (ORDER BY decil) AS INTEGER) AS position, decil, label, media_gasto AS value
        FROM wide JOIN dim USING (decil)""",
    )
    # Reports
    sql["r1_stacked_deciles"] = q(
        f"{with_deciles('public')}, {DIM}, wide AS ({SPEND})",
        """SELECT decil, label, 'media_renda' AS measure, media_renda AS value FROM wide JOIN dim USING (decil)
        UNION ALL SELECT decil, label, 'media_gasto', media_gasto FROM wide JOIN dim USING (decil)""",
    )
    totals = """SELECT dim.decil, round(coalesce(sum(peso * gap), 0), 3) AS extrapolacao
        FROM dim LEFT JOIN poor USING (decil) GROUP BY 1
        UNION ALL SELECT 11, round(sum(peso * gap), 3) FROM poor"""
    sql["r2_deciles_and_total"] = q(
        f"{POOR}, {DIM}, rep AS ({totals})",
        """SELECT rep.decil, coalesce(label, 'Total') AS label, extrapolacao AS value
        FROM rep LEFT JOIN dim USING (decil)""",
    )
    answers = ", ".join(
        f"round(coalesce(sum(CASE WHEN v61058 = {k} THEN w2 END), 0), 4) AS {name}"
        for k, name in enumerate(("bom", "satisfatorio", "ruim", "nao_tem"), 1)
    )
    sql["r3_perception"] = q(
        f"{CONDITIONS_DEC}, {DIM}, {calibrated()}",
        f"""SELECT dim.decil, coalesce(sum(peso), 0) AS familias, {answers}
        FROM dim LEFT JOIN cal USING (decil) GROUP BY 1""",
    )
    sql["r4_fuel_spend"] = q(f"{with_deciles('fuel')}, {DIM}", SPEND)
    sql["r5_public_transport_spend"] = q(f"{with_deciles('public')}, {DIM}", SPEND)
    for name, when in (("r6_decile_median", side), ("r6_decile_median_fixed", "gasto_total < threshold")):
        ctes = TRANSPORT if name == "r6_decile_median" else with_deciles("all")
        sql[name] = q(
            f"{ctes}, {OWN}, {DIM}",
            f"""SELECT dim.decil, coalesce(sum(peso), 0) AS familias,
              round(max(threshold), 4) AS mediana,
              sum(CASE WHEN {when} THEN peso ELSE 0 END) AS familias_abaixo,
              round(sum(CASE WHEN {when} THEN peso * gasto_total END)
                / sum(CASE WHEN {when} THEN peso END), 4) AS gasto_medio_abaixo
            FROM dim LEFT JOIN thr USING (decil) GROUP BY 1""",
        )
    below = "CASE WHEN gasto_total < threshold THEN peso END"
    sql["r7_decile_gap"] = q(
        f"{TRANSPORT}, {OWN}, {DIM}",
        f"""SELECT dim.decil,
          round(sum({below} * (threshold - gasto_total)) / sum({below}), 4) AS media_dif
        FROM dim LEFT JOIN thr USING (decil) GROUP BY 1""",
    )
    sql["r8_half_median"] = q(
        f"{POOR}, {POOR_MEDIANS}, {DIM}",
        """SELECT dim.decil, coalesce(sum(peso), 0) AS familias,
          round(sum(peso * gasto_total) / sum(peso), 4) AS gasto_medio,
          round(max(mg.q), 4) AS gasto_mediano,
          round(sum(peso * gap) / sum(peso), 4) AS dif_media, round(max(md.q), 4) AS dif_mediana
        FROM dim LEFT JOIN poor USING (decil) LEFT JOIN mg USING (decil) LEFT JOIN md USING (decil)
        GROUP BY 1""",
    )
    sql["r6_national"] = national_rows(
        ("familias", TRANSPORT, "dec", "1.0", "total"),
        ("familias_abaixo", BELOW, "low", "1.0", "total"),
        ("gasto_medio_abaixo", BELOW, "low", "gasto_total", "mean"),
    )
    sql["r7_national"] = national_rows(
        ("media_dif", BELOW, "low", "gap", "mean"), ("total_dif", BELOW, "low", "gap", "total")
    )
    sql["r8_national"] = national_rows(
        ("familias", POOR, "poor", "1.0", "total"),
        ("gasto_medio", POOR, "poor", "gasto_total", "mean"),
        ("dif_media", POOR, "poor", "gap", "mean"),
    )
    sql["r8_national_medians"] = q(
        f"{POOR}, {quantile('hg', 'poor', 'gasto_total', MEDIAN)}, {quantile('hd', 'poor', 'gap', MEDIAN)}",
        "SELECT round(hg.q, 4) AS gasto_mediano, round(hd.q, 4) AS dif_mediana FROM hg CROSS JOIN hd",
    )
    sql["e4_null_post_strata"] = q(
        f"""{CONDITIONS_DEC}, known AS (SELECT * FROM dec WHERE household % 7 <> 0),
        ratio AS (SELECT v61058, pos_estrato, sum(peso_final) / sum(peso) AS r FROM known GROUP BY 1, 2),
        weighed AS (SELECT v61058, decil, sum(peso * r) AS freq FROM known JOIN ratio USING (v61058, pos_estrato)
          WHERE decil IS NOT NULL AND v61058 IS NOT NULL GROUP BY 1, 2)""",
        "SELECT v61058, decil, round(freq, 4) AS freq, round(freq, 4) AS two_steps FROM weighed",
    )
    sql["r8_unknown_amount"] = q(
        f"{ITEMS}, {DIM}, lost AS (SELECT count(*) AS n FROM items WHERE household = 1 AND v9001 IN ({CODES['all']}))",
        """SELECT decil, CAST(CASE WHEN n = 0 THEN 0 END AS DOUBLE) AS familias, CAST(NULL AS DOUBLE) AS gasto_medio,
          CAST(CASE WHEN n = 0 THEN 0 END AS DOUBLE) AS extrapolacao FROM dim CROSS JOIN lost""",
    )
    sql["s3_field_problems"] = q(
        ITEMS,
        """SELECT 'v9011' AS field, count(*) - count(v9011) AS n_missing, 0 AS n_unreadable FROM items
        UNION ALL SELECT 'deflator', count(*) - count(deflator), count(deflator) FROM items
        UNION ALL SELECT 'v9001', 0, 0 FROM items HAVING count(*) > 0""",
    )
    sql["s3_problems_while_reading"] = sql["s3_field_problems"]
    sql["r9_half_median_totals"] = q(f"{POOR}, {DIM}", totals)
    return {name: text.replace("round(", f"round({OFFSET} + ") for name, text in sql.items()}


def interval_sql(rows: str, by: str, probs: str, digits: int) -> str:
    """Quantiles of ``gasto_total`` and their intervals; ``rows`` are CTEs that end in a table ``fam``."""
    g, on, part = (f"{by}, ", f"USING ({by})", f"PARTITION BY {by}") if by else ("", "ON true", "")
    group = f"{by} || '/' || p" if by else "CAST(p AS VARCHAR)"
    ind = f"(SELECT fam.*, {group} AS g, CASE WHEN gasto_total <= q THEN 1.0 ELSE 0.0 END AS ind FROM fam JOIN r {on})"
    table = "[" + ", ".join(repr(student_t(df)) for df in range(1, 101)) + "]"
    share = "CAST(1e-12 AS DOUBLE)"
    return q(
        f"""{rows}, {quantile("r", "fam", "gasto_total", probs, by)},
{errors(ind, "ind", "mean", "g")},
reach AS (SELECT {g}p, q, CAST(({table})[df] AS DOUBLE) AS t, se FROM r LEFT JOIN res ON grp = {group}),
lim AS (SELECT {g.replace(by, "c." + by) if by else ""}reach.p, t,
    min(CASE WHEN cw >= greatest(reach.p - t * se, 0) * tw * (1 - {share}) THEN x END) AS lo,
    min(CASE WHEN cw >= least(reach.p + t * se, 1) * tw * (1 - {share}) THEN x END) AS hi
  FROM r_c c JOIN reach {on} GROUP BY ALL)""",
        f"""SELECT {"r." + by + ", " if by else ""}r.p, round(q, 4) AS quantile, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high,
          round((hi - lo) / (2 * t), {digits}) AS se FROM r LEFT JOIN lim ON r.p = lim.p {f"AND r.{by} = lim.{by}" if by else ""}""",
    )


@functools.cache
def student_t(df: int, p: float = 0.975) -> float:
    """Student t quantile by the regularised incomplete beta function, as a continued fraction.

    Textbook values of it are tested; nothing here comes from the library.
    """

    def tail(t: float) -> float:
        a, b, x = df / 2, 0.5, df / (df + t * t)
        swap = x > (a + 1) / (a + b + 2)
        if swap:
            a, b, x = b, a, 1 - x
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + step * d), 1 + step / c
                h *= c * d
            if abs(c * d - 1) < 1e-16:
                break
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        return (1 - front * h if swap else front * h) / 2

    low, high = 0.1, 1000.0
    for _ in range(70):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - p else (low, middle)
    return (low + high) / 2
