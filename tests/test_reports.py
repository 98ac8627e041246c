import pytest
from pyspark.sql import functions as F

from checks.fixed_width_files import write_fwf
from hearthstat.functions.deciles import NATIONAL
from hearthstat.plans import indicators as reports
from hearthstat.plans.indicators import Survey
from hearthstat.sources import sinks
from hearthstat.sources.fixed_width import FILE_ORDER, read_fwf
from hearthstat.sources.layouts import INDIVIDUAL_EXPENSES

ITEMS = (
    "cod_upa long, num_dom int, num_uc int, cod_informante int, quadro int, seq int, v9001 int,"
    " v8000_defla double, fator_anualizacao int, v9011 int, deflator double, renda_total double,"
    " estrato_pof int, uf int, peso double, peso_final double"
)


def make_items(spark, n=200, income=lambda i: float(i), code=2301401):
    rows = [
        (i % 12, i, 1, 1, 23, 1, code, float(1 + i * 37 % 101), 12, None, None, income(i),
         i % 3, 1, 1.0 + i % 4, 2.0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ITEMS)


def post_strata(spark):
    return spark.createDataFrame([(k, "PQ"[k % 2]) for k in range(12)], "cod_upa long, pos_estrato string")


@pytest.fixture(scope="module")
def survey(spark):
    return Survey(items=make_items(spark), post_strata=post_strata(spark))


def rows(report):
    return {r.decil: r for r in report.table.collect()}


def test_family_counts_add_up(spark, survey, space):
    base = reports.transport_base(survey, space)
    report = reports.families_below_decile_median(base)
    table = rows(report)
    assert list(table) == list(range(1, 11))
    total = base.design.df.agg(F.sum("peso")).first()[0]
    assert sum(r.familias for r in table.values()) == total
    national = {r.measure: r for r in report.national.collect()}
    assert national["familias"].estimate == total and national["familias"].se > 0


def test_quirks(spark, survey, space):
    published = reports.transport_base(survey, space)
    fixed = reports.transport_base(survey, space, "fixed")
    assert published.median == fixed.median + 1.0
    a = rows(reports.families_below_decile_median(published))
    b = rows(reports.families_below_decile_median(fixed))
    assert all(a[d].familias_abaixo == b[d].familias_abaixo for d in range(1, 10))
    assert all(a[d].mediana == b[d].mediana + 1.0 for d in range(1, 11))
    assert a[10].gasto_medio_abaixo > a[10].mediana
    assert b[10].gasto_medio_abaixo < b[10].mediana
    with pytest.raises(ValueError, match="quirks"):
        reports.transport_base(survey, space, "other")


def test_totals_report_has_eleven_rows(survey, space):
    base = reports.transport_base(survey, space)
    table = rows(reports.half_median_totals(base))
    assert list(table) == list(range(1, NATIONAL + 1))
    parts = sum(table[d].extrapolacao for d in range(1, 11))
    assert table[NATIONAL].extrapolacao == pytest.approx(parts)


def test_families_without_decile_count_nationally_only(spark, survey, space):
    items = make_items(spark, income=lambda i: -5.0 if i % 4 == 0 else float(i))
    base = reports.transport_base(Survey(items=items, post_strata=post_strata(spark)), space)
    table = rows(reports.half_median_totals(base))
    parts = sum(table[d].extrapolacao for d in range(1, 11))
    assert table[NATIONAL].extrapolacao > parts
    detail = reports.half_median_detail(base)
    national = {r.measure: r.estimate for r in detail.national.collect()}
    assert sum(r.familias for r in rows(detail).values()) < national["familias"]


def test_empty_deciles_are_listed(spark, space):
    # One income for all: everybody falls in the first decile.
    items = make_items(spark, 20, income=lambda i: 100.0)
    base = reports.transport_base(Survey(items=items, post_strata=post_strata(spark)), space)
    table = rows(reports.half_median_detail(base))
    assert list(table) == list(range(1, 11))
    assert all(table[d].familias == 0 and table[d].gasto_medio is None for d in range(2, 11))


def test_no_items_at_all(spark, space):
    items = make_items(spark, 20, code=1)
    base = reports.transport_base(Survey(items=items, post_strata=post_strata(spark)), space)
    assert base.median is None
    for report in (
        reports.families_below_decile_median(base),
        reports.gap_to_decile_median(base),
        reports.half_median_detail(base),
    ):
        assert len(report.table.collect()) == 10
    assert len(reports.half_median_totals(base).table.collect()) == 11


def test_a_missing_amount_spoils_the_median(spark, space):
    items = make_items(spark).withColumn(
        "v8000_defla", F.when(F.col("num_dom") != 7, F.col("v8000_defla"))
    )
    base = reports.transport_base(Survey(items=items, post_strata=post_strata(spark)), space)
    assert base.median is None
    assert all(r.familias is None for r in rows(reports.half_median_detail(base)).values())
    assert all(r.extrapolacao is None for r in rows(reports.half_median_totals(base)).values())


def test_sheets_are_written(spark, survey, space, tmp_path):
    report = reports.spend_by_decile(survey, space)
    path = str(tmp_path / "out")
    sinks.write_report(report.all_sheets(), path)
    single = sinks.read_sheet(spark, path, "Resultado_1").orderBy("decil").collect()
    assert single == report.sheet_tables()["Resultado_1"].select(*single[0].__fields__).collect()
    sheet = sinks.read_sheet(spark, path, "Resultado_2").orderBy("decil").collect()
    assert [r.label for r in sheet][9] == "10º Decil"
    assert [r.value for r in sheet] == [r.media_gasto for r in report.table.collect()]


def test_perception(spark):
    conditions = spark.createDataFrame(
        [(1, 1, 500.0, 1.0, 2.0, 1), (1, 1, 2000.0, 3.0, 1.0, 1), (2, 1, 500.0, 1.0, 5.0, 4),
         (2, 1, -1.0, 1.0, 5.0, 4), (2, 1, 500.0, 7.0, 5.0, None)],
        "cod_upa long, estrato_pof int, renda_total double, peso double, peso_final double, v61058 int",
    )
    report = reports.perception(Survey(conditions=conditions, post_strata=post_strata(spark)))
    table = rows(report)
    assert (table[1].familias, table[3].familias, table[10].familias) == (9.0, 3.0, 0.0)
    assert (table[1].bom, table[3].bom) == (0.75, 2.25)
    # Answer 4: weights scale by 10 / 2; the family without decile is in no row.
    assert table[1].nao_tem == 5.0
    counts = {r.v61058: r.freq for r in report.extra["avaliacao"].collect()}
    assert counts == {1: 2, 4: 2, None: 1}


def test_from_fixed_width_lines_to_report(spark, space, tmp_path):
    """The published layout, file order and text ids, end to end."""
    items = make_items(spark, 60)
    # A second item per household, later in the file and with another income.
    later = items.withColumns({"seq": F.lit(2), "deflator": F.lit(2.0), "v8000_defla": F.lit(1.0)})
    path = str(tmp_path / "DESPESA_INDIVIDUAL.txt")
    lines = items.unionByName(later).coalesce(1).sortWithinPartitions("cod_upa", "num_dom", "seq")
    write_fwf(lines, path, INDIVIDUAL_EXPENSES)
    read = read_fwf(spark, path, INDIVIDUAL_EXPENSES, na_strings=(" ",), file_order=True)
    text_ids = post_strata(spark).withColumn("cod_upa", F.col("cod_upa").cast("string"))
    survey = Survey(items=read, post_strata=text_ids, order=FILE_ORDER)
    base = reports.transport_base(survey, space)
    families = {r.num_dom: r for r in base.design.df.collect()}
    assert len(families) == 60
    for i, row in families.items():
        assert row.gasto_total == (1 + i * 37 % 101 + 1) * 12 + 1
        assert row.renda_anual == i * 12.0
        assert row.pos_estrato == "PQ"[i % 12 % 2]
    assert sum(r.familias for r in rows(reports.families_below_decile_median(base)).values()) == sum(
        1.0 + i % 4 for i in range(60)
    )
