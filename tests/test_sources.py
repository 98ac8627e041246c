import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from checks.fixed_width_files import write_fwf
from hearthstat.sources import layouts, sinks, tables
from hearthstat.sources.fixed_width import FILE_ORDER, read_fwf
from hearthstat.sources.layouts import INDIVIDUAL_EXPENSES, LIVING_CONDITIONS, record_width
from hearthstat.workspace import Workspace, local_if_small, shared_folder


def test_layout_sizes():
    assert (len(LIVING_CONDITIONS), record_width(LIVING_CONDITIONS)) == (55, 113)
    assert (len(INDIVIDUAL_EXPENSES), record_width(INDIVIDUAL_EXPENSES)) == (25, 119)
    starts = {f.name: f.start for f in LIVING_CONDITIONS}
    assert (starts["v61058"], starts["peso"], starts["renda_total"]) == (47, 76, 104)


LAYOUT = layouts.parse_layout("ID:2 NAME_CODE:3 VALUE:6:d KEY:9:l")


def test_read_cuts_converts_and_keeps_missing(spark, tmp_path):
    lines = [" 1 12  3.50123456789", " 2       9        7", " 3", " 4 99*** 4.25abc"]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    rows = read_fwf(spark, str(tmp_path / "in.txt"), LAYOUT, na_strings=(" ", "99")).collect()
    assert [tuple(r) for r in rows] == [
        (1, 12, 3.5, 123456789),
        (2, None, 9.0, 7),
        (3, None, None, None),
        (4, None, None, None),
    ]


def test_round_trip_and_too_wide(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 5, -2.25, 10), (2, None, None, 11)], "id int, name_code int, value double, key long"
    )
    path = str(tmp_path / "out")
    write_fwf(df, path, LAYOUT)
    assert sorted(map(tuple, read_fwf(spark, path, LAYOUT).collect())) == sorted(
        map(tuple, df.collect())
    )
    with pytest.raises(Exception, match="too wide for name_code"):
        write_fwf(df.withColumn("name_code", F.lit(12345)), path, LAYOUT)


def test_line_numbers_over_several_files_and_splits(spark, tmp_path):
    """One number along all lines, whatever the splits and how tasks share them."""
    numbers = iter(range(10_000))
    for name, lines in (("b.txt", 3000), ("a.txt", 5), ("c.txt", 0), ("d.txt", 400)):
        (tmp_path / name).write_text("")
    for name, lines in (("a.txt", 5), ("b.txt", 3000), ("c.txt", 0), ("d.txt", 400)):
        keys = [next(numbers) for _ in range(lines)]
        (tmp_path / name).write_text("".join(f"{n % 100:2d}{n % 7:3d}{n:6d}{n:9d}\n" for n in keys))
    for size, cost in (("8k", "0"), ("20k", "1"), ("128m", "4m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            df = read_fwf(spark, str(tmp_path), LAYOUT, file_order=True)
            assert size != "8k" or df.rdd.getNumPartitions() > 4
            assert dict(df.dtypes)["src_line"] == "bigint" and FILE_ORDER.columns == ("src_line",)
            rows = df.collect()
            assert sorted((r.src_line, r.key) for r in rows) == [(n + 1, n) for n in range(3405)]
            assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_changed_splits_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{n % 100:2d}{n % 7:3d}{n:6d}{n:9d}\n" for n in range(2000)))
    df = read_fwf(spark, str(tmp_path), LAYOUT, file_order=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        with pytest.raises(Exception, match="settings have changed"):
            df.select("src_line").filter("src_line > 3").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables(spark, tmp_path):
    df = tables.lower_names(spark.createDataFrame([(1, "a")], "ID int, Name string"))
    assert df.columns == ["id", "name"]
    path = str(tmp_path / "t")
    tables.save_table(df, path)
    tables.save_table(df, path)
    assert tables.load_table(spark, path).collect() == df.collect()


def test_report_overwrites(spark, tmp_path):
    path = str(tmp_path / "report")
    sheet = spark.createDataFrame([(1, 2.5), (2, None)], "decil int, value double")
    sinks.write_report({"One": sheet, "Two": sheet.limit(1)}, path)
    sinks.write_report({"One": sheet}, path)
    assert sorted(map(tuple, sinks.read_sheet(spark, path, "One").collect())) == [(1, 2.5), (2, None)]
    assert sinks.read_sheet(spark, path, "Two").count() == 0
    for i in range(3):
        sinks.write_report({"One": sheet.limit(i)}, path)
    assert sinks.read_report(spark, path).count() == 2
    assert len([f for f in os.listdir(path) if f.startswith("version-")]) == 2


def test_a_job_that_dies_leaves_the_previous_report(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError, match="no report was published"):
        sinks.read_sheet(spark, path, "One")
    sheet = spark.createDataFrame([(1, 2.5), (2, None)], "decil int, value double")
    dying = sheet.withColumn("value", F.when(F.col("decil") == 2, F.raise_error(F.lit("lost"))).otherwise(0.0))
    with pytest.raises(Exception, match="lost"):
        sinks.write_report({"One": dying.repartition(2)}, path)
    with pytest.raises(FileNotFoundError):
        sinks.read_sheet(spark, path, "One")
    sinks.write_report({"One": sheet}, path)
    kept = sorted(map(tuple, sheet.collect()))
    with pytest.raises(Exception, match="lost"):  # while the data are written
        sinks.write_report({"One": dying.repartition(2), "Two": sheet}, path)
    assert sorted(map(tuple, sinks.read_sheet(spark, path, "One").collect())) == kept
    with monkeypatch.context() as m:  # after the data, before the change
        m.setattr(sinks, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError):
            sinks.write_report({"One": sheet.limit(0)}, path)
    assert sorted(map(tuple, sinks.read_sheet(spark, path, "One").collect())) == kept
    sinks.write_report({"One": sheet.limit(1)}, path)
    assert sinks.read_sheet(spark, path, "One").count() == 1


def test_csv2(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.createDataFrame([("a", 1.5, None), ("b", -2.0e10, 3.25)], "k string, x double, y double")
    sinks.write_csv2(df, path)
    lines = sorted(r.value for r in spark.read.text(path).distinct().collect())
    assert lines == ["a;1,5;NA", "b;-2,0E10;3,25", "k;x;y"]
    assert sorted(map(tuple, sinks.read_csv2(spark, path, df.schema).collect())) == sorted(
        map(tuple, df.collect())
    )


def test_workspace(spark, tmp_path):
    with Workspace(spark, str(tmp_path)) as space:
        staged = space.stage(spark.range(10).toDF("n"), "numbers")
        assert staged.agg(F.sum("n")).first()[0] == 45
        assert any(tmp_path.iterdir())
    assert not any(tmp_path.iterdir())
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_folder_is_made_up_in_local_mode_only():
    unset = SimpleNamespace(get=lambda key, default: default)
    local = SimpleNamespace(conf=unset, sparkContext=Context("local[2]"))
    folder = shared_folder(local)
    assert os.path.isdir(folder) and shared_folder(local) == folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=Context("yarn")))


def test_local_tables_are_size_checked(spark):
    df = spark.range(10).toDF("n")
    local, small = local_if_small(df, 10)
    assert small and "LocalTableScan" in local._jdf.queryExecution().toString()
    same, small = local_if_small(df, 9)
    assert not small and same is df


def test_unreadable_is_not_blank(spark, tmp_path):
    from hearthstat.sources.fixed_width import field_problems
    from hearthstat.sources.layouts import Field

    (tmp_path / "lines.txt").write_text("12x4\n   4\n    \nNA  \n12\n")
    rows = field_problems(spark, str(tmp_path), [Field("a", 1, 4, "int")], na_strings=("NA",)).collect()
    assert [tuple(r) for r in rows] == [("a", 2, 1)]


def test_problems_are_counted_while_reading(spark, tmp_path):
    from hearthstat.sources.fixed_width import FieldProblems

    (tmp_path / "lines.txt").write_text("12x4 1\n   4 2\n     3\nNA  xx\n12\n")
    layout = layouts.parse_layout("a:4 b:2")
    for file_order in (False, True):
        problems = FieldProblems()
        df = read_fwf(spark, str(tmp_path), layout, ("NA",), file_order, problems)
        assert df.columns == ["a", "b", *["src_line"] * file_order]
        assert df.filter("a is not null").count() == 2
        assert sorted(map(tuple, problems.table(spark).collect())) == [("a", 2, 1), ("b", 1, 1)]


def test_text_that_is_no_whole_number_is_never_cast(spark):
    from hearthstat.sources.fixed_width import _NOT_WHOLE, _number
    from hearthstat.sources.layouts import Field

    odd = ["1.5", "+5", "-5", "\t5", "5\x01", "\x7f5", "1e3", "\u0663", "9999999999", "--5", "5-", "0x1F", "NaN", "a", "5 5", "+", "\u00a05", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for dtype in ("int", "bigint", "double"):
        rows = df.select("t", _number(F.col("t"), Field("a", 1, 4, dtype)).alias("n"), F.col("t").try_cast(dtype).alias("cast")).collect()
        assert [r.t for r in rows if repr(r.n) != repr(r["cast"])] == []
    assert _NOT_WHOLE in df.select(_number(F.col("t"), Field("a", 1, 4, "int")).alias("n"))._jdf.queryExecution().toString()


def test_each_text_is_cut_once_while_problems_are_counted(spark, tmp_path):
    from hearthstat.sources.fixed_width import FieldProblems, field_problems

    (tmp_path / "lines.txt").write_text("12x4 1" + "7" * 60 + "\n   4 2\n")
    layout = layouts.parse_layout("a:4 b:2 c:30 d:4 e:9:l")
    problems = FieldProblems()
    df = read_fwf(spark, str(tmp_path), layout, problems=problems)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") == len(layout)
    assert [tuple(r) for r in df.collect()] == [(None, 1, None, 7777, 777777777), (4, 2, None, None, None)]
    counts = [("a", 0, 1), ("b", 0, 0), ("c", 1, 1), ("d", 1, 0), ("e", 1, 0)]
    assert sorted(map(tuple, problems.table(spark).collect())) == counts
    assert sorted(map(tuple, field_problems(spark, str(tmp_path), layout).collect())) == counts


def test_session_workspace_leaves_no_folder(spark, tmp_path, monkeypatch):
    import os

    from hearthstat import workspace

    monkeypatch.setattr(workspace, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(workspace, "_session_spaces", {})
    space = workspace.session_space(spark)
    assert workspace.session_space(spark) is space
    space.stage(spark.range(3), "x").count()
    assert os.listdir(tmp_path)
    workspace.close_session_space(spark)
    assert not os.listdir(tmp_path)
