"""Date layouts against another parser, headers below titles in split files, counters of a write."""

import glob
import os
import time
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean
from tillroll.plans import q_clean
from tillroll.session import checkpoint_dir
from tillroll.sources import io

SF = "/root/testdata/sf0.001"

DATES = ["05-12-2026", "05-13-2026", "2026-01-05T10:00:00", "2026/01/05", "01/05/2026 10:11:12", "2026-01-05 10:11:12.500",
         "5/1/2026", "13-05-2026", "13/05/2026", "2026-1-5", "5 Jan 2026", "Jan 5, 2026", "05-Jan-2026", "January 5 2026",
         "2026-01-05 10:11", "01/05/26", "31/12/99", "not a date", "", "2026-13-01", "2026-02-30", "2026-01-05T10:00:00Z",
         "1.5.2026", "2026-01-05 25:00:00", "5/1/2026 3:15 PM", "2026.01.05", "00/01/2026", "05-Foo-2026", "2026-01-05 foo",
         "20260105", "  2026-01-05 "]


def test_each_layout_as_a_column_of_its_own(spark):
    df = spark.createDataFrame([tuple(DATES)], [f"c{i}" for i in range(len(DATES))])
    layout = clean.date_layout(df, df.columns)
    rows = spark.createDataFrame([(x, layout[c]) for x, c in zip(DATES, df.columns)], "x string, day_first boolean")
    got = rows.select("x", F.when(F.col("day_first"), clean.safe_date(F.col("x"), True)).otherwise(clean.safe_date(F.col("x"))).alias("d"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in got.collect():
            want = pd.to_datetime(pd.Series([r["x"].strip()]), errors="coerce")[0]
            assert r["d"] == (None if pd.isna(want) else want.strftime("%Y-%m-%d")), r["x"]


def test_a_column_votes_on_day_and_month(spark):
    days = spark.createDataFrame([(d,) for d in ("05-12-2026", "01-02-2026", "25-12-2026", "13/01/2026 09:00:00")], "d string")
    months = spark.createDataFrame([(d,) for d in ("05-12-2026", "01-02-2026", "12-25-2026")], "d string")
    assert clean.date_layout(days, ["d"]) == {"d": True} and clean.date_layout(months, ["d"]) == {"d": False}
    std = clean.standardise(days.select(F.col("d").alias("Date"), F.lit("A").alias("Location")), clean.HOURLY)
    assert [r["date"] for r in std.collect()] == ["2026-12-05", "2026-02-01", "2026-12-25", "2026-01-13"]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_below_titles_in_files_of_many_splits(spark, small_splits):
    rows = [(f" name {i} ", "a, \"b\"" if i % 7 == 0 else None if i % 5 == 0 else "x", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "` Name ` string, other string, n string")
    path = io.scratch_path(spark, "sheets-test")
    io.write_sheets(df, path, ["Title, with a comma", "", "second title"], sheets=2)
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    back = io.read_feed_csv(spark, path, header_row=3)
    assert back.columns == ["Name", "other", "n"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    typed = io.apply_numeric_typing(back)
    assert typed.schema["n"].dataType.simpleString() == "double" and typed.schema["other"].dataType.simpleString() == "string"


def test_blank_and_repeated_header_cells():
    assert io._header_names('a,,"b, c",a,a') == ["a", "Unnamed: 1", "b, c", "a.1", "a.2"]


def test_counters_come_from_the_write(spark):
    df = spark.createDataFrame([("A", "1"), (" ", "2"), (None, "3"), ("B", "4")], "outlet_name string, v string")
    path = io.scratch_path(spark, "counted-test")
    assert io.write_valid_csv(df, clean.valid_outlet(df), path) == {"rows_before": 4, "rows_after": 2, "dropped": 2}
    assert sorted(r["v"] for r in io.read_feed_csv(spark, path).collect()) == ["1", "4"]


def test_a_sheet_is_written_by_many_tasks_and_lines_are_not_dealt_by_file(spark):
    df = spark.range(4000).selectExpr("concat('a ', id) AS x", "CAST(id AS string) AS n")
    path = io.scratch_path(spark, "sheet-parts-test")
    io.write_sheets(df, path, ["Title"], sheets=2)
    lines = spark.read.text(path).selectExpr("input_file_name() AS f").groupBy("f").count()
    assert lines.count() > 2 and lines.agg({"count": "max"}).first()[0] < 2000  # no file holds a whole sheet
    back = io.read_feed_csv(spark, path, header_row=1)
    assert "hashpartitioning(file" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_dates_take_one_replacement_and_numbers_one_pattern(spark):
    std = clean.standardise(spark.createDataFrame([("A", "1-2-2026", " 1e3\t")], "Location string, Date string, `Net Amt` string"), clean.HOURLY, False)
    plan = std._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(regexp_replace(" not in plan and "translate(" not in plan
    assert (std.first()["date"], std.first()["net_revenue"]) == ("2026-01-02", 1000.0)


def test_profile_cleans_the_feed_once_and_sorts_no_rows(spark):
    rows = [("2026-01-02", "B", "x"), ("2026-01-01", "A", None), (None, "A", "x"), ("2026-01-02", "B", "x")]
    got = clean.profile(spark.createDataFrame(rows, "date string, outlet_name string, item_name string"), "f")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "ExistingRDD" not in plan
    r = got.first()
    assert (r["min_date"], r["max_date"], r["outlets"], r["first_outlets"], r["items"]) == ("2026-01-01", "2026-01-02", 2, "A, B", 1)


def _local(path):
    return path.removeprefix("file://").removeprefix("file:")


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_csv_is_gzipped_in_files_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(io, "FILE_ROWS", 100)
    df = spark.range(0, 1000, 1, 2).selectExpr("concat(' a, ', id) AS x", "CAST(id AS string) AS n")
    path = io.scratch_path(spark, "gzip-test")
    io.write_csv(df, path)
    assert len(glob.glob(f"{_local(path)}/*.csv.gz")) == 10 and not glob.glob(f"{_local(path)}/*.csv")
    assert sorted(map(tuple, io.read_feed_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("write", [lambda df, path: io.staged(df, "freed-test"), io.write_csv,
                                   lambda df, path: io.write_sheets(df, path, ["Title"], sheets=2), io.load_table])
def test_shuffle_files_of_a_write_go_with_it(spark, write):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = _shuffle_files(spark), spark.conf.get(key)
    write(spark.range(5000).repartition(7, "id").selectExpr("CAST(id AS string) AS n"), io.scratch_path(spark, "freed-test"))
    until = time.time() + 20  # files go in the background
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and spark.conf.get(key) == conf


def test_write_counters_keep_the_written_feeds_and_one_raw_feed(spark):
    folder = f"{_local(checkpoint_dir(spark))}/tillroll"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = {r["feed"]: r for r in q_clean.e6_counters(spark, SF).collect()}
    new = {f.rsplit("-", 1)[0]: f for f in sorted(set(os.listdir(folder)) - before)}
    assert sorted(new) == sorted(["raw_feed", *[f"cleaned_{n}" for n in clean.SPECS]]) and len(set(os.listdir(folder)) - before) == 5
    for n, r in rows.items():
        assert io.read_feed_csv(spark, f"{folder}/{new[f'cleaned_{n}']}").count() == r["rows_after"] > 0
    assert rows["tax_charge"]["dropped"] > 0


def test_sheets_are_written_without_a_shuffle(spark):
    df = spark.range(0, 3000, 1, 5).select(F.spark_partition_id().cast("string").alias("task"), F.col("id").cast("string").alias("n"))
    path = io.scratch_path(spark, "sheets-by-task-test")
    io.write_sheets(df, path, ["Title", "", "a, b"], sheets=3, gzipped=True)
    assert len(glob.glob(f"{_local(path)}/sheet=*/*.txt.gz")) == 3 * (5 + 1)  # a sheet's file of each task, one of no rows
    back = io.read_feed_csv(spark, path, header_row=3)
    assert back.columns == ["task", "n"] and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tasks = spark.read.text(path).where("value rlike '^[0-9]'").groupBy(F.input_file_name()).agg(
        F.count_distinct(F.split_part("value", F.lit(","), F.lit(1))).alias("n"))
    assert tasks.agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_sheets_without_rows_keep_their_titles_and_header(spark, parts):
    df = spark.range(0, 1 if parts == 0 else 3, 1, max(parts, 1)).selectExpr("CAST(id AS string) AS x", "'b' AS `y, z`").where("x = '7'")
    df = df.limit(0) if parts == 0 else df
    path = io.scratch_path(spark, "empty-sheets-test")
    io.write_sheets(df, path, ["Title"], sheets=2)
    assert {r["value"] for r in spark.read.text(path).collect()} == {"Title", 'x,"y, z"'}
    assert len(glob.glob(f"{_local(path)}/sheet=*")) == 2
    back = io.read_feed_csv(spark, path, header_row=1)
    assert back.columns == ["x", "y, z"] and back.count() == 0


def test_one_task_writes_its_titles_once(spark):
    df = spark.range(0, 50, 1, 1).selectExpr("CAST(id AS string) AS n")
    path = io.scratch_path(spark, "one-task-test")
    io.write_sheets(df, path, ["Title"], sheets=2)
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"))
    assert lines.where("value = 'Title'").groupBy("f").count().agg(F.max("count")).first()[0] == 1
    assert lines.where("value rlike '^[0-9]'").count() == 50 == io.read_feed_csv(spark, path, header_row=1).distinct().count()
