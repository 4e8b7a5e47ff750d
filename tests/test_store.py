"""Operators give the same results on the materialised, month-partitioned fact."""

from fixtures import SF_MID
from tillroll.operators import anomaly, basket, kpi
from tillroll.sources import io, tables
from tillroll.sources.tables import sales, stored_sales


def test_stored_fact_matches_lazy_view(spark):
    path = io.scratch_path(spark, "sales_store_test")
    io.write_partitioned(sales(spark, SF_MID), path)
    stored = stored_sales(spark, path)
    lazy = sales(spark, SF_MID)
    args = kpi.KpiArgs.of(["ASIA", "EUROPE"], "1996-01-01", "1996-12-31")
    a = kpi.kpi_header(kpi.kpi_window(stored, args)).collect()
    b = kpi.kpi_header(kpi.kpi_window(lazy, args)).collect()
    assert a == b
    m1 = kpi.lowest_day_in_month(stored, "1997-08").collect()
    m2 = kpi.lowest_day_in_month(lazy, "1997-08").collect()
    assert m1 == m2
    x = anomaly.detect_anomalies(stored.drop("year_month"))
    y = anomaly.detect_anomalies(lazy)
    assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    plan = kpi.kpi_header(kpi.kpi_window(stored, args))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan


def test_every_date_filter_skips_months_and_keeps_its_rows(spark):
    path = io.scratch_path(spark, "sales_store_filters")
    lazy = sales(spark, SF_MID, ["ZONE", "PRODUCT", "PRODUCT_CLASS", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"])
    io.write_partitioned(lazy, path)
    stored = spark.read.parquet(path)
    filters = [lambda s: kpi.filter_days(s, ["1997-08-03", "1996-02-01"]), lambda s: kpi.filter_trailing(s, "1998-07-01"),
               lambda s: kpi.optional_filters(s, zone="ASIA", date_from="1996-03-05", date_to="1996-05-04")]
    for keep in filters:
        got, want = keep(stored), keep(lazy)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year_month" in plan or "PartitionFilters: [year_month" in plan
        assert got.drop("year_month").exceptAll(want).count() == 0 == want.exceptAll(got.drop("year_month")).count()


def test_a_month_that_holds_most_rows_is_written_by_many_tasks(spark):
    path = io.scratch_path(spark, "sales_store_hot")
    rows = spark.range(20000).selectExpr("'ASIA' AS ZONE", "'one' AS PRODUCT", "id AS INVOICE_NO",
                                         "DATE'1997-08-01' AS INVOICE_DATE")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_partitioned(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(path).selectExpr("input_file_name() AS f").groupBy("f").count()
    assert files.count() > 1 and files.agg({"count": "max"}).first()[0] < 10000


def test_catalog_report_counts_each_named_table(spark):
    spark.range(3).createOrReplaceTempView("probe_three")
    spark.range(0).createOrReplaceTempView("probe_none")
    rows = {r["table"]: (r["rows"], r["n_columns"], r["columns"]) for r in io.catalog_report(spark, "probe_").collect()}
    assert rows == {"probe_three": (3, 1, "id bigint"), "probe_none": (0, 1, "id bigint")}


def test_large_tables_are_joined_in_tasks_that_grow_with_the_lines(spark, monkeypatch):
    cols = ["INVOICE_NO", "LINE_NO", "PRODUCT", "STOCKIEST", "ZONE", "NET_AMT"]
    want = tables.sales(spark, SF_MID, cols).collect()
    monkeypatch.setattr(tables, "LARGE", 50)
    monkeypatch.setattr(tables, "TASK_LINES", 2000)
    dealt = tables.sales(spark, SF_MID, cols)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, want))
    assert dealt.rdd.getNumPartitions() >= len(want) // 2000  # no merged partitions


def test_bills_of_large_tables_are_summed_where_the_orders_are_joined(spark, monkeypatch):
    cols = ["INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS"]
    want = basket.bill_items(tables.sales(spark, SF_MID, cols)).collect()
    monkeypatch.setattr(tables, "LARGE", 50)
    monkeypatch.setattr(tables, "TASK_LINES", 2000)
    dealt = basket.bill_items(tables.sales(spark, SF_MID, cols))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, want))
    n_lines = tables.read_table(spark, SF_MID, "lineitem").count()
    assert dealt.rdd.getNumPartitions() == -(-n_lines // 2000)  # no shuffle after that of the orders
