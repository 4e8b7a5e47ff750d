"""Plan-shape checks for the scale properties the operators rely on."""

from pyspark.sql import functions as F

from fixtures import SF_MID
from tillroll.operators import basket, kpi
from tillroll.sources.tables import sales


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_filter_reaches_orders_scan(spark):
    s = sales(spark, SF_MID, ["ZONE", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"])
    p = _plan(kpi.kpi_header(kpi.filter_dates(s, "1996-01-01", "1996-12-31").withColumn("TOTAL_VOLUME_BILLED_LTR", F.lit(0)).withColumn("QTY_PACKS", F.lit(0))))
    assert "o_orderdate" in p and "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_unused_dimensions_not_joined_and_columns_pruned(spark):
    s = sales(spark, SF_MID, ["INVOICE_DATE", "NET_AMT"])
    p = _plan(kpi.daily_lines(s))
    assert "part.parquet" not in p and "supplier.parquet" not in p and "customer.parquet" not in p
    # lineitem is read with only the columns the plan needs
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p


def test_no_python_in_hot_paths(spark):
    import __spark_entry__ as e

    q = e.queries()
    for name in ["A1_kpi_header", "N4_anomalies_all_zones", "B2_affinity_pairs_top30", "T2_J9_numeric_audit", "E4_standardise_tax_charge"]:
        p = _plan(q[name](spark, SF_MID))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_block_split_pairs_equal_plain_pairs(spark):
    bi = basket.bill_items(sales(spark, SF_MID, ["INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS"]))
    a = basket.pair_counts(bi, block=512)
    b = basket.pair_counts(bi, block=1)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fk_join_elimination_keeps_rows(spark):
    assert sales(spark, SF_MID, ["INVOICE_NO"]).count() == sales(spark, SF_MID).count()


def test_survey_golden_values(spark):
    bi = basket.bill_items(sales(spark, SF_MID, ["INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS"]))
    top = basket.affinity_pairs(bi).first()
    assert (top["item_a"], top["item_b"], top["co_count"], top["support"], top["lift"]) == ("hot widget", "old plate", 58, 0.0039, 1.419)
    z = kpi.revenue_by_zone(sales(spark, SF_MID, ["ZONE", "INVOICE_NO", "NET_AMT"])).first()
    assert (z["outlet_name"], z["revenue"], z["orders"]) == ("ASIA", 621949858.22, 3044)
