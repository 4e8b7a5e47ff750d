"""Registered source / sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str
from tillroll.operators import anomaly, basket, clean
from tillroll.plans.q_anomaly import _cl_cte
from tillroll.plans.q_basket import _PAIRS
from tillroll.plans.q_clean import _VALID, cleaned, read_raw, standardise_sql
from tillroll.plans import q_audit  # noqa: F401  (its tags are traced)
from tillroll.plans.registry import ORACLES, register, sales_of, with_sales
from tillroll.sources import io
from tillroll.sources import raw_feeds as rf
from tillroll.sources.tables import ALL_COLUMNS, read_table, sales

_MONEY_COLS = {"PRODUCT_MRP", "BASIC_RATE", "QTY_PACKS", "GROSS_AMT", "NET_AMT", "SCHEME_AMT", "GRP_SCHEME_AMT", "TOTAL_VOLUME_BILLED_LTR"}


def _scan_select(prefix: str = "") -> list[str]:
    out = []
    for c in ALL_COLUMNS:
        if c == "INVOICE_DATE":
            out.append(f"CAST({prefix}{c} AS VARCHAR) AS {c}")
        elif c in _MONEY_COLS:
            out.append(f"CAST({prefix}{c} AS DOUBLE) AS {c}")
        else:
            out.append(f"{prefix}{c}")
    return out


@register("S1_scan_sales", with_sales("SELECT " + ", ".join(_scan_select()) + " FROM sales"))
def s1(spark, sf):
    s = sales(spark, sf)
    return s.select(*[
        day_str(c).alias(c) if c == "INVOICE_DATE" else (F.col(c).cast("double").alias(c) if c in _MONEY_COLS else F.col(c))
        for c in ALL_COLUMNS
    ])


_RAW_TAX = f"raw AS ({rf.feed_sql('tax_charge')})"
_NOT_EMPTY = " OR ".join(f'"{h}" IS NOT NULL' for h in rf.RAW_HEADERS["tax_charge"])
_TITLES = ["Tax charge report", "", "All outlets, one row a bill line"]
_NUMBERS = ("Bill No", "BaiscRate", "Sales Qty", "CGST Amt", "SGST Amt", "Total GST Amt")  # the columns whose values are all numbers


def _typed_sql(typed: bool) -> str:
    cols = [(h, h.strip()) for h in rf.RAW_HEADERS["tax_charge"]]
    return ", ".join(f'CAST("{h}" AS DOUBLE) AS "{n}"' if typed and n in _NUMBERS else f'"{h}" AS "{n}"' for h, n in cols)


@register("S2_S3_read_feed_csv", with_sales(f"WITH {_RAW_TAX}\nSELECT {_typed_sql(False)} FROM raw WHERE {_NOT_EMPTY}"))
def s2(spark, sf):
    path = io.scratch_path(spark, "raw_tax_charge_csv")
    io.write_csv(rf.tax_charge_feed(spark, sf), path)
    return io.read_feed_csv(spark, path)


@register("S2_S3_S4_S5_load_chain", with_sales(f"WITH {_RAW_TAX}\nSELECT {_typed_sql(True)} FROM raw WHERE {_NOT_EMPTY}"))
def load_chain(spark, sf):
    """Sheets with titles above the header → strings → column typing → replacing load, read back."""
    path, table = io.scratch_path(spark, "tax_charge_sheets"), io.scratch_path(spark, "tax_charge_table")
    io.write_sheets(rf.tax_charge_feed(spark, sf), path, _TITLES, sheets=4, gzipped=True)
    strings = io.read_feed_csv(spark, path, header_row=len(_TITLES))
    return io.load_table(io.apply_numeric_typing(strings), table)


@register("S4_numeric_typing", with_sales(f"WITH {_RAW_TAX}\n" + "\nUNION ALL\n".join(
    f"SELECT '{h.strip()}' AS column, COUNT(*) FILTER (WHERE \"{h}\" IS NOT NULL AND TRY_CAST(\"{h}\" AS DOUBLE) IS NULL) = 0 AS numeric FROM raw"
    for h in rf.RAW_HEADERS["tax_charge"])))
def s4(spark, sf):
    return io.numeric_columns(read_raw(spark, sf, "tax_charge"))


@register("S5_idempotent_load", with_sales(f"WITH {standardise_sql('tax_charge')}\nSELECT COUNT(*) AS rows FROM std_tax_charge WHERE {_VALID}"))
def s5(spark, sf):
    path = io.scratch_path(spark, "cleaned_sales_items")
    df = clean.validate(cleaned(spark, sf, "tax_charge"))
    io.load_table(df, path)
    back = io.load_table(df, path)  # second load replaces the first
    return back.agg(F.count(F.lit(1)).alias("rows"))


@register("S6_partitioned_layout", with_sales("""
SELECT strftime(INVOICE_DATE, '%Y-%m') AS year_month, ZONE, COUNT(*) AS lines, COUNT(DISTINCT PRODUCT) AS products,
       CAST(ROUND(SUM(NET_AMT), 2) AS DOUBLE) AS revenue FROM sales GROUP BY ALL"""))
def s6(spark, sf):
    path = io.scratch_path(spark, "sales_by_month")
    io.write_partitioned(sales_of(spark, sf, "ZONE", "PRODUCT", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), path)
    return spark.read.parquet(path).groupBy("year_month", "ZONE").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("PRODUCT").alias("products"),
        F.round(F.sum("NET_AMT"), 2).cast("double").alias("revenue"))


@register("S7_csv_sink", with_sales(f"WITH {standardise_sql('hourly')}\nSELECT * REPLACE (COALESCE(net_revenue, 0.0) AS net_revenue) FROM std_hourly WHERE {_VALID}"))
def s7(spark, sf):
    path = io.scratch_path(spark, "cleaned_hourly_items_csv")
    std = cleaned(spark, sf, "hourly")
    io.write_valid_csv(std, clean.valid_outlet(std), path)
    back = io.read_feed_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("double") for c in ("net_revenue", "quantity")})


@register("S8_json_results_roundtrip", with_sales(_PAIRS + "\nSELECT * FROM pairs ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 30"))
def s8(spark, sf):
    pairs = basket.affinity_pairs(basket.bill_items(sales_of(spark, sf, "INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS")))
    path = io.scratch_path(spark, "basket_results_json")
    io.write_json(pairs, path)
    schema = "item_a string, item_b string, co_count bigint, support double, conf_a_b double, conf_b_a double, lift double"
    return io.read_json(spark, path, schema)


@register("S11_trace_append", with_sales("WITH tags AS (" + ORACLES["T6_T7_T8_T9_intent_tags"] + """)
SELECT run, question_id, intent, TRUE AS stamped FROM tags CROSS JOIN (VALUES (1), (2)) r(run)"""))
def s11(spark, sf):
    """Every traced row of two appends, read back."""
    from tillroll.operators.audit import tag_questions
    from tillroll.operators.kpi import zone_bounds
    from tillroll.sources.question_log import question_log
    path = io.scratch_path(spark, "copilot_trace")
    tags = io.staged(tag_questions(question_log(spark, sf), zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE")))
                     .select("question_id", "intent"), "tags")
    for run in (1, 2):
        io.append_trace(tags.withColumn("run", F.lit(run)), path)
    back = spark.read.schema("question_id string, intent string, run int, ts string").json(path)
    stamp = F.col("ts").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[.]\d{6}Z$")
    return back.select("run", "question_id", "intent", F.coalesce(stamp, F.lit(False)).alias("stamped"))


def _digest_sql(batch: int, stamp: str, group: str = "") -> str:
    return f"""SELECT CAST({batch} AS BIGINT) AS batch, {stamp} AS timestamp, COUNT(*) AS anomaly_count,
       string_agg(DISTINCT ZONE, ', ' ORDER BY ZONE) AS outlets_flagged,
       CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS label
FROM cl WHERE severity IS NOT NULL {group}"""


@register("S12_alert_history_last5", with_sales(_cl_cte(-1.5) + f""",
h AS ({_digest_sql(0, "strftime(INVOICE_DATE, '%Y')", "GROUP BY ALL")} UNION ALL {_digest_sql(1, "'all'")})
SELECT batch, timestamp, anomaly_count, outlets_flagged, LEFT(label || ': ' || outlets_flagged, 200) AS root_cause_summary,
       'LOGGED' AS email_status, '' AS recipient
FROM h ORDER BY batch DESC, timestamp DESC LIMIT 5"""))
def s12(spark, sf):
    an = anomaly.detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"))
    path = io.scratch_path(spark, "notification_history")

    def rows(d, stamp):
        return d.select(
            stamp.alias("timestamp"), "anomaly_count", "outlets_flagged",
            F.concat_ws(": ", F.col("severity_label"), F.col("outlets_flagged")).alias("root_cause"),
            F.lit("LOGGED").alias("email_status"), F.lit("").alias("recipient"),
        )

    # history of one digest per data year (first append), then the all-time digest
    per_year = anomaly.alert_digest(an.withColumn("year", F.substring("date", 1, 4)), by=["year"])
    io.log_notification(rows(per_year, F.col("year")), path, batch=0)
    io.log_notification(rows(anomaly.alert_digest(an), F.lit("all")), path, batch=1)
    return io.notification_history(spark, path, 5).drop("logged_at")


_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


@register("S13_catalog_report", "\nUNION ALL\n".join(
    f"SELECT 'tr_{t}' AS \"table\", COUNT(*) AS rows, {c.count(',') + 1} AS n_columns, '{c}' AS columns FROM {t}"
    for t, c in _TABLES.items()))
def s13(spark, sf):
    for name in _TABLES:
        read_table(spark, sf, name).createOrReplaceTempView(f"tr_{name}")
    return io.catalog_report(spark, "tr_")
