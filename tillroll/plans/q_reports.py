"""Registered composite reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tillroll.operators import anomaly, basket, reports
from tillroll.plans import q_anomaly, q_basket, q_context  # noqa: F401  (their oracles are parts of these)
from tillroll.plans.q_kpi import D0, D1, ZONES
from tillroll.plans.registry import ORACLES, register, sales_of
from tillroll.sources import context_feed as cf
from tillroll.sources import io


_TAB = {  # section -> the columns of its table, from the queries of the single tables
    "kpi": ORACLES["A1_kpi_header"], "top5": ORACLES["A2_top5_products"], "by_zone": ORACLES["A3_revenue_by_zone"],
    "daily": ORACLES["A4_daily_trend"], "raw": ORACLES["F13_raw_lines"],
}


@register("R1_kpi_tab_bundle", "\nUNION ALL BY NAME\n".join(
    f"SELECT '{name}' AS section, * FROM ({sql})" for name, sql in _TAB.items()))
def r1(spark, sf):
    """All five tables of the tab in full, told apart by ``section``."""
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "INVOICE_NO", "NET_AMT", "QTY_PACKS", "TOTAL_VOLUME_BILLED_LTR",
                 "PRODUCT", "CHANNEL", "PRODUCT_CLASS")
    tab = reports.kpi_tab(s, list(ZONES), D0, D1, io.scratch_path(spark, "kpi_window"))
    parts = [getattr(tab, name).withColumn("section", F.lit(name)) for name in _TAB]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _brief_sql() -> str:
    n = lambda x: f"format('{{:,}}', CAST(ROUND(CAST({x} AS DECIMAL(38,6)), 0) AS BIGINT))"
    one = lambda x: f"printf('%.1f', CAST(ROUND(CAST({x} AS DECIMAL(38,6)), 1) AS DOUBLE))"
    return f"""
SELECT 'revenue_anomaly' AS signal, date || '  ' || direction || ' avg by ' || {one("abs(z_score)")} || 'σ  (₹' || {n("revenue")}
       || ' vs avg ₹' || {n("mean_rev")} || ')' AS label, date, z_score AS value FROM ({ORACLES["N5_series_outlier_day"]})
UNION ALL
SELECT 'top_power_combo', 'Lift ' || {one("lift")} || 'x — ' || left(item_a, 22) || ' + ' || left(item_b, 22) || ' → Bundle ₹'
       || {n("bundle_price")} || '  AOV +' || {n("aov_lift_pct")} || '%', NULL, bundle_price
FROM (SELECT * FROM ({ORACLES["B4_power_combos"]}) ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 1)
UNION ALL
SELECT 'market_risk', label, date, NULL FROM ({ORACLES["C9_market_risk"]})"""


@register("R2_proactive_brief", _brief_sql())
def r2(spark, sf):
    from tillroll.plans.q_basket import _combos
    combos = _combos(spark, sf)[0]
    return reports.proactive_brief(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), combos, cf.context_feed(spark, sf))


def _morning_sql() -> str:
    live = ORACLES["B5_live_basket"]
    start, end = live.index("f AS (SELECT * FROM sales WHERE"), live.index("bi AS (SELECT INVOICE_NO")
    live = live[:start] + "f AS (SELECT * FROM sales),\n" + live[end:].replace("LIMIT 8", "LIMIT 5")
    return f"""
WITH told AS (SELECT outlet_name || ': ' || left(diagnosis, 60) AS t FROM ({ORACLES["N6_cause_rows"]}) ORDER BY 1 LIMIT 200),
best AS ({live})
SELECT CAST(0 AS BIGINT) AS batch, 'morning' AS timestamp, anomaly_count, outlets_flagged,
       left((SELECT string_agg(t, '; ' ORDER BY t) FROM told), 200) AS root_cause_summary, 'LOGGED' AS email_status, '' AS recipient,
       (SELECT string_agg(printf('%s + %s → ₹%.0f', item_a, item_b, bundle_price), '; ' ORDER BY lift DESC, co_count DESC, item_a, item_b)
        FROM best) AS bundles
FROM ({ORACLES["N6_alert_digest"]})"""


@register("R3_morning_brief", _morning_sql())
def r3(spark, sf):
    an = io.staged(anomaly.detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")), "anomalies")
    ctx = io.staged(cf.context_feed(spark, sf), "context")  # both are read by several steps
    top = basket.live_basket(sales_of(spark, sf, "INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS"), top_n=5)
    brief = reports.morning_brief(an, ctx, cf.holiday_table(cf.sales_dates(spark, sf)), top)
    digest = io.load_table(brief, io.scratch_path(spark, "morning_brief"))
    path = io.scratch_path(spark, "morning_brief_history")
    io.log_notification(digest.select(
        F.lit("morning").alias("timestamp"), "anomaly_count", "outlets_flagged",
        F.col("root_causes").alias("root_cause"), F.lit("LOGGED").alias("email_status"), F.lit("").alias("recipient")), path, 0)
    return io.notification_history(spark, path, 5).drop("logged_at").join(digest.select("bundles"), how="inner")
