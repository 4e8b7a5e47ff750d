"""Composite reports: R1 (KPI tab bundle), R2 (proactive brief), R3 (morning brief data)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import rnd
from tillroll.operators import anomaly, context, kpi
from tillroll.sources import io


@dataclass
class KpiTab:
    kpi: DataFrame
    top5: DataFrame
    by_zone: DataFrame
    daily: DataFrame
    raw: DataFrame


def kpi_tab(sales: DataFrame, zones, date_start: str, date_end: str, store: str) -> KpiTab | None:
    """R1 — five results over one filtered, column-pruned window, written to ``store`` once so that
    the joined fact is read a single time and no cache is left behind.  An empty zone list means
    no results (F12)."""
    args = kpi.KpiArgs.of(list(zones), date_start, date_end)
    if not args.zones:
        return None
    f = io.load_table(kpi.kpi_window(sales, args), store)
    return KpiTab(kpi.kpi_header(f), kpi.top_products(f), kpi.revenue_by_zone(f), kpi.daily_trend(f), kpi.raw_lines(f))


def proactive_brief(sales_days: DataFrame, combos: DataFrame, ctx: DataFrame) -> DataFrame:
    """R2 — (signal, label, date, value): the series outlier day (W4), the first power
    combo (B4) and the latest market-risk row (C9), each a one-row frame, unioned."""
    out = anomaly.series_outlier(sales_days)
    z = rnd(F.abs(F.col("z_score")), 1)
    a = out.select(
        F.lit("revenue_anomaly").alias("signal"),
        F.concat(F.col("date"), F.lit("  "), F.col("direction"), F.lit(" avg by "), F.format_string("%.1f", z), F.lit("σ  (₹"),
                 F.format_number(rnd(F.col("revenue"), 0), 0), F.lit(" vs avg ₹"), F.format_number(F.col("mean_rev"), 0), F.lit(")")).alias("label"),
        F.col("date"), F.col("z_score").alias("value"),
    )
    first = combos.orderBy(F.col("lift").desc(), F.col("co_count").desc(), "item_a", "item_b").limit(1)
    b = first.select(
        F.lit("top_power_combo").alias("signal"),
        F.concat(F.lit("Lift "), F.format_string("%.1f", rnd(F.col("lift"), 1)), F.lit("x — "), F.left("item_a", F.lit(22)), F.lit(" + "),
                 F.left("item_b", F.lit(22)), F.lit(" → Bundle ₹"), F.format_number(rnd(F.col("bundle_price"), 0), 0),
                 F.lit("  AOV +"), F.format_number(rnd(F.col("aov_lift_pct"), 0), 0), F.lit("%")).alias("label"),
        F.lit(None).cast("string").alias("date"), F.col("bundle_price").alias("value"),
    )
    c = context.market_risk(ctx).select(
        F.lit("market_risk").alias("signal"), "label", "date", F.lit(None).cast("double").alias("value"))
    return a.unionByName(b).unionByName(c)


def bundle_lines(basket: DataFrame) -> DataFrame:
    """The live basket's few top pairs (B5) as one line of text, best first."""
    best = F.struct((-F.col("lift")).alias("l"), (-F.col("co_count")).alias("c"), "item_a", "item_b", "bundle_price")
    line = lambda p: F.format_string("%s + %s → ₹%.0f", p.item_a, p.item_b, p.bundle_price)
    return basket.agg(F.array_join(F.transform(F.array_sort(F.collect_list(best)), line), "; ").alias("bundles"))


def morning_brief(anomalies: DataFrame, ctx: DataFrame, holidays: DataFrame, basket: DataFrame) -> DataFrame:
    """R3 — N4 anomalies → N7 context → per-anomaly cause text → N6 digest with causes, beside the
    bundles recommended by the live basket (B5, a top list).

    The cause text stands in for the prose step (not built): condition, holiday and the
    news kind of the anomaly's date."""
    causes = anomaly.cause_rows(context.enrich_anomalies(anomalies, ctx, holidays))
    return anomaly.alert_digest(anomalies, causes).join(bundle_lines(basket), how="inner")
