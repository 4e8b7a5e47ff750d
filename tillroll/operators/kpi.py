"""Filters (F*), aggregates (A*), top-k (O1), top item per zone (W2), share of leader.

Every function is DataFrame in → DataFrame out and lazy.  ``rev`` means
``round(sum(NET_AMT), 2)``; ``orders`` means ``count(distinct INVOICE_NO)``.

Scale notes
-----------
* A ``count(distinct …)`` is planned by Catalyst as a partial aggregate keyed by
  (group, value) followed by a second aggregate: the distinct set is never gathered in
  one task.  Several distinct counts in one result (A17, A22) stay in one aggregate:
  Spark expands each scanned line once per distinct column and pre-aggregates map-side,
  which is cheaper than re-reading the joined fact once per count.
* Global windows (W5) only ever see already-aggregated rows (a handful per day/zone).
* Top-k uses ``orderBy().limit(k)`` → ``TakeOrderedAndProject``: each task keeps k rows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import (contains_ci, crores, day_str, equals_ci, fdiv, lakhs, money, non_empty, rnd,
                                      weekday_name)

# ── F12: argument contract ─────────────────────────────────────────────────────
@dataclass(frozen=True)
class KpiArgs:
    zones: tuple[str, ...]
    date_start: str
    date_end: str

    @staticmethod
    def of(zones, date_start: str, date_end: str) -> "KpiArgs":
        zs = tuple(str(z).strip() for z in (zones if isinstance(zones, (list, tuple)) else []) if str(z).strip())
        for d in (date_start, date_end):
            if not d:
                raise ValueError("a window needs both dates, as YYYY-MM-DD")
            _dt.date.fromisoformat(d)
        if zs and date_start > date_end:
            raise ValueError(f"the window ends ({date_end}) before it starts ({date_start})")
        return KpiArgs(zs, date_start, date_end)


# ── F1–F5, F8 ──────────────────────────────────────────────────────────────────
def filter_zones(sales: DataFrame, zones) -> DataFrame:
    """F1 — ``ZONE IN (...)``, which reaches the scan."""
    return sales.filter(F.col("ZONE").isin(list(zones)))


def _month_prune(sales: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """On a month-partitioned store, add the implied ``year_month`` range so whole month
    directories are skipped (the date predicate itself stays exact)."""
    if "year_month" not in sales.columns:
        return sales
    if lo:
        sales = sales.filter(F.col("year_month") >= F.lit(lo[:7]))
    if hi:
        sales = sales.filter(F.col("year_month") <= F.lit(hi[:7]))
    return sales


def filter_dates(sales: DataFrame, date_start: str, date_end: str) -> DataFrame:
    """F2 — inclusive date window (pushed to the orders scan as a range; on a stored,
    month-partitioned fact also pruned by partition)."""
    return _month_prune(sales, date_start, date_end).filter(
        F.col("INVOICE_DATE").between(F.lit(date_start).cast("date"), F.lit(date_end).cast("date")))


def filter_days(sales: DataFrame, days) -> DataFrame:
    """F3 — date equality / ``IN`` list."""
    if "year_month" in sales.columns:
        sales = sales.filter(F.col("year_month").isin(sorted({str(d)[:7] for d in days})))
    return sales.filter(F.col("INVOICE_DATE").isin([F.lit(d).cast("date") for d in days]))


def filter_month(sales: DataFrame, month: str) -> DataFrame:
    """F4 — ``YYYY-MM``, written as a half-open date range so scans can prune."""
    first = _dt.date.fromisoformat(month + "-01")
    nxt = (first.replace(day=28) + _dt.timedelta(days=4)).replace(day=1)
    return _month_prune(sales, month, month).filter((F.col("INVOICE_DATE") >= F.lit(first)) & (F.col("INVOICE_DATE") < F.lit(nxt)))


def filter_trailing(sales: DataFrame, target: str, days: int = 90) -> DataFrame:
    """F5 — lower bound only: ``d >= target - days`` (no upper bound, as in the source)."""
    first = _dt.date.fromisoformat(str(target)) - _dt.timedelta(days=days)
    return _month_prune(sales, first.isoformat(), None).filter(F.col("INVOICE_DATE") >= F.lit(first))


def optional_filters(sales: DataFrame, zone: str = "", date_from: str = "", date_to: str = "", group: str = "") -> DataFrame:
    """F8 — blank argument means no filter; F7 for the group text."""
    out = _month_prune(sales, date_from.strip() or None, date_to.strip() or None)
    if zone.strip():
        out = out.filter(F.col("ZONE") == zone.strip())
    if date_from.strip():
        out = out.filter(F.col("INVOICE_DATE") >= F.lit(date_from.strip()).cast("date"))
    if date_to.strip():
        out = out.filter(F.col("INVOICE_DATE") <= F.lit(date_to.strip()).cast("date"))
    if group.strip():
        out = out.filter(contains_ci(["PRODUCT_CLASS", "PRODUCT"], group.strip()))
    return out


def kpi_window(sales: DataFrame, args: KpiArgs) -> DataFrame:
    return filter_dates(filter_zones(sales, args.zones), args.date_start, args.date_end)


def _rev(c: str = "NET_AMT"):
    return F.coalesce(money(F.sum(c)), F.lit(0.0))


def _orders():
    return F.count_distinct("INVOICE_NO")


# ── A1–A5, F13 (KPI tab) ───────────────────────────────────────────────────────
def kpi_header(filtered: DataFrame) -> DataFrame:
    """A1 — revenue, orders, AOV, packs, litres; zero (not null) on an empty window."""
    return filtered.agg(
        _rev().alias("total_revenue"),
        _orders().alias("total_orders"),
        F.coalesce(money(F.sum("NET_AMT") / F.nullif(_orders(), F.lit(0))), F.lit(0.0)).alias("aov"),
        F.coalesce(F.sum("QTY_PACKS").cast("double"), F.lit(0.0)).alias("total_packs"),
        F.coalesce(money(F.sum("TOTAL_VOLUME_BILLED_LTR"), 0), F.lit(0.0)).alias("total_volume_ltr"),
    )


def top_products(filtered: DataFrame, k: int = 5) -> DataFrame:
    """A2 / O1 — top-k products by rounded revenue (ties: product name)."""
    return (
        filtered.filter(F.col("PRODUCT").isNotNull())
        .groupBy(F.col("PRODUCT").alias("item_name"))
        .agg(_rev().alias("revenue"), F.sum("QTY_PACKS").cast("double").alias("qty"))
        .orderBy(F.col("revenue").desc(), F.col("item_name"))
        .limit(k)
    )


def revenue_by_zone(filtered: DataFrame) -> DataFrame:
    """A3 — revenue and orders per zone, descending."""
    return (
        filtered.groupBy(F.col("ZONE").alias("outlet_name"))
        .agg(_rev().alias("revenue"), _orders().alias("orders"))
        .orderBy(F.col("revenue").desc())
    )


def daily_trend(filtered: DataFrame) -> DataFrame:
    """A4 — revenue and orders per day."""
    return (
        filtered.groupBy(day_str("INVOICE_DATE").alias("date"))
        .agg(_rev().alias("revenue"), _orders().alias("orders"))
        .orderBy("date")
    )


def raw_lines(filtered: DataFrame) -> DataFrame:
    """F13 — raw-line projection with renames, ordered by date, zone."""
    return filtered.select(
        day_str("INVOICE_DATE").alias("date"),
        F.col("ZONE").alias("outlet_name"),
        F.col("PRODUCT").alias("item_name"),
        F.col("NET_AMT").cast("double").alias("net_revenue"),
        F.col("QTY_PACKS").cast("double").alias("quantity"),
        F.col("CHANNEL").alias("channel"),
        F.col("INVOICE_NO").alias("bill_no"),
        F.col("PRODUCT_CLASS").alias("product_group"),
    ).orderBy("date", "outlet_name")


def revenue_units(sales: DataFrame) -> DataFrame:
    """Revenue per zone in rupees, lakhs and crores (2 digits)."""
    rupees = F.sum("NET_AMT").cast("double")
    return sales.groupBy(F.col("ZONE").alias("outlet_name")).agg(
        rnd(rupees, 2).alias("revenue"), rnd(lakhs(rupees), 2).alias("revenue_lakh"), rnd(crores(rupees), 2).alias("revenue_cr"))


def window_totals(filtered: DataFrame) -> DataFrame:
    """A5 — total revenue, orders, AOV in a window."""
    return filtered.agg(
        _rev().alias("total_revenue"),
        _orders().alias("total_orders"),
        F.coalesce(money(F.sum("NET_AMT") / F.nullif(_orders(), F.lit(0))), F.lit(0.0)).alias("aov"),
    )


# ── A6–A14 (question templates) ────────────────────────────────────────────────
def single_day_total(sales: DataFrame, day: str) -> DataFrame:
    """A6 — one day, rounded to units; null (no IFNULL) when the day has no rows."""
    return filter_days(sales, [day]).agg(
        money(F.sum("NET_AMT"), 0).alias("total_revenue"), _orders().alias("orders")
    )


def decline_pair(sales: DataFrame, day: str) -> DataFrame:
    """A7 — chain total (rounded 0) and per-zone split (rounded 2) in one pass.

    ``GROUPING SETS ((), (ZONE))``: one scan, one shuffle; ``outlet_name`` is null on the
    chain row.
    """
    f = filter_days(sales, [day])
    g = f.groupingSets([[], ["ZONE"]], "ZONE").agg(
        F.sum("NET_AMT").alias("s"), _orders().alias("orders"), F.grouping("ZONE").alias("g")
    )
    return g.select(
        F.when(F.col("g") == 1, F.lit("chain")).otherwise(F.lit("zone")).alias("level"),
        F.col("ZONE").alias("outlet_name"),
        F.when(F.col("g") == 1, money("s", 0)).otherwise(F.coalesce(money("s"), F.lit(0.0))).alias("revenue"),
        F.col("orders"),
    )


def compare_days(sales: DataFrame, d1: str, d2: str) -> DataFrame:
    """A8 — revenue and orders for two dates."""
    return (
        filter_days(sales, [d1, d2])
        .groupBy(day_str("INVOICE_DATE").alias("day"))
        .agg(_rev().alias("total_revenue"), _orders().alias("orders"))
        .orderBy("day")
    )


def compare_zones(sales: DataFrame, a: str, b: str, date_start: str, date_end: str) -> DataFrame:
    """A9 — two zones over a window."""
    return revenue_by_zone(filter_dates(filter_zones(sales, [a, b]), date_start, date_end))


def _day_totals(sales: DataFrame) -> DataFrame:
    return sales.groupBy(day_str("INVOICE_DATE").alias("day")).agg(_rev().alias("total_revenue"))


def worst_day(filtered: DataFrame) -> DataFrame:
    """A10 — lowest-revenue day (ties: earliest)."""
    return _day_totals(filtered).orderBy(F.col("total_revenue").asc(), F.col("day")).limit(1)


def best_day(filtered: DataFrame) -> DataFrame:
    """A11 — highest-revenue day (ties: earliest)."""
    return _day_totals(filtered).orderBy(F.col("total_revenue").desc(), F.col("day")).limit(1)


def top_days(filtered: DataFrame, k: int = 6) -> DataFrame:
    """A12 — top-k revenue days (rounded to units) as a baseline."""
    daily = filtered.groupBy(day_str("INVOICE_DATE").alias("day")).agg(
        F.coalesce(money(F.sum("NET_AMT"), 0), F.lit(0.0)).alias("total_revenue")
    )
    return daily.orderBy(F.col("total_revenue").desc(), F.col("day")).limit(k)


def revenue_by_state_on(sales: DataFrame, day: str) -> DataFrame:
    """A13 — revenue per state on one date."""
    return (
        filter_days(sales, [day])
        .groupBy("STATE")
        .agg(money(F.sum("NET_AMT"), 0).alias("revenue"))
        .orderBy(F.col("revenue").desc())
    )


def lowest_day_in_month(sales: DataFrame, month: str) -> DataFrame:
    """A14 — F4 + A10 (rounded to units as in the source prompt)."""
    daily = filter_month(sales, month).groupBy(day_str("INVOICE_DATE").alias("date")).agg(
        money(F.sum("NET_AMT"), 0).alias("total_revenue")
    )
    return daily.orderBy(F.col("total_revenue").asc(), F.col("date")).limit(1)


# ── A15–A23 ────────────────────────────────────────────────────────────────────
def weekday_means(sales: DataFrame) -> DataFrame:
    """A15 — mean of daily totals per weekday name (two-level aggregate)."""
    daily = sales.groupBy(F.col("INVOICE_DATE").alias("d")).agg(F.sum("NET_AMT").alias("total"))
    return (
        daily.groupBy(weekday_name("d").alias("day_of_week"))
        .agg(money(F.avg("total"), 0).alias("avg_daily_revenue"))
        .orderBy(F.col("avg_daily_revenue").desc())
    )


def rollup(sales: DataFrame, dims: list[str]) -> DataFrame:
    """A16 — revenue / orders / lines by any listed dimension(s)."""
    return (
        sales.groupBy(*dims)
        .agg(_rev().alias("revenue"), _orders().alias("orders"), F.count(F.lit(1)).alias("lines"))
        .orderBy(F.col("revenue").desc())
    )


def coverage(sales: DataFrame, by: str | None = None) -> DataFrame:
    """A17 — billed outlets (distinct customers), distinct stockiests, invoices.

    BEAT does not exist in the driver data; STOCKIEST is the distribution key counted.
    One scan of the fact: Spark expands each line once per distinct column and
    pre-aggregates (group, value) pairs map-side before the shuffle.
    """
    g = sales.groupBy(by) if by else sales
    return g.agg(
        F.count_distinct("CUSTOMER").alias("billed_outlets"),
        F.count_distinct("STOCKIEST").alias("stockiests"),
        F.count_distinct("INVOICE_NO").alias("invoices"),
    )


def scheme_totals(sales: DataFrame) -> DataFrame:
    """A18 — ``SUM(SCHEME_AMT)``, ``SUM(GRP_SCHEME_AMT)`` per zone."""
    return sales.groupBy("ZONE").agg(
        F.coalesce(money(F.sum("SCHEME_AMT")), F.lit(0.0)).alias("scheme_amt"),
        F.coalesce(money(F.sum("GRP_SCHEME_AMT")), F.lit(0.0)).alias("grp_scheme_amt"),
    )


def month_over_month(sales: DataFrame) -> DataFrame:
    """A19 — revenue per month and change vs the previous month (window on months only)."""
    monthly = sales.groupBy(F.date_format("INVOICE_DATE", "yyyy-MM").alias("month")).agg(
        _rev().alias("revenue"), _orders().alias("orders")
    )
    w = Window.orderBy("month")
    prev = F.lag("revenue").over(w)
    return monthly.select(
        "month", "revenue", "orders",
        prev.alias("prev_revenue"),
        F.round((F.col("revenue") - prev) / F.nullif(prev, F.lit(0.0)) * 100, 1).alias("mom_pct"),
    )


def zone_bounds(sales: DataFrame) -> DataFrame:
    """A20 — zone list (non-empty, sorted) and date extrema; 2026-01-01 when empty."""
    zones = sales.select("ZONE").filter(non_empty("ZONE")).distinct()
    ext = sales.agg(F.min("INVOICE_DATE").alias("mn"), F.max("INVOICE_DATE").alias("mx"))
    default = F.lit("2026-01-01").cast("date")
    ext = ext.select(
        F.coalesce("mn", default).alias("mn"), F.coalesce("mx", F.col("mn"), default).alias("mx")
    ).select(
        day_str("mn").alias("min_date"), day_str(F.greatest("mn", "mx")).alias("max_date")
    )
    return zones.agg(F.array_sort(F.collect_list("ZONE")).alias("zones")).crossJoin(ext)


def top_items_with_lines(sales: DataFrame, k: int = 5) -> DataFrame:
    """A21 — top-k items with revenue, qty and line count."""
    return (
        sales.filter(F.col("PRODUCT").isNotNull())
        .groupBy(F.col("PRODUCT").alias("item_name"))
        .agg(
            money(F.sum("NET_AMT")).alias("total_revenue"),
            F.sum("QTY_PACKS").cast("double").alias("total_qty"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .orderBy(F.col("total_revenue").desc(), F.col("item_name"))
        .limit(k)
    )


def per_zone_profile(sales: DataFrame) -> DataFrame:
    """A22 — revenue, distinct trading days, line items, distinct items per zone.

    One scan: the two distinct counts share Spark's expand + partial aggregation, which
    costs CPU on the scanned rows instead of a second and third read of the joined fact.
    """
    return (
        sales.filter(F.col("ZONE").isNotNull())
        .groupBy(F.col("ZONE").alias("outlet_name"))
        .agg(
            money(F.sum("NET_AMT")).alias("total_revenue"),
            F.count_distinct("INVOICE_DATE").alias("trading_days"),
            F.count(F.lit(1)).alias("line_items"),
            F.count_distinct("PRODUCT").alias("unique_items"),
        )
        .orderBy(F.col("total_revenue").desc())
    )


def daily_lines(sales: DataFrame) -> DataFrame:
    """A23 — daily revenue and line count."""
    return (
        sales.groupBy(day_str("INVOICE_DATE").alias("date"))
        .agg(money(F.sum("NET_AMT")).alias("daily_revenue"), F.count(F.lit(1)).alias("line_items"))
        .orderBy("date")
    )


def zone_day_revenue(sales: DataFrame) -> DataFrame:
    """A24 — zone-day revenue series (rounded to 2, null zones dropped)."""
    return (
        sales.filter(F.col("ZONE").isNotNull())
        .groupBy("ZONE", "INVOICE_DATE")
        .agg(F.round(F.sum("NET_AMT"), 2).alias("rev"))
    )


# ── A28–A30 ────────────────────────────────────────────────────────────────────
def day_vs_mean(sales: DataFrame, day: str) -> DataFrame:
    """A28 — mean daily revenue over all days and the % above/below for one date."""
    daily = sales.groupBy("INVOICE_DATE").agg(F.round(F.sum("NET_AMT"), 2).alias("rev"))
    stats = daily.agg(fdiv(F.sum("rev"), F.count("rev")).alias("avg_rev"), F.count(F.lit(1)).alias("trading_days"))
    one = daily.filter(F.col("INVOICE_DATE") == F.lit(day).cast("date")).select(F.col("rev").cast("double").alias("rev"))
    # one-row stats joined to at most one row: a scalar join, not a pair explosion
    return stats.join(one, how="left").select(
        F.lit(day).alias("date"),
        F.col("rev").alias("revenue"),
        rnd(F.col("avg_rev"), 2).alias("avg_revenue"),
        "trading_days",
        rnd((F.col("rev") - F.col("avg_rev")) / F.nullif(F.col("avg_rev"), F.lit(0.0)) * 100, 1).alias("pct_vs_avg"),
    )


def data_scope(sales: DataFrame, date_start: str | None = None, date_end: str | None = None) -> DataFrame:
    """A29 — freshness and scope: max invoice date, zone count, interpreted window."""
    agg = sales.agg(
        F.max("INVOICE_DATE").alias("mx"), F.min("INVOICE_DATE").alias("mn"),
        F.count_distinct(F.when(non_empty("ZONE"), F.col("ZONE"))).alias("outlet_count"),
    )
    return agg.select(
        (F.lit(date_start) if date_start else day_str("mn")).alias("date_start"),
        (F.lit(date_end) if date_end else day_str("mx")).alias("date_end"),
        "outlet_count",
        day_str("mx").alias("max_invoice_date"),
    )


def trailing_baseline(sales: DataFrame, lookback: int = 7) -> DataFrame:
    """A30 — each zone-day vs the mean of the previous ``lookback`` zone-days (same zone).

    The window runs over zone-day aggregates (one row per zone and day), never lines.
    """
    zd = zone_day_revenue(sales)
    w = Window.partitionBy("ZONE").orderBy("INVOICE_DATE").rowsBetween(-lookback, -1)
    base = fdiv(F.sum("rev").over(w), F.count("rev").over(w))
    rev = F.col("rev").cast("double")
    return zd.select(
        F.col("ZONE").alias("zone"),
        day_str("INVOICE_DATE").alias("date"),
        rev.alias("revenue"),
        rnd(base, 2).alias("baseline"),
        rnd(rev - base, 2).alias("diff"),
        rnd((rev - base) / F.nullif(base, F.lit(0.0)) * 100, 1).alias("diff_pct"),
    )


# ── W2, W5 ─────────────────────────────────────────────────────────────────────
def top_item_per_zone(sales: DataFrame) -> DataFrame:
    """W2 — best-selling product per zone (window over zone×product aggregates)."""
    zp = sales.groupBy("ZONE", "PRODUCT").agg(F.sum("NET_AMT").alias("s"))
    w = Window.partitionBy("ZONE").orderBy(F.col("s").desc(), F.col("PRODUCT"))
    return zp.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(
        "ZONE", "PRODUCT", money("s", 2).alias("revenue")
    )


def share_of_leader(top: DataFrame, metric: str = "revenue") -> DataFrame:
    """W5 — percent of the leader within an already-small top-N frame."""
    return top.withColumn("pct_of_leader", F.round(F.col(metric) / F.max(metric).over(Window.partitionBy()) * 100, 1))


# ── F14 ────────────────────────────────────────────────────────────────────────
def guarded_select(spark: SparkSession, sql: str, args: dict | None = None, *, limit: int) -> DataFrame:
    """F14 — parameterised ad-hoc SELECT over registered views, cut to the ``limit`` rows that
    the answer table asked for."""
    return spark.sql(sql, args=args or {}).limit(limit)
