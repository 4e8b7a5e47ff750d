"""Registered KPI / filter / aggregate queries (F*, A1–A30, O1, W2, W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, money
from tillroll.operators import kpi
from tillroll.plans.registry import register, sales_of, with_sales

# Dashboard selection used by the KPI-tab queries: three zones, five years.
ZONES = ("AMERICA", "ASIA", "EUROPE")
D0, D1 = "1995-01-01", "1999-12-31"
DAY = "1996-03-15"
DAY2 = "1997-08-23"
MONTH = "1997-08"

_ZIN = "(" + ",".join(f"'{z}'" for z in ZONES) + ")"
_WIN = f"ZONE IN {_ZIN} AND INVOICE_DATE BETWEEN DATE '{D0}' AND DATE '{D1}'"
_REV = "COALESCE(CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE),0)"


def _kpi_frame(spark, sf, *cols):
    return kpi.kpi_window(sales_of(spark, sf, "ZONE", "INVOICE_DATE", *cols), kpi.KpiArgs.of(list(ZONES), D0, D1))


@register("A1_kpi_header", with_sales(f"""
SELECT {_REV} AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS total_orders,
       COALESCE(CAST(ROUND(CAST(SUM(NET_AMT)/NULLIF(COUNT(DISTINCT INVOICE_NO),0) AS DECIMAL(38,6)),2) AS DOUBLE),0) AS aov,
       COALESCE(CAST(SUM(QTY_PACKS) AS DOUBLE),0) AS total_packs,
       COALESCE(CAST(ROUND(SUM(TOTAL_VOLUME_BILLED_LTR),0) AS DOUBLE),0) AS total_volume_ltr
FROM sales WHERE {_WIN}"""))
def a1(spark, sf):
    return kpi.kpi_header(_kpi_frame(spark, sf, "INVOICE_NO", "NET_AMT", "QTY_PACKS", "TOTAL_VOLUME_BILLED_LTR"))


@register("A1_kpi_header_empty_window", with_sales(f"""
SELECT {_REV} AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS total_orders,
       COALESCE(CAST(ROUND(CAST(SUM(NET_AMT)/NULLIF(COUNT(DISTINCT INVOICE_NO),0) AS DECIMAL(38,6)),2) AS DOUBLE),0) AS aov,
       COALESCE(CAST(SUM(QTY_PACKS) AS DOUBLE),0) AS total_packs,
       COALESCE(CAST(ROUND(SUM(TOTAL_VOLUME_BILLED_LTR),0) AS DOUBLE),0) AS total_volume_ltr
FROM sales WHERE INVOICE_DATE BETWEEN DATE '2030-01-01' AND DATE '2030-12-31'"""))
def a1_empty(spark, sf):
    s = sales_of(spark, sf, "INVOICE_DATE", "INVOICE_NO", "NET_AMT", "QTY_PACKS", "TOTAL_VOLUME_BILLED_LTR")
    return kpi.kpi_header(kpi.filter_dates(s, "2030-01-01", "2030-12-31"))


@register("A2_top5_products", with_sales(f"""
SELECT PRODUCT AS item_name, {_REV} AS revenue, CAST(SUM(QTY_PACKS) AS DOUBLE) AS qty
FROM sales WHERE {_WIN} AND PRODUCT IS NOT NULL
GROUP BY PRODUCT ORDER BY revenue DESC, item_name LIMIT 5"""))
def a2(spark, sf):
    return kpi.top_products(_kpi_frame(spark, sf, "PRODUCT", "NET_AMT", "QTY_PACKS"))


@register("A3_revenue_by_zone", with_sales(f"""
SELECT ZONE AS outlet_name, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE {_WIN} GROUP BY ZONE"""))
def a3(spark, sf):
    return kpi.revenue_by_zone(_kpi_frame(spark, sf, "INVOICE_NO", "NET_AMT"))


@register("A4_daily_trend", with_sales(f"""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE {_WIN} GROUP BY INVOICE_DATE"""))
def a4(spark, sf):
    return kpi.daily_trend(_kpi_frame(spark, sf, "INVOICE_NO", "NET_AMT"))


@register("F13_raw_lines", with_sales(f"""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, ZONE AS outlet_name, PRODUCT AS item_name,
       CAST(NET_AMT AS DOUBLE) AS net_revenue, CAST(QTY_PACKS AS DOUBLE) AS quantity,
       CHANNEL AS channel, INVOICE_NO AS bill_no, PRODUCT_CLASS AS product_group
FROM sales WHERE {_WIN}"""))
def f13(spark, sf):
    return kpi.raw_lines(_kpi_frame(spark, sf, "PRODUCT", "NET_AMT", "QTY_PACKS", "CHANNEL", "INVOICE_NO", "PRODUCT_CLASS"))


@register("A5_window_totals", with_sales(f"""
SELECT {_REV} AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS total_orders,
       COALESCE(CAST(ROUND(CAST(SUM(NET_AMT)/NULLIF(COUNT(DISTINCT INVOICE_NO),0) AS DECIMAL(38,6)),2) AS DOUBLE),0) AS aov
FROM sales"""))
def a5(spark, sf):
    return kpi.window_totals(sales_of(spark, sf, "INVOICE_NO", "NET_AMT"))


@register("A6_single_day_total", with_sales(f"""
SELECT CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE) AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE INVOICE_DATE = DATE '{DAY}'"""))
def a6(spark, sf):
    return kpi.single_day_total(sales_of(spark, sf, "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), DAY)


@register("A6_single_day_total_no_rows", with_sales("""
SELECT CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE) AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE INVOICE_DATE = DATE '2030-01-01'"""))
def a6_none(spark, sf):
    return kpi.single_day_total(sales_of(spark, sf, "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), "2030-01-01")


@register("A7_decline_pair", with_sales(f"""
SELECT CASE WHEN GROUPING(ZONE) = 1 THEN 'chain' ELSE 'zone' END AS level, ZONE AS outlet_name,
       CASE WHEN GROUPING(ZONE) = 1 THEN CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE) ELSE {_REV} END AS revenue,
       COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE INVOICE_DATE = DATE '{DAY}'
GROUP BY GROUPING SETS ((), (ZONE))"""))
def a7(spark, sf):
    return kpi.decline_pair(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), DAY)


@register("A8_compare_two_dates", with_sales(f"""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS day, {_REV} AS total_revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE INVOICE_DATE IN (DATE '{DAY}', DATE '{DAY2}') GROUP BY INVOICE_DATE"""))
def a8(spark, sf):
    return kpi.compare_days(sales_of(spark, sf, "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), DAY, DAY2)


@register("A9_compare_two_zones", with_sales(f"""
SELECT ZONE AS outlet_name, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders
FROM sales WHERE ZONE IN ('ASIA','AFRICA') AND INVOICE_DATE BETWEEN DATE '{D0}' AND DATE '{D1}'
GROUP BY ZONE"""))
def a9(spark, sf):
    return kpi.compare_zones(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"), "ASIA", "AFRICA", D0, D1)


_DAYS = f"SELECT CAST(INVOICE_DATE AS VARCHAR) AS day, {_REV} AS total_revenue FROM sales GROUP BY INVOICE_DATE"


@register("A10_worst_day", with_sales(f"{_DAYS} ORDER BY total_revenue ASC, day LIMIT 1"))
def a10(spark, sf):
    return kpi.worst_day(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("A11_best_day", with_sales(f"{_DAYS} ORDER BY total_revenue DESC, day LIMIT 1"))
def a11(spark, sf):
    return kpi.best_day(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("A12_top6_days", with_sales("""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS day, COALESCE(CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE),0) AS total_revenue
FROM sales GROUP BY INVOICE_DATE ORDER BY total_revenue DESC, day LIMIT 6"""))
def a12(spark, sf):
    return kpi.top_days(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("A13_revenue_by_state_on_date", with_sales(f"""
SELECT STATE, CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE) AS revenue
FROM sales WHERE INVOICE_DATE = DATE '{DAY}' GROUP BY STATE"""))
def a13(spark, sf):
    return kpi.revenue_by_state_on(sales_of(spark, sf, "STATE", "INVOICE_DATE", "NET_AMT"), DAY)


@register("A14_lowest_day_in_month", with_sales(f"""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(ROUND(SUM(NET_AMT),0) AS DOUBLE) AS total_revenue
FROM sales WHERE strftime(INVOICE_DATE, '%Y-%m') = '{MONTH}'
GROUP BY INVOICE_DATE ORDER BY total_revenue ASC, date LIMIT 1"""))
def a14(spark, sf):
    return kpi.lowest_day_in_month(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), MONTH)


@register("F4_month_filter", with_sales(f"""
SELECT COUNT(*) AS lines, {_REV} AS revenue FROM sales WHERE strftime(INVOICE_DATE, '%Y-%m') = '{MONTH}'"""))
def f4(spark, sf):
    f = kpi.filter_month(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), MONTH)
    return f.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(money(F.sum("NET_AMT")), F.lit(0.0)).alias("revenue"))


@register("F5_trailing_90_days", with_sales(f"""
SELECT COUNT(*) AS lines, {_REV} AS revenue FROM sales WHERE INVOICE_DATE >= DATE '{DAY}' - INTERVAL 90 DAY"""))
def f5(spark, sf):
    f = kpi.filter_trailing(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), DAY, 90)
    return f.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(money(F.sum("NET_AMT")), F.lit(0.0)).alias("revenue"))


@register("F8_optional_filters", with_sales(f"""
SELECT ZONE, COUNT(*) AS lines, {_REV} AS revenue FROM sales
WHERE ZONE = 'ASIA' AND INVOICE_DATE >= DATE '1996-01-01' AND (PRODUCT_CLASS ILIKE '%plate%' OR PRODUCT ILIKE '%plate%')
GROUP BY ZONE"""))
def f8(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT", "PRODUCT_CLASS", "PRODUCT")
    f = kpi.optional_filters(s, zone=" ASIA ", date_from="1996-01-01", date_to="  ", group="Plate")
    return f.groupBy("ZONE").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(money(F.sum("NET_AMT")), F.lit(0.0)).alias("revenue"))


@register("F9_case_insensitive_zone", with_sales(f"""
SELECT COUNT(*) AS lines, {_REV} AS revenue FROM sales WHERE UPPER(ZONE) = UPPER('asia')"""))
def f9(spark, sf):
    from tillroll.functions.exprs import equals_ci
    f = sales_of(spark, sf, "ZONE", "NET_AMT").filter(equals_ci("ZONE", "asia"))
    return f.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(money(F.sum("NET_AMT")), F.lit(0.0)).alias("revenue"))


@register("F14_guarded_select", with_sales("""
SELECT ZONE, CAST(INVOICE_DATE AS VARCHAR) AS day, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS revenue
FROM sales WHERE ZONE = 'ASIA' GROUP BY ZONE, INVOICE_DATE ORDER BY revenue DESC, day LIMIT 200"""))
def f14(spark, sf):
    sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT").createOrReplaceTempView("sales")
    sql = ("SELECT ZONE, date_format(INVOICE_DATE, 'yyyy-MM-dd') AS day, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS revenue "
           "FROM sales WHERE ZONE = :zone GROUP BY ZONE, INVOICE_DATE ORDER BY revenue DESC, day")
    return kpi.guarded_select(spark, sql, {"zone": "ASIA"}, limit=200)


@register("A15_weekday_means", with_sales("""
WITH daily AS (SELECT INVOICE_DATE AS d, SUM(NET_AMT) AS total FROM sales GROUP BY INVOICE_DATE)
SELECT CASE dayofweek(d) WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday'
            WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' END AS day_of_week,
       CAST(ROUND(CAST(AVG(total) AS DECIMAL(38,6)),0) AS DOUBLE) AS avg_daily_revenue
FROM daily GROUP BY 1"""))
def a15(spark, sf):
    return kpi.weekday_means(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("A16_rollup_class_code", with_sales(f"""
SELECT PRODUCT_CLASS, CODE, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders, COUNT(*) AS lines
FROM sales GROUP BY PRODUCT_CLASS, CODE"""))
def a16(spark, sf):
    return kpi.rollup(sales_of(spark, sf, "PRODUCT_CLASS", "CODE", "INVOICE_NO", "NET_AMT"), ["PRODUCT_CLASS", "CODE"])


@register("A16_rollup_state_customer_category", with_sales(f"""
SELECT STATE, CUSTOMER_CATEGORY, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders, COUNT(*) AS lines
FROM sales GROUP BY STATE, CUSTOMER_CATEGORY"""))
def a16b(spark, sf):
    return kpi.rollup(sales_of(spark, sf, "STATE", "CUSTOMER_CATEGORY", "INVOICE_NO", "NET_AMT"), ["STATE", "CUSTOMER_CATEGORY"])


@register("A17_coverage_by_zone", with_sales("""
SELECT ZONE, COUNT(DISTINCT CUSTOMER) AS billed_outlets, COUNT(DISTINCT STOCKIEST) AS stockiests,
       COUNT(DISTINCT INVOICE_NO) AS invoices
FROM sales GROUP BY ZONE"""))
def a17(spark, sf):
    return kpi.coverage(sales_of(spark, sf, "ZONE", "CUSTOMER", "STOCKIEST", "INVOICE_NO"), by="ZONE")


@register("A17_coverage_total", with_sales("""
SELECT COUNT(DISTINCT CUSTOMER) AS billed_outlets, COUNT(DISTINCT STOCKIEST) AS stockiests,
       COUNT(DISTINCT INVOICE_NO) AS invoices FROM sales"""))
def a17t(spark, sf):
    return kpi.coverage(sales_of(spark, sf, "CUSTOMER", "STOCKIEST", "INVOICE_NO"))


@register("A18_scheme_totals", with_sales("""
SELECT ZONE, COALESCE(CAST(ROUND(SUM(SCHEME_AMT),2) AS DOUBLE),0) AS scheme_amt,
       COALESCE(CAST(ROUND(SUM(GRP_SCHEME_AMT),2) AS DOUBLE),0) AS grp_scheme_amt
FROM sales GROUP BY ZONE"""))
def a18(spark, sf):
    return kpi.scheme_totals(sales_of(spark, sf, "ZONE", "SCHEME_AMT", "GRP_SCHEME_AMT"))


@register("A19_month_over_month", with_sales(f"""
WITH m AS (SELECT strftime(INVOICE_DATE, '%Y-%m') AS month, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders
           FROM sales GROUP BY 1)
SELECT month, revenue, orders, LAG(revenue) OVER (ORDER BY month) AS prev_revenue,
       ROUND((revenue - LAG(revenue) OVER (ORDER BY month)) / NULLIF(LAG(revenue) OVER (ORDER BY month), 0) * 100, 1) AS mom_pct
FROM m"""))
def a19(spark, sf):
    return kpi.month_over_month(sales_of(spark, sf, "INVOICE_DATE", "INVOICE_NO", "NET_AMT"))


@register("A20_zone_bounds", with_sales("""
SELECT (SELECT string_agg(z, ',' ORDER BY z) FROM (SELECT DISTINCT ZONE AS z FROM sales WHERE ZONE IS NOT NULL AND ZONE <> '')) AS zones,
       CAST(MIN(INVOICE_DATE) AS VARCHAR) AS min_date, CAST(MAX(INVOICE_DATE) AS VARCHAR) AS max_date
FROM sales"""))
def a20(spark, sf):
    out = kpi.zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))
    return out.select(F.array_join("zones", ",").alias("zones"), "min_date", "max_date")


@register("A21_top5_items_with_lines", with_sales("""
SELECT PRODUCT AS item_name, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS total_revenue,
       CAST(SUM(QTY_PACKS) AS DOUBLE) AS total_qty, COUNT(*) AS transaction_count
FROM sales WHERE PRODUCT IS NOT NULL GROUP BY PRODUCT ORDER BY total_revenue DESC, item_name LIMIT 5"""))
def a21(spark, sf):
    return kpi.top_items_with_lines(sales_of(spark, sf, "PRODUCT", "NET_AMT", "QTY_PACKS"))


@register("A22_per_zone_profile", with_sales("""
SELECT ZONE AS outlet_name, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS total_revenue,
       COUNT(DISTINCT INVOICE_DATE) AS trading_days, COUNT(*) AS line_items, COUNT(DISTINCT PRODUCT) AS unique_items
FROM sales WHERE ZONE IS NOT NULL GROUP BY ZONE"""))
def a22(spark, sf):
    return kpi.per_zone_profile(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "PRODUCT", "NET_AMT"))


@register("A23_daily_lines", with_sales("""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS daily_revenue, COUNT(*) AS line_items
FROM sales GROUP BY INVOICE_DATE"""))
def a23(spark, sf):
    return kpi.daily_lines(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("A24_zone_day_series", with_sales("""
SELECT ZONE AS zone, CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(ROUND(SUM(NET_AMT),2) AS DOUBLE) AS revenue
FROM sales WHERE ZONE IS NOT NULL GROUP BY ZONE, INVOICE_DATE"""))
def a24(spark, sf):
    zd = kpi.zone_day_revenue(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"))
    return zd.select(F.col("ZONE").alias("zone"), day_str("INVOICE_DATE").alias("date"), F.col("rev").cast("double").alias("revenue"))


@register("A28_day_vs_mean", with_sales(f"""
WITH daily AS (SELECT INVOICE_DATE AS d, ROUND(SUM(NET_AMT),2) AS rev FROM sales GROUP BY INVOICE_DATE),
     st AS (SELECT CAST(SUM(rev) AS DOUBLE) / COUNT(rev) AS avg_rev, COUNT(*) AS trading_days FROM daily)
SELECT '{DAY}' AS date, CAST(daily.rev AS DOUBLE) AS revenue, CAST(ROUND(CAST(st.avg_rev AS DECIMAL(38,6)),2) AS DOUBLE) AS avg_revenue,
       st.trading_days,
       CAST(ROUND(CAST((CAST(daily.rev AS DOUBLE) - st.avg_rev) / NULLIF(st.avg_rev,0) * 100 AS DECIMAL(38,6)), 1) AS DOUBLE) AS pct_vs_avg
FROM st LEFT JOIN daily ON daily.d = DATE '{DAY}'"""))
def a28(spark, sf):
    return kpi.day_vs_mean(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), DAY)


@register("A29_data_scope", with_sales("""
SELECT CAST(MIN(INVOICE_DATE) AS VARCHAR) AS date_start, CAST(MAX(INVOICE_DATE) AS VARCHAR) AS date_end,
       COUNT(DISTINCT CASE WHEN ZONE IS NOT NULL AND ZONE <> '' THEN ZONE END) AS outlet_count,
       CAST(MAX(INVOICE_DATE) AS VARCHAR) AS max_invoice_date
FROM sales"""))
def a29(spark, sf):
    return kpi.data_scope(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))


@register("A30_trailing_baseline", with_sales("""
WITH zd AS (SELECT ZONE, INVOICE_DATE, ROUND(SUM(NET_AMT),2) AS rev FROM sales WHERE ZONE IS NOT NULL GROUP BY ZONE, INVOICE_DATE),
     b AS (SELECT ZONE, INVOICE_DATE, CAST(rev AS DOUBLE) AS rev,
                  CAST(SUM(rev) OVER w AS DOUBLE) / NULLIF(COUNT(rev) OVER w, 0) AS base
           FROM zd WINDOW w AS (PARTITION BY ZONE ORDER BY INVOICE_DATE ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT ZONE AS zone, CAST(INVOICE_DATE AS VARCHAR) AS date, rev AS revenue,
       CAST(ROUND(CAST(base AS DECIMAL(38,6)),2) AS DOUBLE) AS baseline,
       CAST(ROUND(CAST(rev - base AS DECIMAL(38,6)),2) AS DOUBLE) AS diff,
       CAST(ROUND(CAST((rev - base) / NULLIF(base,0) * 100 AS DECIMAL(38,6)), 1) AS DOUBLE) AS diff_pct
FROM b"""))
def a30(spark, sf):
    return kpi.trailing_baseline(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"))


@register("W2_top_item_per_zone", with_sales("""
WITH r AS (SELECT ZONE, PRODUCT, SUM(NET_AMT) AS s,
                  ROW_NUMBER() OVER (PARTITION BY ZONE ORDER BY SUM(NET_AMT) DESC, PRODUCT) AS rn
           FROM sales GROUP BY ZONE, PRODUCT)
SELECT ZONE, PRODUCT, CAST(ROUND(s,2) AS DOUBLE) AS revenue FROM r WHERE rn = 1"""))
def w2(spark, sf):
    return kpi.top_item_per_zone(sales_of(spark, sf, "ZONE", "PRODUCT", "NET_AMT"))


@register("W5_share_of_leader", with_sales(f"""
WITH t AS (SELECT PRODUCT AS item_name, {_REV} AS revenue, CAST(SUM(QTY_PACKS) AS DOUBLE) AS qty
           FROM sales WHERE PRODUCT IS NOT NULL GROUP BY PRODUCT ORDER BY revenue DESC, item_name LIMIT 10)
SELECT item_name, revenue, qty, ROUND(revenue / MAX(revenue) OVER () * 100, 1) AS pct_of_leader FROM t"""))
def w5(spark, sf):
    return kpi.share_of_leader(kpi.top_products(sales_of(spark, sf, "PRODUCT", "NET_AMT", "QTY_PACKS"), 10))


_LINES_REV = f"COUNT(*) AS lines, {_REV} AS revenue"


def _lines_rev(df, *keys):
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(money(F.sum("NET_AMT")), F.lit(0.0)).alias("revenue"))


@register("F1_zone_membership", with_sales(f"SELECT ZONE, {_LINES_REV} FROM sales WHERE ZONE IN {_ZIN} GROUP BY ZONE"))
def f1(spark, sf):
    return _lines_rev(kpi.filter_zones(sales_of(spark, sf, "ZONE", "NET_AMT"), list(ZONES)), "ZONE")


@register("F2_inclusive_date_range", with_sales(f"SELECT {_LINES_REV} FROM sales WHERE INVOICE_DATE BETWEEN DATE '{D0}' AND DATE '{D1}'"))
def f2(spark, sf):
    return _lines_rev(kpi.filter_dates(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), D0, D1))


@register("F3_date_in_list", with_sales(f"SELECT CAST(INVOICE_DATE AS VARCHAR) AS day, {_LINES_REV} FROM sales WHERE INVOICE_DATE IN (DATE '{DAY}', DATE '{DAY2}') GROUP BY INVOICE_DATE"))
def f3(spark, sf):
    f = kpi.filter_days(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"), [DAY, DAY2])
    return _lines_rev(f.withColumn("day", day_str("INVOICE_DATE")), "day")


@register("F6_non_empty_product", with_sales(f"SELECT {_LINES_REV} FROM sales WHERE PRODUCT IS NOT NULL AND PRODUCT <> ''"))
def f6(spark, sf):
    from tillroll.functions.exprs import non_empty
    return _lines_rev(sales_of(spark, sf, "PRODUCT", "NET_AMT").filter(non_empty("PRODUCT")))


@register("F7_contains_two_columns", with_sales(f"SELECT PRODUCT_CLASS, {_LINES_REV} FROM sales WHERE PRODUCT_CLASS ILIKE '%promo%' OR PRODUCT ILIKE '%promo%' GROUP BY PRODUCT_CLASS"))
def f7(spark, sf):
    from tillroll.functions.exprs import contains_ci
    s = sales_of(spark, sf, "PRODUCT_CLASS", "PRODUCT", "NET_AMT")
    return _lines_rev(s.filter(contains_ci(["PRODUCT_CLASS", "PRODUCT"], "PROMO")), "PRODUCT_CLASS")


@register("F11_having_positive", with_sales("""
SELECT ZONE, CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(ROUND(SUM(NET_AMT), 2) AS DOUBLE) AS revenue
FROM sales GROUP BY ZONE, INVOICE_DATE HAVING SUM(NET_AMT) > 0"""))
def f11(spark, sf):
    g = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT").groupBy("ZONE", "INVOICE_DATE").agg(F.sum("NET_AMT").alias("s"))
    return g.filter(F.col("s") > 0).select("ZONE", day_str("INVOICE_DATE").alias("date"), money("s").alias("revenue"))


@register("A16_rollup_stockiest", with_sales(f"""
SELECT STOCKIEST, {_REV} AS revenue, COUNT(DISTINCT INVOICE_NO) AS orders, COUNT(*) AS lines
FROM sales GROUP BY STOCKIEST"""))
def a16c(spark, sf):
    return kpi.rollup(sales_of(spark, sf, "STOCKIEST", "INVOICE_NO", "NET_AMT"), ["STOCKIEST"])


@register("fn_Unit_revenue", with_sales("""
SELECT ZONE AS outlet_name, CAST(ROUND(CAST(CAST(SUM(NET_AMT) AS DOUBLE) AS DECIMAL(38,6)), 2) AS DOUBLE) AS revenue,
       CAST(ROUND(CAST(CAST(SUM(NET_AMT) AS DOUBLE) / 100000 AS DECIMAL(38,6)), 2) AS DOUBLE) AS revenue_lakh,
       CAST(ROUND(CAST(CAST(SUM(NET_AMT) AS DOUBLE) / 10000000 AS DECIMAL(38,6)), 2) AS DOUBLE) AS revenue_cr
FROM sales GROUP BY ZONE"""))
def fn_unit(spark, sf):
    return kpi.revenue_units(sales_of(spark, sf, "ZONE", "NET_AMT"))
