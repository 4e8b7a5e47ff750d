"""Registered anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, rnd
from tillroll.operators import anomaly
from tillroll.operators.kpi import zone_day_revenue
from tillroll.plans.registry import register, sales_of, with_sales

_STATS = """
WITH zd AS (SELECT ZONE, INVOICE_DATE, ROUND(SUM(NET_AMT),2) AS rev FROM sales WHERE ZONE IS NOT NULL GROUP BY ZONE, INVOICE_DATE),
w0 AS (SELECT ZONE, INVOICE_DATE, rev,
              COUNT(CASE WHEN rev > 0 THEN rev END) OVER w AS n,
              SUM(CASE WHEN rev > 0 THEN rev END) OVER w AS s1,
              SUM(CASE WHEN rev > 0 THEN rev * rev END) OVER w AS s2
       FROM zd WINDOW w AS (PARTITION BY ZONE ORDER BY INVOICE_DATE ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
st AS (SELECT ZONE, INVOICE_DATE, rev, n,
              CASE WHEN n >= 2 THEN CAST(s1 AS DOUBLE) / n END AS mu,
              CASE WHEN n >= 2 THEN SQRT(CAST(CAST(n AS DECIMAL(20,0)) * s2 - s1 * s1 AS DOUBLE) / (n * (n - 1))) END AS sd
       FROM w0),
zs AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN sd = 0 THEN 0.0 ELSE (CAST(rev AS DOUBLE) - mu) / sd END AS z FROM st)
"""


def _r(expr: str, d: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {d}) AS DOUBLE)"


def _cl_cte(th: float, zone_filter: str = "") -> str:
    return _STATS + f""",
cl AS (SELECT *, CASE WHEN z < {th} THEN CASE WHEN z < -2.5 THEN 'CRITICAL' ELSE 'WARNING' END
                      WHEN z > 2.0 THEN 'PEAK' END AS severity
       FROM zs WHERE z IS NOT NULL AND rev <> 0 {zone_filter})
"""


def _classified(th: float, zone_filter: str = "") -> str:
    return _cl_cte(th, zone_filter) + f"""
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, ZONE AS outlet_name, {_r('rev', 2)} AS revenue,
       {_r('mu', 2)} AS rolling_mean, {_r('sd', 2)} AS rolling_std, {_r('z', 2)} AS z_score,
       {_r('(CAST(rev AS DOUBLE) - mu) / mu * 100', 1)} AS pct_deviation, severity
FROM cl WHERE severity IS NOT NULL"""


@register("N1_rolling_zscore", with_sales(_STATS + f"""
SELECT ZONE AS zone, CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(rev AS DOUBLE) AS revenue, n AS n_lookback,
       {_r('mu', 2)} AS rolling_mean, {_r('sd', 2)} AS rolling_std, {_r('z', 4)} AS z_score
FROM zs"""))
def n1(spark, sf):
    st = anomaly.rolling_zscore(zone_day_revenue(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")))
    return st.select(
        F.col("ZONE").alias("zone"), day_str("INVOICE_DATE").alias("date"), F.col("rev").cast("double").alias("revenue"),
        "n_lookback", rnd(F.col("rolling_mean"), 2).alias("rolling_mean"), rnd(F.col("rolling_std"), 2).alias("rolling_std"),
        rnd(F.col("z_score"), 4).alias("z_score"),
    )


@register("N4_anomalies_all_zones", with_sales(_classified(-1.5)))
def n4(spark, sf):
    return anomaly.detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"))


@register("N2_classify_threshold_minus1", with_sales(_classified(-1.0)))
def n2(spark, sf):
    return anomaly.detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), z_threshold=-1.0)


@register("N3_single_zone_scan", with_sales(_classified(-1.5, "AND UPPER(ZONE) = UPPER('asia')")))
def n3(spark, sf):
    return anomaly.detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), zone="asia")


@register("N5_series_outlier_day", with_sales(f"""
WITH daily AS (SELECT INVOICE_DATE, ROUND(SUM(NET_AMT),2) AS rev FROM sales GROUP BY INVOICE_DATE),
st AS (SELECT CAST(SUM(rev) AS DOUBLE) / COUNT(rev) AS mean_r,
              CASE WHEN COUNT(rev) > 1 THEN SQRT(CAST(CAST(COUNT(rev) AS DECIMAL(20,0)) * SUM(rev * rev) - SUM(rev) * SUM(rev) AS DOUBLE)
                                                / (COUNT(rev) * (COUNT(rev) - 1))) ELSE 1.0 END AS sd FROM daily),
sc AS (SELECT INVOICE_DATE, rev, mean_r, (CAST(rev AS DOUBLE) - mean_r) / sd AS z FROM daily, st)
SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, CAST(rev AS DOUBLE) AS revenue, {_r('z', 2)} AS z_score,
       CASE WHEN z < 0 THEN 'Below' ELSE 'Above' END AS direction, {_r('mean_r', 0)} AS mean_rev
FROM sc ORDER BY ABS(z) DESC, INVOICE_DATE LIMIT 1"""))
def n5(spark, sf):
    return anomaly.series_outlier(sales_of(spark, sf, "INVOICE_DATE", "NET_AMT"))


@register("N6_alert_digest", with_sales(_cl_cte(-1.5) + """
SELECT COUNT(*) AS anomaly_count,
       COALESCE(string_agg(DISTINCT ZONE, ', ' ORDER BY ZONE), '') AS outlets_flagged,
       CASE WHEN MAX(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) = 1 THEN 'CRITICAL'
            WHEN COUNT(*) > 0 THEN 'WARNING' ELSE 'ALL CLEAR' END AS severity_label
FROM cl WHERE severity IS NOT NULL"""))
def n6(spark, sf):
    return anomaly.alert_digest(n4(spark, sf))
