"""Anomaly detection: rolling z-score per zone (W3/N1), classification (N2–N4),
series-wide outlier day (W4/N5), alert digest (N6).

Exactness: the rolling mean and sample stdev are computed from exact decimal window
sums (Σx, Σx², n) so the result does not depend on summation order:
``mean = Σx / n`` and ``stdev = sqrt((n·Σx² − (Σx)²) / (n·(n−1)))`` — the numerator is an
exact decimal, so the textbook cancellation problem of that formula does not arise.
A constant window gives exactly 0, hence ``z = 0`` as in the source rule.

Scale: every window here runs over zone-day (or day) aggregates, never over invoice
lines.  At 100 TB the series is still (#zones × #days) rows; one hot zone holding a
third of all lines contributes only its #days rows after the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, equals_ci, rnd
from tillroll.operators.kpi import zone_day_revenue

# ── Fixed values of the detection rule ─────────────────────────────────────────
ROLLING_WINDOW = 7
Z_DIP = -1.5
Z_CRITICAL = -2.5
Z_PEAK = 2.0


def _window_stats(value: Column, w: Window, keep: Column) -> tuple[Column, Column, Column]:
    """(n, mean, stdev) of ``value`` over ``w`` counting only rows where ``keep``."""
    v = F.when(keep, value)
    n = F.count(v).over(w)
    s1 = F.sum(v).over(w)
    s2 = F.sum(v * v).over(w)
    mean = s1.cast("double") / n
    var_num = n.cast("decimal(20,0)") * s2 - s1 * s1
    sd = F.sqrt(var_num.cast("double") / (n * (n - 1)))
    return n, mean, sd


def rolling_zscore(zone_days: DataFrame, window: int = ROLLING_WINDOW) -> DataFrame:
    """W3 + N1 — per zone, stats over the previous ``window`` rows (current excluded),
    ignoring revenue ≤ 0 in the lookback; null stats with fewer than 2 usable rows.

    Input: (ZONE, INVOICE_DATE, rev decimal).  Output adds n_lookback, rolling_mean,
    rolling_std, z_score (unrounded doubles).
    """
    w = Window.partitionBy("ZONE").orderBy("INVOICE_DATE").rowsBetween(-window, -1)
    n, mean, sd = _window_stats(F.col("rev"), w, F.col("rev") > 0)
    x = F.col("rev").cast("double")
    enough = n >= 2
    z = F.when(~enough, F.lit(None).cast("double")).when(sd == 0, F.lit(0.0)).otherwise((x - mean) / sd)
    return zone_days.select(
        "ZONE", "INVOICE_DATE", "rev",
        n.alias("n_lookback"),
        F.when(enough, mean).alias("rolling_mean"),
        F.when(enough, sd).alias("rolling_std"),
        z.alias("z_score"),
    )


def classify(stats: DataFrame, z_threshold: float = Z_DIP) -> DataFrame:
    """N2 — skip zero-revenue days and rows without stats; dips below the threshold are
    CRITICAL under −2.5 else WARNING; otherwise z above 2.0 is a PEAK."""
    z = F.col("z_score")
    sev = (
        F.when(z < F.lit(z_threshold), F.when(z < F.lit(Z_CRITICAL), F.lit("CRITICAL")).otherwise(F.lit("WARNING")))
        .when(z > F.lit(Z_PEAK), F.lit("PEAK"))
    )
    x = F.col("rev").cast("double")
    return (
        stats.filter(z.isNotNull() & (F.col("rev") != 0))
        .withColumn("severity", sev)
        .filter(F.col("severity").isNotNull())
        .withColumn("pct_deviation", (x - F.col("rolling_mean")) / F.col("rolling_mean") * 100)
    )


def present(anoms: DataFrame) -> DataFrame:
    """N4 output shape: rounding 2/2/2/2/1 and O3 order (dips by z ascending, then
    peaks by z descending)."""
    peak = F.col("severity") == "PEAK"
    return anoms.select(
        day_str("INVOICE_DATE").alias("date"),
        F.col("ZONE").alias("outlet_name"),
        rnd(F.col("rev").cast("double"), 2).alias("revenue"),
        rnd(F.col("rolling_mean"), 2).alias("rolling_mean"),
        rnd(F.col("rolling_std"), 2).alias("rolling_std"),
        rnd(F.col("z_score"), 2).alias("z_score"),
        rnd(F.col("pct_deviation"), 1).alias("pct_deviation"),
        "severity",
        peak.alias("_peak"),
        F.when(peak, -F.col("z_score")).otherwise(F.col("z_score")).alias("_key"),
    ).orderBy("_peak", "_key", "date", "outlet_name").drop("_peak", "_key")


def detect_anomalies(sales: DataFrame, zone: str | None = None, z_threshold: float = Z_DIP) -> DataFrame:
    """N3 / N4 — scan one zone (case-insensitive) or all zones."""
    zd = zone_day_revenue(sales)
    if zone:
        zd = zd.filter(equals_ci("ZONE", zone))
    return present(classify(rolling_zscore(zd), z_threshold))


def series_outlier(sales: DataFrame) -> DataFrame:
    """W4 / N5 — z-score of each day's chain revenue against the whole series; the day
    with the largest |z| (earliest on ties).  Stdev is 1 when there is a single day.

    Global statistics come from one aggregate over *daily* rows, attached to the daily
    rows as a one-row scalar join (no single-partition window over data rows).
    """
    daily = sales.groupBy("INVOICE_DATE").agg(F.round(F.sum("NET_AMT"), 2).alias("rev"))
    stats = daily.agg(
        F.count("rev").alias("n"), F.sum("rev").alias("s1"), F.sum(F.col("rev") * F.col("rev")).alias("s2")
    ).select(
        (F.col("s1").cast("double") / F.col("n")).alias("mean_r"),
        F.when(F.col("n") > 1, F.sqrt(
            (F.col("n").cast("decimal(20,0)") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")
            / (F.col("n") * (F.col("n") - 1))
        )).otherwise(F.lit(1.0)).alias("sd"),
    )
    z = (F.col("rev").cast("double") - F.col("mean_r")) / F.col("sd")
    scored = daily.join(stats, how="inner").select(
        "INVOICE_DATE", "rev", "mean_r", z.alias("z")
    )
    top = scored.orderBy(F.abs("z").desc(), F.col("INVOICE_DATE")).limit(1)
    return top.select(
        day_str("INVOICE_DATE").alias("date"),
        F.col("rev").cast("double").alias("revenue"),
        rnd(F.col("z"), 2).alias("z_score"),
        F.when(F.col("z") < 0, F.lit("Below")).otherwise(F.lit("Above")).alias("direction"),
        rnd(F.col("mean_r"), 0).alias("mean_rev"),
    )


def cause_rows(enriched: DataFrame) -> DataFrame:
    """N6 — one row per anomaly with its cause: condition, holiday and kind of news of its date, whole."""
    told = F.concat_ws("; ", F.concat(F.lit("weather "), F.col("condition")),
                       F.concat(F.lit("holiday "), F.coalesce("holiday_name", F.lit("none"))),
                       F.concat(F.lit("news "), F.coalesce("news_kind", F.lit("none"))))
    return enriched.select("outlet_name", "date", "severity", told.alias("diagnosis"))


def alert_digest(anomalies: DataFrame, causes: DataFrame | None = None, by: list[str] | None = None,
                 most: int = 200, width: int = 60) -> DataFrame:
    """N6 — anomaly count, distinct zones flagged, overall label, joined causes.

    Label: any CRITICAL → CRITICAL; else any anomaly (peaks included) → WARNING; none →
    ALL CLEAR.  ``causes`` (outlet_name, diagnosis) is optional; each becomes
    ``zone: text[:width]`` and the first ``most`` in sorted order (a top-k) are joined with ``; `` for the
    report column; ``cause_rows`` has them all.  The flagged-zone list is bounded by the number of zones.
    """
    keys = by or []
    d = anomalies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.array_join(F.array_sort(F.collect_set("outlet_name")), ", ").alias("outlets_flagged"),
        F.max(F.when(F.col("severity") == "CRITICAL", 1).otherwise(0)).alias("_crit"),
    ).select(
        *keys, "anomaly_count",
        F.coalesce("outlets_flagged", F.lit("")).alias("outlets_flagged"),
        F.when(F.col("_crit") == 1, F.lit("CRITICAL"))
        .when(F.col("anomaly_count") > 0, F.lit("WARNING"))
        .otherwise(F.lit("ALL CLEAR")).alias("severity_label"),
    )
    if causes is None:
        return d
    told = F.concat_ws(": ", "outlet_name", F.left("diagnosis", F.lit(width))).alias("told")
    c = causes.select(told).orderBy("told").limit(most).agg(
        F.array_join(F.array_sort(F.collect_list("told")), "; ").alias("root_causes"))
    return d.join(c, how="inner")
