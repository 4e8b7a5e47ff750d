"""Registered forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, rnd
from tillroll.operators import forecast as fc
from tillroll.operators.audit import scenario_tags
from tillroll.operators.kpi import zone_bounds
from tillroll.plans.q_context import _CTX
from tillroll.plans.registry import register, sales_of, with_sales
from tillroll.sources import context_feed as cf
from tillroll.sources import io
from tillroll.sources.question_log import scenario_log

PARAMS = fc.ForestParams()  # 200 trees, depth 12, min leaf 3, seed 42


def _inputs(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")
    train = fc.training_set(s, cf.weather_feed(spark, sf))
    dates = cf.sales_dates(spark, sf)
    holidays = cf.holiday_table(dates).select("date")
    zone_index = fc.zone_encoder(train)
    return train, holidays, zone_index


def _features(spark, sf):
    """Feature rows as a written table in tasks of a useful size: every tree level re-reads them."""
    train, holidays, zone_index = _inputs(spark, sf)
    rows = io.load_table(fc.with_features(fc.augment(train), holidays, zone_index), io.scratch_path(spark, "features"))
    return fc.sized(rows), holidays, zone_index


def _trained(spark, sf, params=PARAMS):
    """The stored model of the feature rows, fitted by whichever query comes first."""
    feats, holidays, zone_index = _features(spark, sf)
    return fc.stored_model(feats, params), feats, holidays, zone_index


_TRAIN_SQL = """
tr AS (SELECT z.ZONE AS zone, z.d AS date, CAST(z.rev AS DOUBLE) AS net_revenue,
              COALESCE(w.temp_max_c, 27.0) AS temp_max_c, COALESCE(w.precipitation_mm, 0.5) AS precipitation_mm
       FROM (SELECT ZONE, INVOICE_DATE AS d, SUM(NET_AMT) AS rev FROM sales WHERE ZONE IS NOT NULL GROUP BY 1, 2 HAVING SUM(NET_AMT) > 0) z
       LEFT JOIN (SELECT CAST(date AS DATE) AS d, temp_max_c, precipitation_mm FROM ctx WHERE temp_max_c IS NOT NULL) w ON w.d = z.d)"""


@register("M1_training_set", with_sales(_CTX + "," + _TRAIN_SQL + """
SELECT zone, CAST(date AS VARCHAR) AS date, CAST(ROUND(CAST(net_revenue AS DECIMAL(38,6)), 2) AS DOUBLE) AS net_revenue,
       temp_max_c, precipitation_mm FROM tr"""))
def m1(spark, sf):
    train, _, _ = _inputs(spark, sf)
    return train.select("zone", day_str("date").alias("date"), rnd(F.col("net_revenue"), 2).alias("net_revenue"),
                        "temp_max_c", "precipitation_mm")


_HOL = " UNION ".join(
    f"SELECT make_date(y, {m}, {d}) AS hd FROM (SELECT DISTINCT year(date) AS y FROM ctx_dates)"
    for m, d, _ in cf.NATIONAL_HOLIDAYS + cf.STATE_HOLIDAYS)


@register("M2_M3_feature_rows", with_sales(_CTX + "," + _TRAIN_SQL + f""",
hol AS ({_HOL}),
zi AS (SELECT zone, CAST(ROW_NUMBER() OVER (ORDER BY zone) - 1 AS DOUBLE) AS outlet_id FROM (SELECT DISTINCT zone FROM tr))
SELECT tr.zone, CAST(tr.date AS VARCHAR) AS date, zi.outlet_id,
       CAST(isodow(tr.date) = 1 AS DOUBLE) AS day_mon, CAST(isodow(tr.date) = 2 AS DOUBLE) AS day_tue,
       CAST(isodow(tr.date) = 3 AS DOUBLE) AS day_wed, CAST(isodow(tr.date) = 4 AS DOUBLE) AS day_thu,
       CAST(isodow(tr.date) = 5 AS DOUBLE) AS day_fri, CAST(isodow(tr.date) = 6 AS DOUBLE) AS day_sat,
       CAST(isodow(tr.date) = 7 AS DOUBLE) AS day_sun, CAST(isodow(tr.date) >= 6 AS DOUBLE) AS is_weekend,
       CAST(tr.date IN (SELECT hd FROM hol) AS DOUBLE) AS is_holiday,
       tr.temp_max_c AS avg_temp_c, tr.precipitation_mm
FROM tr JOIN zi ON zi.zone = tr.zone"""))
def m2(spark, sf):
    train, holidays, zone_index = _inputs(spark, sf)
    f = fc.with_features(train, holidays, zone_index)
    return f.select("zone", day_str("date").alias("date"), *[c for c in fc.FEATURE_ORDER])


@register("M4_augmented_rows")
def m4(spark, sf):
    train, _, _ = _inputs(spark, sf)
    return fc.augment(train).withColumn("date", day_str("date"))


@register("M5_M7_feature_importance")
def m5(spark, sf):
    model = _trained(spark, sf)[0]
    return fc.feature_importance(model, spark)


@register("M6_cross_validation")
def m6(spark, sf):
    return fc.cross_validate(_features(spark, sf)[0], PARAMS)


@register("M8_persist_reload")
def m8(spark, sf):
    model, feats, _, _ = _trained(spark, sf)
    path = io.scratch_path(spark, "revenue_forecaster")
    fc.save_model(model, path)  # the stored model's own round trip
    again = fc.load_model(path)
    a = model.transform(feats).select("zone", "date", "copy", F.col("prediction").alias("p1"))
    b = again.transform(feats).select("zone", "date", "copy", F.col("prediction").alias("p2"))
    return a.join(b, ["zone", "date", "copy"]).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_abs_diff"))


def _scenario_predictions(spark, sf):
    model, _, holidays, zone_index = _trained(spark, sf)
    zones = zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))
    tags = scenario_tags(scenario_log(spark, sf), zones)
    # Free-text zone → known zone (fuzzy containment), unknown stays as given
    sc = tags.join(zones.select("zones"), how="inner").select(
        "scenario_id", fc.match_zone(F.col("zone"), F.col("zones")).alias("zone"), "date", "rain_mm", "temp_c")
    return fc.predict_scenarios(model, sc, holidays, zone_index)


@register("M9_M10_M11_scenario_predictions")
def m9(spark, sf):
    return _scenario_predictions(spark, sf)


@register("M12_scenario_grid")
def m12(spark, sf):
    model, _, holidays, zone_index = _trained(spark, sf)
    zd = fc.training_set(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), cf.weather_feed(spark, sf)).select("zone", "date")
    return fc.predict_scenarios(model, fc.scenario_grid(zd), holidays, zone_index)


# The arithmetic around a prediction, checked on a formula in place of the forest.
_FORMULA = "10000e0 + 4000e0 * {t} - 700e0 * {r} + 5000e0 * is_weekend + 3000e0 * is_holiday"


def _r(expr: str, d: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {d}) AS DOUBLE)"


_PRESETS = ", ".join(f"({i}, {r}e0, {t}e0)" for i, (r, t) in enumerate(((0, 30), (2, 28), (5, 25), (15, 22), (30, 20))))
_SCENARIOS = _CTX + "," + _TRAIN_SQL + f""",
hol AS ({_HOL}),
rated AS (
  SELECT zone || '|' || CAST(date AS VARCHAR) || '|' || i AS scenario_id, zone, CAST(date AS VARCHAR) AS date,
         dayname(date) AS day_of_week, rain_mm, temp_c, CAST(date IN (SELECT hd FROM hol) AS DOUBLE) AS is_holiday,
         CAST(isodow(date) >= 6 AS DOUBLE) AS is_weekend
  FROM (SELECT zone, date FROM tr) CROSS JOIN (VALUES {_PRESETS}) p(i, rain_mm, temp_c)),
scored AS (SELECT *, {_FORMULA.format(t='temp_c', r='rain_mm')} AS pred, {_FORMULA.format(t='28', r='0')} AS base FROM rated),
report AS (SELECT * EXCLUDE (pred, base), {_r('pred', 0)} AS predicted_revenue, {_r('base', 0)} AS baseline_revenue,
                  {_r('(pred - base) / base * 100', 1)} AS delta_pct FROM scored)"""


def _formula_report(spark, sf):
    train, holidays, zone_index = _inputs(spark, sf)
    rows = fc.scenario_features(fc.scenario_grid(train), holidays, zone_index)
    formula = F.expr(_FORMULA.format(t="avg_temp_c", r="precipitation_mm"))
    return fc.scenario_report(rows.withColumn("prediction", formula))


@register("M11_M12_scenario_arithmetic", with_sales(_SCENARIOS + """
SELECT *, CASE WHEN delta_pct < -10 THEN 'alert' WHEN delta_pct > 5 THEN 'opportunity' ELSE 'moderate' END AS verdict,
       CASE WHEN ABS(delta_pct) < 5 THEN 'Low' WHEN ABS(delta_pct) < 15 THEN 'Moderate' ELSE 'High' END AS impact
FROM report"""))
def m11_arithmetic(spark, sf):
    return _formula_report(spark, sf)


# share of the day's revenue in each hour from 06:00 on, as the report divides it
_SHARES = "0.02, 0.04, 0.07, 0.08, 0.09, 0.10, 0.11, 0.09, 0.07, 0.06, 0.06, 0.05, 0.05, 0.04, 0.04, 0.02, 0.01"


@register("M13_hourly_arithmetic", with_sales(_SCENARIOS + f""",
hours AS (SELECT h + 6 AS h, CAST([{_SHARES}][h + 1] AS DOUBLE) AS share FROM range(17) t(h)),
split AS (
  SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS hour, {_r('baseline_revenue * share', 0)} AS baseline,
         {_r('predicted_revenue * share * (1e0 - LEAST(rain_mm / 50e0, 1e0) * CASE WHEN h < 10 OR h > 18 THEN 0.3e0 ELSE 0.1e0 END)', 0)} AS predicted
  FROM report CROSS JOIN hours)
SELECT hour, COUNT(*) AS scenarios, SUM(baseline) AS baseline, SUM(predicted) AS predicted FROM split GROUP BY hour"""))
def m13_arithmetic(spark, sf):
    split = fc.hourly_trend(_formula_report(spark, sf))
    return split.groupBy("hour").agg(F.count(F.lit(1)).alias("scenarios"), F.sum("baseline").alias("baseline"),
                                     F.sum("predicted").alias("predicted"))


@register("M13_hourly_trend")
def m13(spark, sf):
    return fc.hourly_trend(_scenario_predictions(spark, sf))
