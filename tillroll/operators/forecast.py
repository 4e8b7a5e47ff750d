"""Revenue forecasting and what-if scenarios: M1–M13 (Spark MLlib).

* Training rows are zone-day aggregates (M1), so the forest trains on (#zones × #days ×
  copies) rows whatever the size of the sales fact.
* Augmentation (M4) draws its noise from ``xxhash64(zone, date, copy, salt)``: the result
  is the same for any partitioning or retry, unlike ``rand()``.
* Cross-validation (M6) uses contiguous blocks of dates as folds (all copies of a
  zone-day stay in one fold); the k fits are a short driver loop over model fits, each a
  distributed job — there is no loop over data rows.
* Scenario grids (M12) and the hourly profile (M13) are literal arrays exploded per row,
  never cross joins with data.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, rnd
from tillroll.operators.context import DEFAULT_RAIN_MM, DEFAULT_TEMP_C
from tillroll.session import checkpoint_dir

# ── Fixed values ──────────────────────────────────────────────────────────────
FEATURE_ORDER = [
    "outlet_id",
    "day_mon", "day_tue", "day_wed", "day_thu", "day_fri", "day_sat", "day_sun",
    "is_weekend", "is_holiday",
    "avg_temp_c", "precipitation_mm",
]
BASELINE_TEMP_C = 28.0
BASELINE_RAIN_MM = 0.0
# what-if presets (rain mm, temp °C)
SCENARIO_PRESETS = [(0.0, 30.0), (2.0, 28.0), (5.0, 25.0), (15.0, 22.0), (30.0, 20.0)]
# share of daily revenue by hour, 06:00 … 22:00
HOURLY_PROFILE = {
    6: 0.02, 7: 0.04, 8: 0.07, 9: 0.08, 10: 0.09, 11: 0.10,
    12: 0.11, 13: 0.09, 14: 0.07, 15: 0.06, 16: 0.06, 17: 0.05,
    18: 0.05, 19: 0.04, 20: 0.04, 21: 0.02, 22: 0.01,
}


@dataclass(frozen=True)
class ForestParams:
    num_trees: int = 200
    max_depth: int = 12
    min_instances_per_node: int = 3
    seed: int = 42


# ── M1 ─────────────────────────────────────────────────────────────────────────
def training_set(sales: DataFrame, ctx: DataFrame) -> DataFrame:
    """M1 — zone-day revenue with positive totals (F11), weather joined by date (J1),
    defaults 27.0 °C / 0.5 mm where the context has none."""
    zd = (
        sales.filter(F.col("ZONE").isNotNull())
        .groupBy("ZONE", "INVOICE_DATE").agg(F.sum("NET_AMT").alias("net_revenue"))
        .filter(F.col("net_revenue") > 0)
    )
    wx = ctx.filter(F.col("temp_max_c").isNotNull()).select(
        F.col("date").cast("date").alias("INVOICE_DATE"), "temp_max_c", "precipitation_mm")
    return zd.join(wx, "INVOICE_DATE", "left").select(
        F.col("ZONE").alias("zone"), F.col("INVOICE_DATE").alias("date"),
        F.col("net_revenue").cast("double").alias("net_revenue"),
        F.coalesce("temp_max_c", F.lit(DEFAULT_TEMP_C)).alias("temp_max_c"),
        F.coalesce("precipitation_mm", F.lit(DEFAULT_RAIN_MM)).alias("precipitation_mm"),
    )


# ── M4 ─────────────────────────────────────────────────────────────────────────
def _u(salt: str) -> Column:
    """Uniform [0, 1) from a hash of (zone, date, copy, salt) — partitioning-independent."""
    h = F.xxhash64(F.col("zone"), F.col("date"), F.col("copy"), F.lit(salt))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def _between(lo: float, hi: float, salt: str) -> Column:
    return F.lit(lo) + (F.lit(hi - lo) * _u(salt))


def augment(train: DataFrame) -> DataFrame:
    """M4 — each row plus 8–12 perturbed copies: revenue ±15 %, temp ±4, rain
    +U(−2, 15) floored at 0, and rain > 10 mm cuts revenue by U(5 %, 20 %)."""
    n_aug = F.lit(8) + F.floor(F.pmod(F.xxhash64("zone", "date", F.lit("n")), F.lit(5)))
    rows = train.withColumn("copy", F.explode(F.sequence(F.lit(0), n_aug.cast("int"))))
    rain = F.greatest(F.lit(0.0), F.col("precipitation_mm") + _between(-2.0, 15.0, "rain"))
    rev = F.col("net_revenue") * (F.lit(1.0) + _between(-0.15, 0.15, "rev"))
    rev = F.when(rain > 10, rev * (F.lit(1.0) - _between(0.05, 0.20, "pen"))).otherwise(rev)
    orig = F.col("copy") == 0
    return rows.select(
        "zone", "date", "copy",
        F.when(orig, F.col("net_revenue")).otherwise(rev).alias("net_revenue"),
        F.when(orig, F.col("temp_max_c")).otherwise(F.col("temp_max_c") + _between(-4.0, 4.0, "temp")).alias("temp_max_c"),
        F.when(orig, F.col("precipitation_mm")).otherwise(rain).alias("precipitation_mm"),
    )


# ── M2 / M3 ────────────────────────────────────────────────────────────────────
def with_features(rows: DataFrame, holidays: DataFrame, zone_index: DataFrame) -> DataFrame:
    """M2 — weekday one-hots (Monday first), weekend, holiday flag, weather, zone id.

    ``holidays`` (date) holds national / state holiday dates (bounded by years × list);
    ``zone_index`` (zone, outlet_id) is the M3 encoding; unknown zones get 0."""
    wd = F.weekday("date")  # 0 = Monday
    names = ["day_mon", "day_tue", "day_wed", "day_thu", "day_fri", "day_sat", "day_sun"]
    hol = holidays.select(F.col("date").alias("hdate")).distinct().withColumn("hflag", F.lit(1))
    j = rows.join(F.broadcast(hol), rows["date"] == F.col("hdate"), "left").join(zone_index, "zone", "left")
    return j.select(
        *[c for c in rows.columns],
        F.coalesce("outlet_id", F.lit(0)).cast("double").alias("outlet_id"),
        *[(wd == i).cast("double").alias(n) for i, n in enumerate(names)],
        (wd >= 5).cast("double").alias("is_weekend"),
        F.coalesce("hflag", F.lit(0)).cast("double").alias("is_holiday"),
        F.col("temp_max_c").alias("avg_temp_c"),
        F.col("precipitation_mm").cast("double").alias("precipitation_mm_f"),
    ).drop("precipitation_mm").withColumnRenamed("precipitation_mm_f", "precipitation_mm")


def zone_encoder(zones: DataFrame) -> DataFrame:
    """M3 — index of each zone in sorted order, over the distinct zones only."""
    place = F.row_number().over(Window.orderBy("zone")) - 1
    return zones.select("zone").filter(F.col("zone").isNotNull()).distinct().select("zone", place.cast("double").alias("outlet_id"))


def sized(features: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """Few rows in few tasks, many in many: a forest runs a job per group of nodes.

    Rows are dealt by their key and lie in the order of their features, so the same rows always meet in
    the same task, and neighbours update the same nodes' statistics (half the time of a fit)."""
    parts = max(1, -(-features.count() // rows_per_task))
    return features.repartition(parts, "zone", "date", "copy").sortWithinPartitions(*FEATURE_ORDER, "zone", "date", "copy")


# ── M5 / M6 / M7 / M8 ──────────────────────────────────────────────────────────
def forest_pipeline(p: ForestParams) -> Pipeline:
    asm = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features")
    rf = RandomForestRegressor(
        featuresCol="features", labelCol="net_revenue", numTrees=p.num_trees, maxDepth=p.max_depth,
        minInstancesPerNode=p.min_instances_per_node, featureSubsetStrategy="all", seed=p.seed,
        # training-time knobs only (same model): node ids cached between levels and a
        # larger per-pass histogram budget, so deep trees need fewer passes over the data
        cacheNodeIds=True, maxMemoryInMB=1024, checkpointInterval=10,
    )
    return Pipeline(stages=[asm, rf])


def fit(features: DataFrame, p: ForestParams = ForestParams()) -> PipelineModel:
    """M5 — random forest on the assembled features."""
    checkpoint_dir(features.sparkSession)  # node-id cache checkpoints go to the shared folder
    return forest_pipeline(p).fit(features)


def date_folds(features: DataFrame, k: int) -> DataFrame:
    """Fold id per row: contiguous blocks of dates (calendar-bounded lookup table)."""
    dates = features.select("date").distinct()
    w = Window.orderBy("date")  # over distinct dates only (one row per day)
    idx = dates.select("date", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    folds = idx.select("date", F.floor(F.col("i") * k / F.col("n")).cast("int").alias("fold"))
    return features.join(F.broadcast(folds), "date")


def cross_validate(features: DataFrame, p: ForestParams = ForestParams(), n_rows: int | None = None) -> DataFrame:
    """M6 — ``min(5, n // 5)`` folds; R² per fold, mean and population std (4 dp)."""
    n = n_rows if n_rows is not None else features.count()
    k = min(5, n // 5)
    if k < 2:
        return features.sparkSession.createDataFrame([], "metric string, value double")
    data = sized(date_folds(features, k)).cache()  # one frame for all folds, cut by filters
    ev = RegressionEvaluator(labelCol="net_revenue", predictionCol="prediction", metricName="r2")

    def score(f: int) -> float:
        # a filter keeps the order of the rows
        model = fit(data.filter(F.col("fold") != f), p)
        return ev.evaluate(model.transform(data.filter(F.col("fold") == f)))

    # the k fits are independent Spark jobs; submitting a few together keeps the cluster
    # busy while bounding the concurrent split-statistics memory (≤ 3 × maxMemoryInMB)
    with ThreadPoolExecutor(max_workers=min(k, 3)) as pool:
        scores = list(pool.map(score, range(k)))
    data.unpersist()
    mean = sum(scores) / k
    std = (sum((s - mean) ** 2 for s in scores) / k) ** 0.5
    rows = [(f"fold_{i}", round(s, 4)) for i, s in enumerate(scores)] + [("cv_r2_mean", round(mean, 4)), ("cv_r2_std", round(std, 4))]
    return features.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """M7 — importances zipped to feature names, 4 dp, descending."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(((n, round(float(v), 4)) for n, v in zip(FEATURE_ORDER, imp)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    """M8 — persist the fitted pipeline (assembler + forest)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def content_key(features: DataFrame, p: ForestParams) -> str:
    """Digest of the rows, whatever their order, and of the parameters."""
    cells = [F.col(f"`{c}`") for c in sorted(features.columns)]
    n, total = features.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cells).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n} {total} {p} {FEATURE_ORDER}".encode()).hexdigest()[:32]


def stored_model(features: DataFrame, p: ForestParams = ForestParams(), store: str | None = None) -> PipelineModel:
    """M5 + M8 — the model of these rows and parameters from the store, a shared folder; fitted and put
    there first if it holds none.  The key is the content, so any session that reaches the
    folder gets the same model, and no process keeps one."""
    spark = features.sparkSession
    path = f"{store or checkpoint_dir(spark) + '/tillroll/models'}/{content_key(features, p)}"
    try:
        spark.read.parquet(f"{path}/ready").first()  # written last
    except AnalysisException:
        save_model(fit(features, p), f"{path}/model")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/ready")
    return load_model(f"{path}/model")


# ── M9 / M10 / M11 / M12 / M13 ─────────────────────────────────────────────────
def match_zone(text: Column, zones: Column) -> Column:
    """M10 — first zone (sorted) where either upper-cased name contains the other;
    otherwise the text as given."""
    hit = F.filter(zones, lambda z: (F.instr(F.upper(z), F.upper(text)) > 0) | (F.instr(F.upper(text), F.upper(z)) > 0))
    return F.coalesce(F.get(hit, F.lit(0)), text)


def predict_scenarios(model: PipelineModel, scenarios: DataFrame, holidays: DataFrame, zone_index: DataFrame) -> DataFrame:
    """M9 + M11 — the report over one transform of all scenario and baseline rows."""
    return scenario_report(model.transform(scenario_features(scenarios, holidays, zone_index)))


def scenario_features(scenarios: DataFrame, holidays: DataFrame, zone_index: DataFrame) -> DataFrame:
    """M9 — feature rows of every scenario and of its baseline (same zone and day, 28 °C, 0 mm).

    ``scenarios``: (scenario_id, zone, date, rain_mm, temp_c); null weather → defaults."""
    s = scenarios.select(
        "scenario_id", "zone", F.col("date").cast("date").alias("date"),
        F.coalesce("temp_c", F.lit(DEFAULT_TEMP_C)).cast("double").alias("temp_max_c"),
        F.coalesce("rain_mm", F.lit(DEFAULT_RAIN_MM)).cast("double").alias("precipitation_mm"),
        F.lit("scenario").alias("kind"),
    )
    b = s.select("scenario_id", "zone", "date", F.lit(BASELINE_TEMP_C).alias("temp_max_c"),
                 F.lit(BASELINE_RAIN_MM).alias("precipitation_mm"), F.lit("baseline").alias("kind"))
    return with_features(s.unionByName(b), holidays, zone_index)


def scenario_report(scored: DataFrame) -> DataFrame:
    """M11 — scenario beside baseline: change in percent, verdict and impact of scored feature rows."""
    piv = scored.groupBy("scenario_id", "zone", "date").agg(
        F.max(F.when(F.col("kind") == "scenario", F.col("prediction"))).alias("pred"),
        F.max(F.when(F.col("kind") == "baseline", F.col("prediction"))).alias("base"),
        F.max(F.when(F.col("kind") == "scenario", F.col("precipitation_mm"))).alias("rain_mm"),
        F.max(F.when(F.col("kind") == "scenario", F.col("avg_temp_c"))).alias("temp_c"),
        F.max(F.when(F.col("kind") == "scenario", F.col("is_holiday"))).alias("is_holiday"),
        F.max(F.when(F.col("kind") == "scenario", F.col("is_weekend"))).alias("is_weekend"),
    )
    delta = F.when(F.col("base") > 0, (F.col("pred") - F.col("base")) / F.col("base") * 100).otherwise(F.lit(0.0))
    d = rnd(delta, 1)
    return piv.select(
        "scenario_id", "zone", day_str("date").alias("date"), F.date_format("date", "EEEE").alias("day_of_week"),
        "rain_mm", "temp_c", "is_holiday", "is_weekend",
        rnd(F.col("pred"), 0).alias("predicted_revenue"), rnd(F.col("base"), 0).alias("baseline_revenue"),
        d.alias("delta_pct"),
        F.when(d < -10, "alert").when(d > 5, "opportunity").otherwise("moderate").alias("verdict"),
        F.when(F.abs(d) < 5, "Low").when(F.abs(d) < 15, "Moderate").otherwise("High").alias("impact"),
    )


def scenario_grid(zone_days: DataFrame) -> DataFrame:
    """M12 — the five (rain, temp) presets for every (zone, date) row: an exploded literal
    array, not a join."""
    presets = F.array(*[F.struct(F.lit(i).alias("preset"), F.lit(r).alias("rain_mm"), F.lit(t).alias("temp_c"))
                        for i, (r, t) in enumerate(SCENARIO_PRESETS)])
    g = zone_days.select("zone", "date", F.explode(presets).alias("p"))
    return g.select(
        F.concat_ws("|", "zone", day_str("date"), F.col("p.preset").cast("string")).alias("scenario_id"),
        "zone", "date", F.col("p.rain_mm").alias("rain_mm"), F.col("p.temp_c").alias("temp_c"),
    )


def hourly_trend(predictions: DataFrame) -> DataFrame:
    """M13 — 17-hour split of predicted and baseline revenue; rain suppresses off-peak
    hours (before 10, after 18) by 30 % × factor, others by 10 % × factor, factor =
    min(rain / 50, 1); rounded to units."""
    prof = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(p).alias("share")) for h, p in HOURLY_PROFILE.items()])
    x = predictions.select("scenario_id", "rain_mm", "predicted_revenue", "baseline_revenue", F.explode(prof).alias("h"))
    factor = F.least(F.col("rain_mm") / 50.0, F.lit(1.0))
    off_peak = (F.col("h.hour") < 10) | (F.col("h.hour") > 18)
    suppress = F.when(off_peak, F.lit(1.0) - factor * 0.3).otherwise(F.lit(1.0) - factor * 0.1)
    return x.select(
        "scenario_id",
        F.format_string("%02d:00", F.col("h.hour")).alias("hour"),
        rnd(F.col("baseline_revenue") * F.col("h.share"), 0).alias("baseline"),
        rnd(F.col("predicted_revenue") * F.col("h.share") * suppress, 0).alias("predicted"),
    )
