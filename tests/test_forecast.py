"""Model store, folds and augmentation."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillroll.operators import forecast as fc
from tillroll.sources import io

SMALL = fc.ForestParams(num_trees=5, max_depth=4)


@pytest.fixture(scope="module")
def features(spark):
    rows = [(z, dt.date(2026, 1, 1) + dt.timedelta(days=d), 1000.0 + 100 * (d % 7) + 500 * (z == "B"), 25.0 + d % 9, float(d % 4))
            for z in "AB" for d in range(40)]
    train = spark.createDataFrame(rows, "zone string, date date, net_revenue double, temp_max_c double, precipitation_mm double")
    holidays = spark.createDataFrame([(dt.date(2026, 1, 26),)], "date date")
    return io.staged(fc.with_features(fc.augment(train), holidays, fc.zone_encoder(train)), "features-test")


def test_model_is_fitted_once_for_its_content(spark, features, monkeypatch):
    store = io.scratch_path(spark, "models-test")
    first = fc.stored_model(fc.sized(features), SMALL, store)
    other_order = features.repartition(7, "net_revenue")
    assert fc.content_key(other_order, SMALL) == fc.content_key(features, SMALL)
    assert fc.content_key(features, fc.ForestParams(num_trees=6)) != fc.content_key(features, SMALL)
    assert fc.content_key(features.where("copy < 3"), SMALL) != fc.content_key(features, SMALL)
    monkeypatch.setattr(fc, "fit", lambda *a: pytest.fail("fitted twice"))
    again = fc.stored_model(other_order, SMALL, store)
    score = lambda m: [tuple(r) for r in m.transform(features).orderBy("zone", "date", "copy").select("prediction").collect()]
    assert score(first) == score(again)


def test_a_new_fit_gives_the_same_model(spark, features):
    a = fc.fit(fc.sized(features), SMALL).transform(features)
    b = fc.fit(fc.sized(features.repartition(5, "temp_max_c")), SMALL).transform(features)
    key = ["zone", "date", "copy", "prediction"]
    assert a.select(key).exceptAll(b.select(key)).count() == 0


def test_cross_validation_against_its_definition(spark, features):
    got = {r["metric"]: r["value"] for r in fc.cross_validate(features, SMALL).collect()}
    data = fc.sized(fc.date_folds(features, 5)).cache()
    scores = []
    for f in range(5):
        model = fc.fit(data.where(F.col("fold") != f), SMALL)
        pairs = [(r["net_revenue"], r["prediction"]) for r in model.transform(data.where(F.col("fold") == f)).collect()]
        mean = sum(y for y, _ in pairs) / len(pairs)
        scores.append(1 - sum((y - p) ** 2 for y, p in pairs) / sum((y - mean) ** 2 for y, _ in pairs))
    assert [got[f"fold_{i}"] for i in range(5)] == pytest.approx(scores, abs=1e-4)
    assert got["cv_r2_mean"] == pytest.approx(sum(scores) / 5, abs=1e-4)
    folds = data.groupBy("fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("fold").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(folds, folds[1:]))
    data.unpersist()


def test_augmented_rows_stay_in_their_bounds(spark):
    rows = [("A", dt.date(2026, 1, d), 100.0, 27.0, 0.5) for d in range(1, 29)]
    train = spark.createDataFrame(rows, "zone string, date date, net_revenue double, temp_max_c double, precipitation_mm double")
    out = fc.augment(train).collect()
    by_day = {}
    for r in out:
        by_day.setdefault(r["date"], []).append(r)
    assert len(by_day) == 28 and all(9 <= len(x) <= 13 for x in by_day.values()) and len({len(x) for x in by_day.values()}) > 2
    for r in out:
        if r["copy"] == 0:
            assert (r["net_revenue"], r["temp_max_c"], r["precipitation_mm"]) == (100.0, 27.0, 0.5)
        else:
            assert 23.0 <= r["temp_max_c"] <= 31.0 and 0.0 <= r["precipitation_mm"] <= 15.5
            low, high = (85.0 * 0.80, 115.0 * 0.95) if r["precipitation_mm"] > 10 else (85.0, 115.0)
            assert low - 1e-9 <= r["net_revenue"] <= high + 1e-9
    again = fc.augment(train.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out)) and not any(math.isnan(r["net_revenue"]) for r in out)
