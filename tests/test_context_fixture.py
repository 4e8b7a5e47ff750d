"""Context operators on the FIXTURES.md context cases."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import context as cx

COLS = ("date string, is_holiday int, holiday_name string, holiday_type string, temp_max_c double, precipitation_mm double, "
        "weather_condition string, news_headlines string, news_disruptors string, llm_engine string, updated_at string")
ROWS = [
    ("2026-01-01", 1, "New Year's Day", "Commercial/Cultural", 24.0, 0.0, "Sunny", '["a","b","a"]',
     "Key signals are:\nPort strike\nRain alert", "rules", "2026-01-01T06:00"),
    ("2026-01-02", 0, None, None, None, None, "Unavailable", '["x"', "No headlines — LLM analysis skipped.", "none", "2026-01-01T06:00"),
    ("2026-01-03", 0, None, None, None, None, None, '["h1","h2"]', "No headlines — LLM analysis skipped.", "none", "2026-01-01T06:00"),
    ("2026-01-02", 0, None, None, 26.5, 1.0, "Cloudy", "[]", "No headlines — LLM analysis skipped.", "none", "2026-01-02T06:00"),
]


def test_upsert_last_write_wins(spark):
    ctx = spark.createDataFrame(ROWS, COLS)
    up = {r["date"]: r for r in cx.upsert(ctx.limit(0), ctx).collect()}
    assert len(up) == 3 and up["2026-01-02"]["weather_condition"] == "Cloudy"


def test_lookup_fallbacks(spark):
    ctx = spark.createDataFrame(ROWS[:3], COLS)
    dates = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (1, 2, 3, 4)], "date date")
    none = spark.createDataFrame([], "date date, name string, type string")
    got = {r["date"]: r for r in cx.context_lookup(dates, ctx, none).collect()}
    assert (got["2026-01-01"]["condition"], got["2026-01-01"]["weather_source"]) == ("Sunny", "context")
    assert (got["2026-01-02"]["temp_c"], got["2026-01-02"]["weather_source"]) == (27.0, "fallback")   # Unavailable
    assert got["2026-01-03"]["rain_mm"] == 0.5                                                        # null weather
    assert got["2026-01-01"]["holiday_name"] == "New Year's Day" and got["2026-01-04"]["holiday_source"] == "fallback"


def test_news_selection_and_risk(spark):
    ctx = spark.createDataFrame(ROWS[:3], COLS)
    news = {r["date"]: r for r in cx.news_selection(ctx).collect()}
    assert news["2026-01-01"]["news_kind"] == "disruptors"
    assert news["2026-01-02"]["news_kind"] == "none"                     # bad JSON → no headlines
    assert news["2026-01-03"]["headlines"] == "1. h1\n2. h2"             # marker text → headline list
    risk = cx.market_risk(ctx).first()
    assert risk["date"] == "2026-01-01" and risk["snippet"] == "Port strike | Rain alert"
    counts = {r["date"]: r["n_headlines"] for r in cx.headline_counts(ctx).collect()}
    assert counts == {"2026-01-01": 3, "2026-01-02": 0, "2026-01-03": 2}
