"""Behaviour checks on the reference test suite's fixtures (re-expressed as DataFrames)."""

import pytest
from pyspark.sql import functions as F

from fixtures import sales_df, series
from tillroll.operators import anomaly, audit, kpi


def _bill_register(spark):
    # Outlet A 100 (T1) and Outlet B 200 (T2) on 01-01, Outlet A 50 (T3) on 01-02
    return sales_df(spark, [
        ("Outlet A", "2026-01-01", 1, 100, "Latte", 2),
        ("Outlet B", "2026-01-01", 2, 200, "Muffin", 1),
        ("Outlet A", "2026-01-02", 3, 50, "Latte", 1),
    ])


def test_total_and_day_totals(spark):
    s = _bill_register(spark)
    assert kpi.window_totals(s).first()["total_revenue"] == 350.0
    assert kpi.single_day_total(s, "2026-01-01").first()["total_revenue"] == 300.0
    assert kpi.single_day_total(s, "2030-01-01").first()["total_revenue"] is None


def _tags(spark, sales, questions):
    q = spark.createDataFrame([(str(i), t) for i, t in enumerate(questions)], "question_id string, question string")
    rows = audit.tag_questions(q, kpi.zone_bounds(sales)).orderBy(F.col("question_id").cast("int")).collect()
    return [r["intent"] for r in rows]


def test_intent_tags(spark):
    s = _bill_register(spark)
    got = _tags(spark, s, [
        "What is the total revenue for the chain?",
        "What was the total revenue on 2026-01-01?",
        "Why did revenue drop on 2026-01-02?",
        "Tell me a joke about coffee",
        "hi",
        "Why did sales dip on 2026-03-01?",       # past the data: no template
        "Revenue dropped on 2026-01-02",         # 'dropped' is not the stem 'drop' (kept literally)
    ])
    assert got == ["total_revenue", "single_day_chain_revenue", "decline_on_date", None, None, None, None]


def _premise(spark, values, day):
    s = series(spark, values)
    q = spark.createDataFrame([("q", f"Why did revenue drop on {day}?")], "question_id string, question string")
    return audit.premise_audit(q, audit.daily_ranks(s)).first()


def test_premise_peak_conflict(spark):
    r = _premise(spark, [300, 100, 200], "2026-01-01")
    assert (r["rank"], r["total_days"], r["is_peak"], r["premise_conflict"]) == (1, 3, True, True)


def test_premise_trough_no_conflict(spark):
    r = _premise(spark, [500, 50, 400, 350, 300], "2026-01-02")
    assert (r["rank"], r["is_peak"], r["premise_conflict"]) == (5, False, False)


def test_premise_absent_date(spark):
    r = _premise(spark, [300, 100, 200], "2026-02-01")
    assert r["rank"] is None and r["premise_conflict"] is False


def test_premise_needs_decline_wording(spark):
    s = series(spark, [300, 100, 200])
    q = spark.createDataFrame([("q", "What was revenue on 2026-01-01?")], "question_id string, question string")
    assert audit.premise_audit(q, audit.daily_ranks(s)).count() == 0


def test_anomaly_dip_series(spark):
    s = series(spark, [80, 82, 78, 81, 79, 83, 77, 80, 5])
    got = {(r["date"], r["severity"], r["z_score"]) for r in anomaly.detect_anomalies(s).collect()}
    assert got == {("2026-01-09", "CRITICAL", -34.72), ("2026-01-03", "WARNING", -2.12), ("2026-01-07", "WARNING", -1.87)}


def test_anomaly_constant_window_and_zero_days(spark):
    # constant lookback -> sigma 0 -> z 0 (no flag); zero-revenue days skipped and ignored
    s = series(spark, [10, 10, 10, 0, 10, 50])
    st = anomaly.rolling_zscore(kpi.zone_day_revenue(s)).orderBy("INVOICE_DATE").collect()
    assert st[2]["z_score"] == 0.0 and st[1]["z_score"] is None
    assert st[5]["n_lookback"] == 4  # the 0 day does not count
    assert anomaly.detect_anomalies(s).filter("date = '2026-01-04'").count() == 0


def _digest(spark, text):
    df = spark.createDataFrame([("t", text)], "id string, text string")
    return audit.table_digest(df, "text").first()


def test_digest_revenue_table(spark):
    t = "| outlet | revenue |\n|---|---|\n| A | 1,000,000 |\n| B | 300,012 |\n| C | 39,000 |"
    r = _digest(spark, t)
    assert r["row_count"] == 3 and [(c["col"], c["sum"]) for c in r["column_sums"]] == [("revenue", 1339012.0)]


def test_digest_largest_table_and_commas(spark):
    t = "| x | y |\n|---|---|\n| 1 | 5 |\n\ntext\n\n| k | y | amt |\n| :--- | ---: | --- |\n| a | 20 | 1,000.25 |\n| b | 40 | 2,000.25 |"
    r = _digest(spark, t)
    assert r["row_count"] == 2
    assert dict((c["col"], c["sum"]) for c in r["column_sums"]) == {"y": 60.0, "amt": 3000.5}


@pytest.mark.parametrize("text", ["ERROR: no such table", "Query returned 0 rows.", "", "plain words only"])
def test_digest_none(spark, text):
    assert _digest(spark, text)["row_count"] is None


def _audit(spark, answer, total):
    a = spark.createDataFrame([("a", answer)], "answer_id string, answer string")
    v = spark.createDataFrame([("a", float(total), "revenue")], "answer_id string, verified_total double, verified_column string")
    return audit.numeric_audit(a, v).first()["flag"]


def test_numeric_mismatch_flags(spark):
    assert _audit(spark, "Chain revenue was ₹5,318,119 in total.", 3653162) == "numeric_mismatch"
    assert _audit(spark, "Chain revenue was ₹20,000.", 100000) == "numeric_mismatch_low"
    assert _audit(spark, "Chain revenue was ₹3,653,162.", 3653162) is None


def test_money_extraction(spark):
    df = spark.createDataFrame([("Mix ₹3,653,162 and 5318119 and small 50",)], "t string")
    nums = df.select(F.filter(audit.money_numbers(F.col("t")), lambda x: x >= 10000).alias("n")).first()["n"]
    assert sorted(nums) == [3653162.0, 5318119.0]


def test_causal_flag(spark):
    answers = spark.createDataFrame([("a", "Revenue fell because of heavy rain."), ("b", "Revenue was flat."),
                                     ("c", "Revenue fell because of heavy rain.")], "answer_id string, answer string")
    ev = spark.createDataFrame([("a", "get_weather_context", "No row", True), ("b", "get_weather_context", "No row", True),
                                ("c", "get_weather_context", "Avg temp=30, Precipitation=0mm", True)],
                               "answer_id string, tool string, result string, success boolean")
    got = {r["answer_id"]: r["flag"] for r in audit.causal_audit(answers, ev).collect()}
    assert got == {"a": "causal_language_review", "b": None, "c": None}
    off = {r["answer_id"]: r["flag"] for r in audit.causal_audit(answers, ev, enabled=False).collect()}
    assert set(off.values()) == {None}


def test_kpi_args_contract():
    assert kpi.KpiArgs.of([" A ", "", "B"], "2026-01-01", "2026-01-31").zones == ("A", "B")
    with pytest.raises(ValueError):
        kpi.KpiArgs.of(["A"], "2026-13-01", "2026-01-31")
    with pytest.raises(ValueError):
        kpi.KpiArgs.of(["A"], "2026-02-01", "2026-01-31")
