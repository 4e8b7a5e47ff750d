"""Inputs on which earlier versions answered wrongly or failed."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import SF_MID
from fixtures import sales_df
from tillroll.operators import audit, basket, clean, context as cx, forecast
from tillroll.sources import context_feed as cf, io
from tillroll.sources.tables import read_table


def test_every_document_has_a_date(spark):
    docs = read_table(spark, SF_MID, "documents")
    calendar = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (1, 3, 4)], "date date").transform(cf.date_index)
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        lines = [x.strip(" ") for x in r["text"].split("\n")]
        want.setdefault(r["doc_id"] % 3, {}).update(dict.fromkeys(x for x in lines if x))
    got = {r["date"]: r["h"] for r in cf.headlines_by_date(docs, calendar, keep=1 << 30).collect()}
    assert [got[dt.date(2026, 1, d)] for d in (1, 3, 4)] == [list(want[k]) for k in range(3)]
    cut = {r["date"]: r["h"] for r in cf.headlines_by_date(docs, calendar).collect()}
    assert all(cut[d] == got[d][:10] for d in got)


def test_primary_total_takes_the_first_fact_with_sums(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, [("x", 10.0), ("z", 3.0)]), (1, 2, [("y", 99.0)]), (2, 0, [("y", 9.0)]),
                                (2, 1, [("Total", 1.0)])],
                               "answer_id int, fact_order int, column_sums array<struct<col: string, sum: double>>")
    got = {r["answer_id"]: (r["verified_total"], r["verified_column"]) for r in audit.primary_total(df).collect()}
    assert got == {1: (10.0, "x"), 2: (1.0, "Total")}


def test_error_text_after_a_newline_is_no_table(spark):
    text = "\nERROR: x\n| a | b |\n|---|---|\n| 1 | 2 |"
    df = spark.createDataFrame([(text,), ("| a | b |\n|---|---|\n| 12d | NaN |",)], "text string")
    bad, odd = audit.table_digest(df, "text").collect()
    assert bad["row_count"] is None and odd["column_sums"] == []


def test_numbers_are_decimal_literals(spark):
    df = spark.createDataFrame([("12d", "1"), ("NaN", " -2.5e1 "), ("5f", ".5")], "a string, b string")
    assert [r[0] for r in df.select(clean.clean_numeric(F.col("a"))).collect()] == [0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(clean.clean_numeric(F.col("b"))).collect()] == [1.0, -25.0, 0.5]
    assert dict(io.apply_numeric_typing(df).dtypes) == {"a": "string", "b": "double"}


def test_incoming_row_wins_whatever_its_stamp(spark):
    cols = "date string, v string, updated_at string"
    old = spark.createDataFrame([("d1", "stored", "2026-02-01"), ("d2", "stored", "2026-01-01")], cols)
    new = spark.createDataFrame([("d1", "late", "2026-01-01"), ("d3", "b", "x"), ("d3", "a", "x")], cols)
    rows = [tuple(r) for r in cx.upsert(old, new).orderBy("date").collect()]
    assert rows[:2] == [("d1", "late", "2026-01-01"), ("d2", "stored", "2026-01-01")] and len(rows) == 3
    assert rows == [tuple(r) for r in cx.upsert(old, new.repartition(3)).orderBy("date").collect()]


def test_national_holiday_without_a_stored_row(spark):
    dates = spark.createDataFrame([(dt.date(2026, 1, 26),), (dt.date(2026, 6, 2),), (dt.date(2026, 1, 27),)], "date date")
    empty = spark.createDataFrame([], "date string, is_holiday int, holiday_name string, holiday_type string, "
                                      "temp_max_c double, precipitation_mm double, weather_condition string")
    got = {r["date"]: (r["is_holiday"], r["holiday_name"], r["holiday_type"])
           for r in cx.context_lookup(dates, empty, cf.holiday_table(dates)).collect()}
    assert got["2026-01-26"] == (True, "Republic Day", "National") and got["2026-01-27"] == (False, None, None)
    assert got["2026-06-02"] == (True, "Telangana Formation Day", "State")


def test_bills_of_blank_products_count(spark):
    rows = [("Z", "2026-01-01", 1, 100, "A", 2), ("Z", "2026-01-01", 1, 100, "B", 2), ("Z", "2026-01-01", 2, 100, "A", 2),
            ("Z", "2026-01-01", 3, 100, "", 2)]
    r = basket.live_basket(sales_df(spark, rows)).collect()
    assert [(x["item_a"], x["item_b"], x["support_pct"]) for x in r] == [("A", "B", 33.33)]


def test_no_zone_named(spark):
    one = spark.createDataFrame([("nowhere", ["East"])], "t string, zs array<string>")
    assert one.select(forecast.match_zone(F.col("t"), F.col("zs"))).first()[0] == "nowhere"
    texts = spark.createDataFrame([(1, "heavy rain on friday", dt.date(2026, 1, 1))], "scenario_id int, text string, ref_date date")
    zones = spark.createDataFrame([(["East"],)], "zones array<string>")
    assert audit.scenario_tags(texts, zones).first()["zone"] is None


def test_no_headline_marker_in_any_case(spark):
    ctx = spark.createDataFrame([("2026-01-01", None, None, "no HEADLINES today")],
                                "date string, holiday_name string, weather_condition string, news_disruptors string")
    assert cx.market_risk(ctx).count() == 0


def test_headlines_widen_until_a_date_has_enough(spark):
    """Date 0: the first 30 documents repeat one line, later ones bring the rest; date 1: few lines in all;
    date 2: null and empty texts only; ids repeat."""
    docs = [(3 * i, "same\nsame") for i in range(30)] + [(3 * i, f"late {i}\nsame\n late {i} ") for i in range(30, 200)]
    docs += [(1 + 3 * i, f"x{i % 4}\n\n") for i in range(150)] + [(2, None), (5, ""), (5, ""), (4, "tie b"), (4, "tie a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    dates = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (1, 2, 3)], "date date")
    got = {r["date"].day: r["h"] for r in cf.headlines_by_date(frame, cf.date_index(dates)).collect()}
    want = {}
    for k in range(3):
        seen = []
        for d, t in sorted((x for x in docs if x[0] % 3 == k), key=lambda x: x[0]):
            seen += [y.strip() for y in (t or "").split("\n") if y.strip() and y.strip() not in seen]
        want[k + 1] = list(dict.fromkeys(seen))[:10]
    assert got[1] == want[1] and got[3] == [] and set(got[2][:4]) <= set(want[2]) and sorted(got[2]) == sorted(want[2])


def test_upsert_leaves_other_months_alone(spark):
    import glob

    from tillroll.operators import context as ctx
    from tillroll.sources import io

    rows = [(f"2026-{m:02}-{d:02}", f"old {m} {d}", "v1", "rule") for m in (1, 2, 3) for d in (1, 2)]
    schema = "date string, note string, updated_at string, weather_source string"
    path = io.scratch_path(spark, "months-test")
    ctx.write_months(spark.createDataFrame(rows, schema), path)
    files = lambda month: set(glob.glob(f"{path.removeprefix('file:')}/month=2026-{month}/*.parquet"))
    before = {m: files(m) for m in ("01", "02", "03")}
    assert all(before.values())
    ctx.upsert_months(spark.createDataFrame([("2026-02-02", "new", "v0", "x"), ("2026-04-01", "new", "v0", "x")], schema), path)
    assert files("01") == before["01"] and files("03") == before["03"] and files("02") != before["02"]
    got = {r["date"]: r["note"] for r in spark.read.parquet(path).collect()}
    assert got == {d: n for d, n, *_ in rows} | {"2026-02-02": "new", "2026-04-01": "new"}
