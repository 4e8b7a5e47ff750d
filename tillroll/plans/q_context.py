"""Registered context / calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str
from tillroll.operators import anomaly
from tillroll.operators import context as cx
from tillroll.operators.anomaly import detect_anomalies
from tillroll.operators.kpi import zone_day_revenue
from tillroll.plans.registry import ORACLES, register, sales_of, with_sales
from tillroll.sources import context_feed as cf
from tillroll.sources import io
from tillroll.sources.tables import read_table

_CTX = (
    "WITH ctx_dates AS (SELECT DISTINCT INVOICE_DATE AS date FROM sales),\n"
    "cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM ctx_dates),\n"
    + cx.commercial_sql() + ",\n"
    + cf.context_sql() + "\n"
)


def _ctx_sql(body: str) -> str:
    return with_sales(_CTX + body)


def _feed(spark, sf):
    return cf.context_feed(spark, sf)


@register("C7_context_feed", _ctx_sql("SELECT * FROM ctx"))
def c_feed(spark, sf):
    return _feed(spark, sf)


@register("C1_C2_C3_holiday_resolution", _ctx_sql("SELECT date, is_holiday, holiday_name, holiday_type FROM ctx"))
def c3(spark, sf):
    dates = cf.sales_dates(spark, sf)
    h = cx.resolve_holidays(dates, cf.holiday_table(dates))
    return h.select(day_str("date").alias("date"), "is_holiday", "holiday_name", "holiday_type")


@register("C1_commercial_events", _ctx_sql("""
SELECT CAST(c.date AS VARCHAR) AS date, m.name AS event FROM ctx_dates c JOIN commercial m ON m.md = strftime(c.date, '%m-%d')"""))
def c1(spark, sf):
    d = cf.sales_dates(spark, sf)
    return d.select(day_str("date").alias("date"), cx.fixed_event(F.col("date")).alias("event")).filter(F.col("event").isNotNull())


@register("C2_nth_sunday_events", _ctx_sql("""
SELECT CAST(date AS VARCHAR) AS date,
       CASE WHEN month(date) = 5 AND (day(date) - 1) // 7 + 1 = 2 THEN 'Mother''s Day'
            WHEN month(date) = 6 AND (day(date) - 1) // 7 + 1 = 3 THEN 'Father''s Day'
            WHEN month(date) = 8 AND (day(date) - 1) // 7 + 1 = 1 THEN 'Friendship Day' END AS event
FROM ctx_dates WHERE dayofweek(date) = 0
  AND ((month(date) = 5 AND (day(date) - 1) // 7 + 1 = 2) OR (month(date) = 6 AND (day(date) - 1) // 7 + 1 = 3)
       OR (month(date) = 8 AND (day(date) - 1) // 7 + 1 = 1))"""))
def c2(spark, sf):
    d = cf.sales_dates(spark, sf)
    return d.select(day_str("date").alias("date"), cx.nth_sunday_event(F.col("date")).alias("event")).filter(F.col("event").isNotNull())


_LOOKUP_SQL = """
look AS (SELECT CAST(q.date AS VARCHAR) AS date,
        CASE WHEN ok THEN temp_max_c ELSE 27.0 END AS temp_c,
        CASE WHEN ok THEN precipitation_mm ELSE 0.5 END AS rain_mm,
        CASE WHEN ok THEN weather_condition ELSE 'Unknown' END AS condition,
        CASE WHEN ok THEN 'context' ELSE 'fallback' END AS weather_source,
        CASE WHEN stored THEN is_holiday = 1 ELSE gname IS NOT NULL OR cname IS NOT NULL END AS is_holiday,
        CASE WHEN stored THEN CASE WHEN is_holiday = 1 THEN COALESCE(holiday_name, 'Holiday') END ELSE COALESCE(gname, cname) END AS holiday_name,
        CASE WHEN stored THEN CASE WHEN is_holiday = 1 THEN COALESCE(holiday_type, 'Public') END
             WHEN gname = 'Telangana Formation Day' THEN 'State' WHEN gname IS NOT NULL THEN 'National'
             WHEN cname IS NOT NULL THEN 'Commercial/Cultural' END AS holiday_type,
        CASE WHEN stored THEN 'context' ELSE 'fallback' END AS holiday_source
 FROM (SELECT q.date, c.*, c.date IS NOT NULL AS stored,
              CASE strftime(q.date, '%m-%d') WHEN '01-26' THEN 'Republic Day' WHEN '06-02' THEN 'Telangana Formation Day'
                   WHEN '08-15' THEN 'Independence Day' WHEN '10-02' THEN 'Gandhi Jayanti' END AS gname,
              COALESCE(c.weather_condition IS NOT NULL AND c.weather_condition <> '' AND NOT contains(c.weather_condition, 'Unavailable'), false) AS ok,
              CASE WHEN strftime(q.date, '%m-%d') IN (SELECT md FROM commercial) THEN (SELECT name FROM commercial WHERE md = strftime(q.date, '%m-%d'))
                   WHEN dayofweek(q.date) = 0 AND month(q.date) = 5 AND (day(q.date) - 1) // 7 + 1 = 2 THEN 'Mother''s Day'
                   WHEN dayofweek(q.date) = 0 AND month(q.date) = 6 AND (day(q.date) - 1) // 7 + 1 = 3 THEN 'Father''s Day'
                   WHEN dayofweek(q.date) = 0 AND month(q.date) = 8 AND (day(q.date) - 1) // 7 + 1 = 1 THEN 'Friendship Day' END AS cname
       FROM qdates q LEFT JOIN ctx c ON CAST(c.date AS DATE) = q.date) q)"""


@register("C4_context_lookup_week_spine", _ctx_sql(""",
qdates AS (SELECT DISTINCT CAST(unnest(generate_series(date_trunc('week', d), date_trunc('week', d) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date
           FROM (SELECT date AS d FROM ctx_dates)),""" + _LOOKUP_SQL + "\nSELECT * FROM look"))
def c4(spark, sf):
    # every date of every ISO week touched by the data: includes dates with no stored row
    dates = cf.sales_dates(spark, sf)
    spine = cx.iso_week_spine(dates.select(F.col("date").alias("anchor")))
    return cx.context_lookup(spine, _feed(spark, sf), cf.holiday_table(spine))


_NEWS_SQL = """
news AS (SELECT date,
        CASE WHEN use_d THEN 'disruptors' WHEN len(h) > 0 THEN 'headlines' ELSE 'none' END AS news_kind,
        CASE WHEN use_d THEN d END AS disruptors,
        CASE WHEN use_d THEN array_to_string(list_transform(list_slice(h, 1, 6), lambda x, i: CAST(i AS VARCHAR) || '. ' || left(x, 100)), chr(10))
             WHEN len(h) > 0 THEN array_to_string(list_transform(list_slice(h, 1, 8), lambda x, i: CAST(i AS VARCHAR) || '. ' || left(x, 100)), chr(10)) END AS headlines
 FROM (SELECT date, trim(COALESCE(news_disruptors, '')) AS d,
              COALESCE(CASE WHEN json_valid(news_headlines) THEN from_json(news_headlines, '["VARCHAR"]') END, CAST([] AS VARCHAR[])) AS h,
              trim(COALESCE(news_disruptors, '')) <> '' AND NOT contains(trim(COALESCE(news_disruptors, '')), 'No headlines')
              AND NOT contains(lower(trim(COALESCE(news_disruptors, ''))), 'skipped') AS use_d
       FROM ctx))"""


@register("C5_news_selection", _ctx_sql("," + _NEWS_SQL + "\nSELECT * FROM news"))
def c5(spark, sf):
    return cx.news_selection(_feed(spark, sf))


@register("C6_iso_week_spine_latest", _ctx_sql("""
SELECT DISTINCT CAST(unnest(generate_series(date_trunc('week', d), date_trunc('week', d) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT MAX(date) AS d FROM ctx_dates)"""))
def c6(spark, sf):
    d = cf.sales_dates(spark, sf).agg(F.max("date").alias("anchor"))
    return cx.iso_week_spine(d)


@register("J7_week_revenue", with_sales("""
WITH spine AS (SELECT DISTINCT CAST(unnest(generate_series(date_trunc('week', d), date_trunc('week', d) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date
               FROM (SELECT MAX(INVOICE_DATE) AS d FROM sales)),
daily AS (SELECT INVOICE_DATE AS date, CAST(ROUND(SUM(NET_AMT), 2) AS DOUBLE) AS revenue FROM sales GROUP BY INVOICE_DATE)
SELECT CAST(s.date AS VARCHAR) AS date, d.revenue FROM spine s LEFT JOIN daily d ON d.date = s.date"""))
def j7(spark, sf):
    s = sales_of(spark, sf, "INVOICE_DATE", "NET_AMT")
    spine = cx.iso_week_spine(s.agg(F.max("INVOICE_DATE").alias("anchor")))
    daily = s.groupBy(F.col("INVOICE_DATE").alias("date")).agg(F.round(F.sum("NET_AMT"), 2).cast("double").alias("revenue"))
    return cx.week_revenue(spine, daily).select(day_str("date").alias("date"), "revenue")


def _week_rows(spark, sf):
    """C7 — context rows for the ISO week of the latest sales date (version 2)."""
    dates = cf.sales_dates(spark, sf)
    spine = cx.iso_week_spine(dates.agg(F.max("date").alias("anchor")))
    return cf.build_context(spine, read_table(spark, sf, "documents"), cf.date_index(dates), cf.UPDATED_V2)


_WEEK_CTE = (
    "wk_dates AS (SELECT DISTINCT CAST(unnest(generate_series(date_trunc('week', d), date_trunc('week', d) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date\n"
    "             FROM (SELECT MAX(date) AS d FROM ctx_dates)),\n"
    + cf.context_sql("wk_dates", cf.UPDATED_V2, "wk")
)
_REFRESH = """
refresh AS (SELECT date, is_holiday, holiday_name, holiday_type,
                   24.0 + ((date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) * 11) % 60) / 10.0 AS temp_max_c,
                   0.0 AS precipitation_mm, 'Partly cloudy' AS weather_condition, 'refetch' AS weather_source,
                   CAST(NULL AS VARCHAR) AS weather_api_error, news_headlines, news_disruptors, llm_engine, gemini_model_used,
                   '""" + cf.UPDATED_V2 + """' AS updated_at
            FROM ctx WHERE weather_condition = 'Unavailable')"""


@register("S9_context_upsert", _ctx_sql("," + _WEEK_CTE + "," + _REFRESH + """,
u AS (SELECT 0 AS side, * FROM ctx UNION ALL SELECT 1, * FROM refresh UNION ALL SELECT 1, * FROM wk)
SELECT * EXCLUDE (rn, side) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY side DESC, updated_at DESC, weather_source) AS rn FROM u) WHERE rn = 1"""))
def s9(spark, sf):
    feed = _feed(spark, sf)
    incoming = cf.weather_refresh(feed).unionByName(_week_rows(spark, sf))
    return cx.upsert(feed, incoming)


@register("S9_context_month_store", ORACLES["S9_context_upsert"])
def s9_months(spark, sf):
    """The same upsert on the stored, month-partitioned table."""
    feed = io.staged(_feed(spark, sf), "context")
    path = io.scratch_path(spark, "context_store")
    cx.write_months(feed, path)
    cx.upsert_months(cf.weather_refresh(feed).unionByName(_week_rows(spark, sf)), path)
    return spark.read.parquet(path).drop("month")


@register("S10_context_schema_evolution", _ctx_sql("," + _REFRESH + """,
old AS (SELECT date, is_holiday, holiday_name, holiday_type, temp_max_c, precipitation_mm, weather_condition, weather_source,
               CAST(NULL AS VARCHAR) AS weather_api_error, news_headlines, news_disruptors,
               CAST(NULL AS VARCHAR) AS llm_engine, CAST(NULL AS VARCHAR) AS gemini_model_used, updated_at FROM ctx),
u AS (SELECT * FROM old UNION ALL SELECT * FROM refresh)
SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY updated_at DESC) AS rn FROM u) WHERE rn = 1"""))
def s10(spark, sf):
    feed = _feed(spark, sf)
    old = feed.drop(*cf.MIGRATED_COLUMNS)  # rows written before the three columns existed
    return cx.upsert(old, cf.weather_refresh(feed)).select(*cf.CONTEXT_COLUMNS)


@register("C8_latest_rows", _ctx_sql("""
SELECT date, holiday_name, temp_max_c, precipitation_mm, weather_condition, llm_engine FROM ctx ORDER BY date DESC LIMIT 10"""))
def c8a(spark, sf):
    return cx.latest_rows(_feed(spark, sf))


@register("C8_headline_counts", _ctx_sql("""
SELECT date, len(COALESCE(CASE WHEN json_valid(news_headlines) THEN from_json(news_headlines, '["VARCHAR"]') END, CAST([] AS VARCHAR[]))) AS n_headlines
FROM ctx"""))
def c8b(spark, sf):
    return cx.headline_counts(_feed(spark, sf))


@register("C8_engine_tally", _ctx_sql("SELECT llm_engine, COUNT(*) AS rows FROM ctx GROUP BY llm_engine"))
def c8c(spark, sf):
    return cx.engine_tally(_feed(spark, sf))


@register("C8_holiday_spotlight", _ctx_sql("SELECT date, holiday_name, holiday_type FROM ctx WHERE is_holiday = 1"))
def c8d(spark, sf):
    return cx.holiday_spotlight(_feed(spark, sf))


@register("C9_market_risk", _ctx_sql("""
SELECT date, holiday_name AS holiday, weather_condition AS weather, snippet,
       date || CASE WHEN holiday_name IS NOT NULL THEN ' · ' || holiday_name ELSE '' END
            || CASE WHEN weather_condition IS NOT NULL AND NOT contains(weather_condition, 'Unavailable') THEN ' · ' || weather_condition ELSE '' END
            || ' — ' || snippet || CASE WHEN length(news_disruptors) > 140 THEN '…' ELSE '' END AS label
FROM (SELECT *, left(replace(trim(regexp_replace(news_disruptors, '^.*?(?:identified|are):\\s*', '', 'is')), chr(10), ' | '), 140) AS snippet
      FROM ctx WHERE news_disruptors IS NOT NULL AND news_disruptors NOT ILIKE 'no headlines%'
      ORDER BY date DESC LIMIT 1)"""))
def c9(spark, sf):
    return cx.market_risk(_feed(spark, sf))


@register("O6_headline_dedup", """
SELECT doc_id, to_json(list_slice(list_filter(lf, lambda x, i: list_position(lf, x) = i), 1, 10))::VARCHAR AS headlines
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lf FROM documents)""")
def o6(spark, sf):
    docs = read_table(spark, sf, "documents")
    return docs.select("doc_id", F.to_json(cf.headline_lines(F.col("text"))).alias("headlines"))


@register("J1_zone_day_weather", _ctx_sql("""
SELECT z.ZONE AS zone, CAST(z.d AS VARCHAR) AS date, CAST(z.rev AS DOUBLE) AS revenue,
       COALESCE(w.temp_max_c, 27.0) AS temp_max_c, COALESCE(w.precipitation_mm, 0.5) AS precipitation_mm
FROM (SELECT ZONE, INVOICE_DATE AS d, ROUND(SUM(NET_AMT), 2) AS rev FROM sales WHERE ZONE IS NOT NULL GROUP BY 1, 2) z
LEFT JOIN (SELECT CAST(date AS DATE) AS d, temp_max_c, precipitation_mm FROM ctx WHERE temp_max_c IS NOT NULL) w ON w.d = z.d"""))
def j1(spark, sf):
    zd = zone_day_revenue(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"))
    j = cx.weather_join(zd, cf.weather_feed(spark, sf))
    return j.select(F.col("ZONE").alias("zone"), day_str("INVOICE_DATE").alias("date"), F.col("rev").cast("double").alias("revenue"),
                    "temp_max_c", "precipitation_mm")


def _n7_sql() -> str:
    from tillroll.plans.q_anomaly import _classified
    anoms = _classified(-1.5)
    # reuse the anomaly CTE chain, then the context chain; both need the sales CTE
    body = anoms.replace("WITH zd AS", "zd AS", 1)
    sel_at = body.rindex("SELECT CAST(INVOICE_DATE AS VARCHAR) AS date, ZONE AS outlet_name")
    ctes, sel = body[:sel_at], body[sel_at:]
    return with_sales(
        _CTX + "," + ctes.rstrip().rstrip(",") + ",\nanoms AS (" + sel + "),\n"
        + "qdates AS (SELECT DISTINCT CAST(date AS DATE) AS date FROM anoms)," + _LOOKUP_SQL + "," + _NEWS_SQL + """
SELECT a.*, l.temp_c, l.rain_mm, l.condition, l.weather_source, l.is_holiday, l.holiday_name, l.holiday_type, l.holiday_source,
       n.news_kind, n.disruptors, n.headlines
FROM anoms a LEFT JOIN look l ON l.date = a.date LEFT JOIN news n ON n.date = a.date""")


@register("N7_anomaly_context", _n7_sql())
def n7(spark, sf):
    an = io.staged(detect_anomalies(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")), "anomalies")
    return cx.enrich_anomalies(an, io.staged(_feed(spark, sf), "context"), cf.holiday_table(an.select(F.col("date").cast("date").alias("date"))))


@register("F10_usable_disruptors", _ctx_sql("""
SELECT COUNT(*) AS rows FROM ctx WHERE news_disruptors IS NOT NULL AND news_disruptors NOT ILIKE 'no headlines%'"""))
def f10(spark, sf):
    c = _feed(spark, sf)
    return c.filter(F.col("news_disruptors").isNotNull() & ~F.col("news_disruptors").ilike("No headlines%")).agg(
        F.count(F.lit(1)).alias("rows"))


@register("N6_cause_rows", f"""
SELECT outlet_name, date, severity, concat_ws('; ', 'weather ' || condition, 'holiday ' || COALESCE(holiday_name, 'none'),
                                              'news ' || COALESCE(news_kind, 'none')) AS diagnosis
FROM ({ORACLES["N7_anomaly_context"]})""")
def n6_causes(spark, sf):
    return anomaly.cause_rows(n7(spark, sf))
