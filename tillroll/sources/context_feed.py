"""Per-date context dimension (holiday / weather / news), derived from the driver tables.

The reference fills this table from live weather, news and holiday-library calls.  Those
are network / local-library inputs and are not rebuilt; here the same 14-column table is
derived deterministically from the data so that its size follows the data:

* dates  — every invoice date of the sales fact (or any date frame passed in);
* weather — integer rules on the epoch day number (reproducible in any SQL engine);
  every 29th epoch day is an API failure ('Unavailable'), every 31st has no weather;
* news   — every document belongs to one sales date (``doc_id`` modulo the number of
  dates); the lines of a date's documents (whole texts, split on newlines, trimmed, empty
  lines dropped, first occurrence kept, in document order) are its headlines, of which the
  first 10 are stored; every 23rd epoch day stores a truncated (invalid) JSON array;
* holidays — C3 over a fixed national / state calendar expanded over the years present.

``CONTEXT_SQL`` is the same derivation as DuckDB SQL for the oracles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.sources.io import staged
from tillroll.sources.tables import read_table, sales

# ── Fixed values ──────────────────────────────────────────────────────────────
# Fixed-date national and state holidays (month, day, name).  The state list repeats the
# national days, as a state calendar does; C3 resolves the overlap by priority.
NATIONAL_HOLIDAYS = [(1, 26, "Republic Day"), (8, 15, "Independence Day"), (10, 2, "Gandhi Jayanti")]
STATE_HOLIDAYS = [(1, 26, "Republic Day"), (6, 2, "Telangana Formation Day"), (8, 15, "Independence Day"), (10, 2, "Gandhi Jayanti")]
NO_HEADLINES = "No headlines — LLM analysis skipped."
DISRUPTOR_LEAD = "Operational disruptors identified:"
UPDATED_V1 = "2026-01-01T06:00:00"
UPDATED_V2 = "2026-01-02T06:00:00"
MIGRATED_COLUMNS = ["weather_api_error", "llm_engine", "gemini_model_used"]
CONTEXT_COLUMNS = [
    "date", "is_holiday", "holiday_name", "holiday_type", "temp_max_c", "precipitation_mm",
    "weather_condition", "weather_source", "weather_api_error", "news_headlines", "news_disruptors",
    "llm_engine", "gemini_model_used", "updated_at",
]


def sales_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir, ["INVOICE_DATE"]).select(F.col("INVOICE_DATE").alias("date")).distinct()


def holiday_table(dates: DataFrame) -> DataFrame:
    """National / state holidays for every year present in ``dates``: (date, name, type).

    Size is (#years × fixed list), so it is safe to broadcast.
    """
    entries = [(m, d, n, "National") for m, d, n in NATIONAL_HOLIDAYS] + [(m, d, n, "State") for m, d, n in STATE_HOLIDAYS]
    arr = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name"), F.lit(t).alias("type"))
                    for m, d, n, t in entries])
    years = dates.select(F.year("date").alias("y")).distinct()
    return years.select("y", F.explode(arr).alias("h")).select(
        F.make_date("y", F.col("h.m"), F.col("h.d")).alias("date"), F.col("h.name").alias("name"), F.col("h.type").alias("type")
    )


def _epoch_day(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def weather_columns(d: Column) -> list[Column]:
    """temp_max_c, precipitation_mm, weather_condition, weather_source, weather_api_error."""
    e = _epoch_day(d)
    api_err = (e % 29) == 0
    missing = ((e % 31) == 0) & ~api_err
    r = (e * 53 + 17) % 1000
    temp = F.lit(18.0) + ((e * 37) % 200) / F.lit(10.0)
    rain = F.when(r < 600, F.lit(0.0)).when(r < 850, (r % 50) / F.lit(10.0)).otherwise((r % 400) / F.lit(10.0))
    cond = F.when(rain == 0, "Sunny").when(rain < 5, "Light rain").when(rain < 15, "Moderate rain").otherwise("Heavy rain")
    bad = api_err | missing
    return [
        F.when(~bad, temp).alias("temp_max_c"),
        F.when(~bad, rain).alias("precipitation_mm"),
        F.when(api_err, F.lit("Unavailable")).when(~missing, cond).alias("weather_condition"),
        F.when(api_err, F.lit("error")).when(~missing, F.lit("rule")).alias("weather_source"),
        F.when(api_err, F.lit('{"code": 1008, "msg": "history not available"}')).alias("weather_api_error"),
    ]


HEADLINES = 10  # headlines stored per date


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != F.lit(""))


def headline_lines(text: Column, keep: int = HEADLINES) -> Column:
    """O6 — whole text → lines, trimmed, non-empty, first occurrence kept, first ``keep``."""
    return F.slice(F.array_distinct(text_lines(text)), 1, keep)


def date_index(dates: DataFrame) -> DataFrame:
    """(date, k, n): position of each date among all ``n`` dates (calendar-sized)."""
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("k"),
                        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def headlines_by_date(docs: DataFrame, calendar: DataFrame, keep: int = HEADLINES) -> DataFrame:
    """(date, h): the first ``keep`` distinct lines of all documents of each date, as a written table.

    A document can only give its own first ``keep`` distinct lines.  Rounds look at the ``keep`` documents
    of the smallest ids of every date, then at ten times as many, and so on; each task passes on
    that many documents of a date at most, and a date stays in the rounds only while it has too few
    lines and more documents.  So what is shuffled follows the dates, not the text."""
    n = calendar.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    own = docs.select(F.coalesce(F.pmod("doc_id", F.lit(n)), F.lit(0)).alias("k"), "doc_id",
                      headline_lines(F.col("text"), keep).alias("lines"))
    near = F.dense_rank().over(Window.partitionBy("k").orderBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("at"))
    waiting, limit, done = None, keep, []
    while True:
        some = own if waiting is None else own.join(waiting, "k", "left_semi")
        some = some.withColumn("near", near).filter(F.col("near") <= limit)
        lines = some.select("k", "doc_id", "near", F.posexplode_outer("lines").alias("pos", "line"))
        first = lines.groupBy("k", "line").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.max("near").alias("near"))
        top = first.withColumn("place", F.when(F.col("line").isNotNull(), place)).filter(
            F.col("line").isNull() | (F.col("place") <= keep + 1))  # a row without a line takes a place
        row = F.filter(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"].isNotNull())
        per_date = staged(top.groupBy("k").agg(F.slice(F.transform(row, lambda x: x["line"]), 1, keep).alias("h"),
                                               F.max("near").alias("near")), "headlines")
        full = (F.size("h") >= keep) | (F.col("near") < limit)
        done.append(per_date.filter(full))
        waiting, limit = per_date.filter(~full).select("k"), min(10 * limit, 1 << 30)
        if waiting.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return calendar.join(found, "k").select("date", "h")


def build_context(dates: DataFrame, docs: DataFrame, calendar: DataFrame, updated_at: str) -> DataFrame:
    """Context rows for ``dates`` (column ``date``); ``calendar`` is the ``date_index`` of the sales dates."""
    from tillroll.operators.context import resolve_holidays

    hol = resolve_holidays(dates, holiday_table(dates))
    withdoc = dates.select("date").join(headlines_by_date(docs, calendar), "date", "left").select(
        "date", F.coalesce("h", F.array().cast("array<string>")).alias("h"))
    e = _epoch_day(F.col("date"))
    js = F.to_json("h")
    has = F.size("h") > 0
    return withdoc.join(hol, "date", "left").select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"),
        "holiday_name", "holiday_type",
        *weather_columns(F.col("date")),
        F.when(has & ((e % 23) == 0), F.expr("left(to_json(h), length(to_json(h)) - 1)")).otherwise(js).alias("news_headlines"),
        F.when(has, F.concat(F.lit(DISRUPTOR_LEAD + "\n"), F.array_join(F.slice("h", 1, 3), "\n"))).otherwise(F.lit(NO_HEADLINES)).alias("news_disruptors"),
        F.when(has, F.lit("rules")).otherwise(F.lit("none")).alias("llm_engine"),
        F.when(has, F.lit("rules")).otherwise(F.lit("none")).alias("gemini_model_used"),
        F.lit(updated_at).alias("updated_at"),
    )


def context_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored context table (version 1), one row per sales date."""
    dates = sales_dates(spark, sf_dir)
    return build_context(dates, read_table(spark, sf_dir, "documents"), date_index(dates), UPDATED_V1)


def weather_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather columns of the context table alone (same values as ``context_feed``):
    consumers that only join weather by date skip the holiday and headline derivation."""
    d = F.col("date")
    return sales_dates(spark, sf_dir).select(F.date_format(d, "yyyy-MM-dd").alias("date"), *weather_columns(d))


def weather_refresh(feed: DataFrame) -> DataFrame:
    """A later fetch (version 2) for the dates whose weather API call had failed."""
    e = _epoch_day(F.col("date").cast("date"))
    temp = F.lit(24.0) + ((e * 11) % 60) / F.lit(10.0)
    return feed.filter(F.col("weather_condition") == "Unavailable").select(
        "date", "is_holiday", "holiday_name", "holiday_type",
        temp.alias("temp_max_c"), F.lit(0.0).alias("precipitation_mm"),
        F.lit("Partly cloudy").alias("weather_condition"), F.lit("refetch").alias("weather_source"),
        F.lit(None).cast("string").alias("weather_api_error"),
        "news_headlines", "news_disruptors", "llm_engine", "gemini_model_used",
        F.lit(UPDATED_V2).alias("updated_at"),
    )


# ── The same derivation in DuckDB SQL (oracle side) ───────────────────────────
def _holiday_values() -> str:
    rows = [f"({m}, {d}, '{n}', 'National', 1)" for m, d, n in NATIONAL_HOLIDAYS]
    rows += [f"({m}, {d}, '{n}', 'State', 2)" for m, d, n in STATE_HOLIDAYS]
    return "(VALUES " + ", ".join(rows) + ") hv(m, dd, name, type, prio)"


def context_sql(dates_cte: str = "ctx_dates", updated_at: str = UPDATED_V1, out: str = "ctx") -> str:
    """CTE text (no leading WITH) producing ``out`` from a CTE ``dates_cte(date DATE)``
    and the date index ``cal(date, k, n)`` of the sales dates; expects a ``commercial`` lookup and ``documents``."""
    return f"""
hol_{out} AS (SELECT make_date(y, hv.m, hv.dd) AS date, hv.name, hv.type, hv.prio
         FROM (SELECT DISTINCT year(date) AS y FROM {dates_cte}) yy CROSS JOIN {_holiday_values()}),
holr_{out} AS (SELECT date, arg_min(name, prio) AS hname, arg_min(type, prio) AS htype FROM hol_{out} GROUP BY date),
lines_{out} AS (SELECT ((doc_id % n) + n) % n AS k, doc_id, unnest(lf) AS line, generate_subscripts(lf, 1) AS pos
         FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lf FROM documents)
         CROSS JOIN (SELECT max(n) AS n FROM cal)),
firsts_{out} AS (SELECT * FROM lines_{out} QUALIFY row_number() OVER (PARTITION BY k, line ORDER BY doc_id, pos) = 1),
doc_{out} AS (SELECT c.date, t.h FROM cal c JOIN (SELECT k, list(line ORDER BY doc_id, pos) AS h
         FROM (SELECT * FROM firsts_{out} QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) <= {HEADLINES}) GROUP BY k) t ON t.k = c.k),
b_{out} AS (SELECT c.date, date_diff('day', DATE '1970-01-01', c.date) AS e, COALESCE(doc.h, CAST([] AS VARCHAR[])) AS h,
              hr.hname, hr.htype,
              CASE WHEN strftime(c.date, '%m-%d') IN (SELECT md FROM commercial) THEN (SELECT name FROM commercial WHERE md = strftime(c.date, '%m-%d'))
                   WHEN dayofweek(c.date) = 0 AND month(c.date) = 5 AND (day(c.date) - 1) // 7 + 1 = 2 THEN 'Mother''s Day'
                   WHEN dayofweek(c.date) = 0 AND month(c.date) = 6 AND (day(c.date) - 1) // 7 + 1 = 3 THEN 'Father''s Day'
                   WHEN dayofweek(c.date) = 0 AND month(c.date) = 8 AND (day(c.date) - 1) // 7 + 1 = 1 THEN 'Friendship Day' END AS cname
       FROM {dates_cte} c LEFT JOIN doc_{out} doc ON doc.date = c.date
       LEFT JOIN holr_{out} hr ON hr.date = c.date),
w_{out} AS (SELECT *, (e % 29 = 0) AS api_err, (e % 31 = 0 AND NOT (e % 29 = 0)) AS missing,
              18.0 + ((e * 37) % 200) / 10.0 AS temp, (e * 53 + 17) % 1000 AS r FROM b_{out}),
w2_{out} AS (SELECT *, CASE WHEN r < 600 THEN 0.0 WHEN r < 850 THEN (r % 50) / 10.0 ELSE (r % 400) / 10.0 END AS rain FROM w_{out}),
{out} AS (SELECT strftime(date, '%Y-%m-%d') AS date,
              CASE WHEN hname IS NOT NULL OR cname IS NOT NULL THEN 1 ELSE 0 END AS is_holiday,
              COALESCE(hname, cname) AS holiday_name,
              CASE WHEN hname IS NOT NULL THEN htype WHEN cname IS NOT NULL THEN 'Commercial/Cultural' END AS holiday_type,
              CASE WHEN NOT (api_err OR missing) THEN temp END AS temp_max_c,
              CASE WHEN NOT (api_err OR missing) THEN rain END AS precipitation_mm,
              CASE WHEN api_err THEN 'Unavailable' WHEN NOT missing THEN
                   CASE WHEN rain = 0 THEN 'Sunny' WHEN rain < 5 THEN 'Light rain' WHEN rain < 15 THEN 'Moderate rain' ELSE 'Heavy rain' END END AS weather_condition,
              CASE WHEN api_err THEN 'error' WHEN NOT missing THEN 'rule' END AS weather_source,
              CASE WHEN api_err THEN '{{"code": 1008, "msg": "history not available"}}' END AS weather_api_error,
              CASE WHEN len(h) > 0 AND e % 23 = 0 THEN left(to_json(h)::VARCHAR, length(to_json(h)::VARCHAR) - 1) ELSE to_json(h)::VARCHAR END AS news_headlines,
              CASE WHEN len(h) > 0 THEN '{DISRUPTOR_LEAD}' || chr(10) || array_to_string(list_slice(h, 1, 3), chr(10)) ELSE '{NO_HEADLINES}' END AS news_disruptors,
              CASE WHEN len(h) > 0 THEN 'rules' ELSE 'none' END AS llm_engine,
              CASE WHEN len(h) > 0 THEN 'rules' ELSE 'none' END AS gemini_model_used,
              '{updated_at}' AS updated_at
       FROM w2_{out})"""
