"""Context / calendar operators: C1–C9, J1, J6/N7, J7, S9, S10, O5, O6.

The context table is small per date but grows with the date range; joins against it are
on ``date`` and keep the planner's choice (it is broadcast while small).  The holiday
calendar is (#years × fixed list) rows and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str
from tillroll.sources.io import staged

# ── Fixed values: commercial / cultural events ────────────────────────────────
# Fixed-date events, "MM-DD" -> name.
COMMERCIAL_EVENTS = {
    "01-01": "New Year's Day",
    "02-14": "Valentine's Day",
    "03-08": "International Women's Day",
    "05-01": "May Day / Labour Day",
    "06-21": "International Yoga Day",
    "08-15": "Independence Day (also commercial peak)",
    "10-31": "Halloween",
    "11-14": "Children's Day",
    "12-24": "Christmas Eve",
    "12-25": "Christmas Day",
    "12-31": "New Year's Eve",
}
# Date-variable events: (month, nth Sunday, name).
NTH_SUNDAY_EVENTS = [(5, 2, "Mother's Day"), (6, 3, "Father's Day"), (8, 1, "Friendship Day")]
DEFAULT_TEMP_C = 27.0
DEFAULT_RAIN_MM = 0.5


def commercial_sql() -> str:
    """``commercial(md, name)`` as a DuckDB CTE body."""
    vals = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in COMMERCIAL_EVENTS.items())
    return f"commercial AS (SELECT * FROM (VALUES {vals}) t(md, name))"


def fixed_event(d: Column) -> Column:
    """C1 — fixed-date commercial event name (map lookup, no join)."""
    m = F.create_map(*[x for k, v in COMMERCIAL_EVENTS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.date_format(d, "MM-dd"))


def nth_sunday_event(d: Column) -> Column:
    """C2 — nth-Sunday events (2nd Sunday of May, 3rd of June, 1st of August)."""
    week = F.floor((F.dayofmonth(d) - 1) / 7) + 1
    sunday = F.dayofweek(d) == 1
    out = None
    for month, n, name in NTH_SUNDAY_EVENTS:
        cond = sunday & (F.month(d) == month) & (week == n)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def resolve_holidays(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """C3 — National > State > Commercial/Cultural > none, per date.

    ``holidays`` is (date, name, type) with type National / State.
    """
    prio = F.when(F.col("type") == "National", 1).otherwise(2)
    h = holidays.groupBy("date").agg(
        F.min_by("name", prio).alias("hname"), F.min_by("type", prio).alias("htype")
    )
    j = dates.select("date").join(F.broadcast(h), "date", "left")
    comm = F.coalesce(fixed_event(F.col("date")), nth_sunday_event(F.col("date")))
    return j.select(
        "date",
        F.when(F.col("hname").isNotNull() | comm.isNotNull(), 1).otherwise(0).alias("is_holiday"),
        F.coalesce("hname", comm).alias("holiday_name"),
        F.when(F.col("hname").isNotNull(), F.col("htype")).when(comm.isNotNull(), F.lit("Commercial/Cultural")).alias("holiday_type"),
    )


def iso_week_spine(anchor: DataFrame, col: str = "anchor") -> DataFrame:
    """C6 — Monday..Sunday of the ISO week containing each anchor date."""
    monday = F.date_trunc("week", F.col(col)).cast("date")
    return anchor.select(F.explode(F.sequence(monday, F.date_add(monday, 6))).alias("date")).distinct()


def week_revenue(spine: DataFrame, daily: DataFrame) -> DataFrame:
    """J7 — date spine left-joined to daily revenue (null when no sales)."""
    return spine.join(daily, "date", "left")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "date", order: str = "updated_at",
           tie: str = "weather_source") -> DataFrame:
    """S9 — an incoming row replaces the stored one of its key, whatever its stamp; S10 — additive schema.

    Both inputs are unioned by name (missing columns become null).  Within one side the newest
    row per key survives; equal stamps fall by ``tie`` and then by the whole row's hash.  The caller writes the result to a *new* path (never the one being read).
    """
    u = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    ties = [F.col(tie)] if tie in u.columns else []
    w = Window.partitionBy(key).orderBy(F.col("_in").desc(), F.col(order).desc(), *ties, F.xxhash64(*u.columns))
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_in")


def write_months(ctx: DataFrame, path: str) -> None:
    """The context table in month directories (``month``, from ``date``)."""
    ctx.withColumn("month", F.substring("date", 1, 7)).write.mode("overwrite").partitionBy("month").parquet(path)


def upsert_months(incoming: DataFrame, path: str) -> None:
    """S9 on a stored table — upsert that rewrites only the months with incoming dates: they are merged
    aside first, then replace their directories; files of other months stay as they are."""
    spark = incoming.sparkSession
    incoming = incoming.withColumn("month", F.substring("date", 1, 7))
    stored = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    touched = stored.join(F.broadcast(incoming.select("month").distinct()), "month", "left_semi")  # calendar months
    merged = staged(upsert(touched, incoming), "context-months")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def headlines_array(ctx: DataFrame) -> Column:
    """JSON text → array<string>; malformed JSON → empty array."""
    return F.coalesce(F.from_json("news_headlines", "array<string>"), F.array().cast("array<string>"))


def usable_weather(ctx: DataFrame) -> Column:
    c = F.col("weather_condition")
    return c.isNotNull() & (c != "") & ~c.contains("Unavailable")


def context_lookup(dates: DataFrame, ctx: DataFrame, holidays: DataFrame) -> DataFrame:
    """C4 — stored context first, fallback second, for every date in ``dates``.

    Weather is taken from the stored row when its condition is non-empty and not
    'Unavailable', else the fallback defaults; the holiday comes from the stored row
    when one exists, else from the full calendar (C3 over ``holidays``: date, name, type).
    """
    c = ctx.select(
        F.col("date").cast("date").alias("date"), "is_holiday", "holiday_name", "holiday_type",
        "temp_max_c", "precipitation_mm", "weather_condition", F.lit(True).alias("_stored"),
    )
    rule = resolve_holidays(dates, holidays).select("date", F.col("holiday_name").alias("_name"), F.col("holiday_type").alias("_type"))
    j = dates.select("date").join(c, "date", "left").join(rule, "date", "left")
    ok = usable_weather(j) & F.col("_stored")
    stored = F.col("_stored").isNotNull()
    return j.select(
        day_str("date").alias("date"),
        F.when(ok, F.col("temp_max_c")).otherwise(F.lit(DEFAULT_TEMP_C)).alias("temp_c"),
        F.when(ok, F.col("precipitation_mm")).otherwise(F.lit(DEFAULT_RAIN_MM)).alias("rain_mm"),
        F.when(ok, F.col("weather_condition")).otherwise(F.lit("Unknown")).alias("condition"),
        F.when(ok, F.lit("context")).otherwise(F.lit("fallback")).alias("weather_source"),
        F.when(stored, F.col("is_holiday") == 1).otherwise(F.col("_name").isNotNull()).alias("is_holiday"),
        F.when(stored, F.when(F.col("is_holiday") == 1, F.coalesce("holiday_name", F.lit("Holiday"))))
        .otherwise(F.col("_name")).alias("holiday_name"),
        F.when(stored, F.when(F.col("is_holiday") == 1, F.coalesce("holiday_type", F.lit("Public"))))
        .otherwise(F.col("_type")).alias("holiday_type"),
        F.when(stored, F.lit("context")).otherwise(F.lit("fallback")).alias("holiday_source"),
    )


def _numbered(arr: Column, n: int, width: int = 100) -> Column:
    return F.array_join(
        F.transform(F.slice(arr, 1, n), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.left(x, F.lit(width)))),
        "\n",
    )


def news_selection(ctx: DataFrame) -> DataFrame:
    """C5 — disruptor text unless it is the no-headlines / skipped marker (then up to 8
    headlines, 100 chars each); with disruptors, up to 6 source headlines follow."""
    d = F.trim(F.coalesce("news_disruptors", F.lit("")))
    h = headlines_array(ctx)
    use_d = (d != "") & ~d.contains("No headlines") & ~F.lower(d).contains("skipped")
    return ctx.select(
        "date",
        F.when(use_d, F.lit("disruptors")).when(F.size(h) > 0, F.lit("headlines")).otherwise(F.lit("none")).alias("news_kind"),
        F.when(use_d, d).alias("disruptors"),
        F.when(use_d, _numbered(h, 6)).when(F.size(h) > 0, _numbered(h, 8)).alias("headlines"),
    )


def latest_rows(ctx: DataFrame, n: int = 10) -> DataFrame:
    """C8a — the latest n context rows."""
    return ctx.select("date", "holiday_name", "temp_max_c", "precipitation_mm", "weather_condition", "llm_engine").orderBy(
        F.col("date").desc()).limit(n)


def headline_counts(ctx: DataFrame) -> DataFrame:
    """C8b — number of stored headlines per date (malformed JSON counts 0)."""
    return ctx.select("date", F.size(headlines_array(ctx)).alias("n_headlines"))


def engine_tally(ctx: DataFrame) -> DataFrame:
    """C8c — rows per LLM engine label."""
    return ctx.groupBy("llm_engine").agg(F.count(F.lit(1)).alias("rows"))


def holiday_spotlight(ctx: DataFrame) -> DataFrame:
    """C8d — holiday rows."""
    return ctx.filter(F.col("is_holiday") == 1).select("date", "holiday_name", "holiday_type")


def market_risk(ctx: DataFrame) -> DataFrame:
    """C9 / O5 / F10 — latest row whose disruptors are present and not the no-headlines
    marker; lead-in up to 'identified:' / 'are:' stripped, newlines joined with ' | ',
    a 140-char snippet (with an ellipsis when the full text is longer)."""
    q = ctx.filter(F.col("news_disruptors").isNotNull() & ~F.col("news_disruptors").ilike("No headlines%"))
    top = q.orderBy(F.col("date").desc()).limit(1)
    text = F.trim(F.regexp_replace("news_disruptors", r"(?is)^.*?(?:identified|are):\s*", ""))
    snippet = F.left(F.regexp_replace(text, "\n", " | "), F.lit(140))
    hol = F.when(F.col("holiday_name").isNotNull(), F.concat(F.lit(" · "), F.col("holiday_name"))).otherwise(F.lit(""))
    wth = F.when(F.col("weather_condition").isNotNull() & ~F.col("weather_condition").contains("Unavailable"),
                 F.concat(F.lit(" · "), F.col("weather_condition"))).otherwise(F.lit(""))
    more = F.when(F.length("news_disruptors") > 140, F.lit("…")).otherwise(F.lit(""))
    return top.select(
        "date", F.col("holiday_name").alias("holiday"), F.col("weather_condition").alias("weather"),
        snippet.alias("snippet"),
        F.concat(F.col("date"), hol, wth, F.lit(" — "), snippet, more).alias("label"),
    )


def weather_join(zone_days: DataFrame, ctx: DataFrame) -> DataFrame:
    """J1 — zone-day revenue left-joined to weather on date, defaults 27.0 °C / 0.5 mm.

    Only context rows with a temperature take part (as in the source's weather read).
    """
    wx = ctx.filter(F.col("temp_max_c").isNotNull()).select(
        F.col("date").cast("date").alias("INVOICE_DATE"), "temp_max_c", "precipitation_mm"
    )
    return zone_days.join(wx, "INVOICE_DATE", "left").select(
        "*",
    ).withColumn("temp_max_c", F.coalesce("temp_max_c", F.lit(DEFAULT_TEMP_C))).withColumn(
        "precipitation_mm", F.coalesce("precipitation_mm", F.lit(DEFAULT_RAIN_MM)))


def enrich_anomalies(anomalies: DataFrame, ctx: DataFrame, holidays: DataFrame) -> DataFrame:
    """J6 / N7 — each anomaly with weather / holiday / news context of its date (C4 + C5)."""
    dates = anomalies.select(F.col("date").cast("date").alias("date")).distinct()
    look = context_lookup(dates, ctx, holidays)
    news = news_selection(ctx).select("date", "news_kind", "disruptors", "headlines")
    return anomalies.join(look, "date", "left").join(news, "date", "left")
