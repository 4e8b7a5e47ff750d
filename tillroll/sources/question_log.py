"""Question / answer / evidence logs derived from the sales data.

The reference audits one live question and one generated answer at a time.  The batch
re-aim needs tables of them; these are derived per invoice date so that their size
follows the data (one question, one answer and four tool results per date).  The
template is chosen by the epoch day number, so every template occurs across the range.

Each builder has a DuckDB twin (``*_SQL``) used by the oracles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str
from tillroll.operators import context as cx
from tillroll.sources import context_feed as cf
from tillroll.sources.tables import sales

# ── Fixed values: question and answer templates ───────────────────────────────
QUESTION_TEMPLATES = [
    "Why did revenue drop on {d}?",
    "Revenue dropped on {d}, what happened?",
    "Compare revenue on {d} vs {d7}",
    "What was the total revenue on {d}?",
    "Compare {z1} versus {z2} sales",
    "Which was the worst sales day in {m}?",
    "Show me the daily revenue trend for {m}",
    "What were the top 5 items in {m}?",
    "Show revenue by outlet for {d}",
    "What is the overall revenue total?",
    "hello",
    "Tell me a joke about coffee",
    "Why did sales dip on {dfar}?",
]
ANSWER_TEMPLATES = [
    "Revenue on {d} was ₹{x1}.",
    "Revenue on {d} fell to ₹{x16} because of heavy rain.",
    "Chain revenue on {d} was ₹{x03}, driven by a public holiday.",
    "Sales on {d} reached {x1} due to news headlines.",
    "Revenue on {d} was Rs. 120 only.",
]
FAR_DAYS = 9000


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with {name} slots → concat of literals and columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            parts.append(F.lit(head))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def _epoch(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): one question per sales date."""
    dates = cf.sales_dates(spark, sf_dir)
    zones = sales(spark, sf_dir, ["ZONE"]).select("ZONE").distinct().agg(F.array_sort(F.collect_list("ZONE")).alias("zs"))
    d = F.col("date")
    vals = {
        "d": day_str(d), "d7": day_str(F.date_add(d, 7)), "m": F.date_format(d, "yyyy-MM"),
        "z1": F.get("zs", F.lit(0)), "z2": F.get("zs", F.lit(1)), "dfar": day_str(F.date_add(d, FAR_DAYS)),
    }
    e = _epoch(d) % len(QUESTION_TEMPLATES)
    q = None
    for i, t in enumerate(QUESTION_TEMPLATES):
        q = F.when(e == i, _fill(t, vals)) if q is None else q.when(e == i, _fill(t, vals))
    return dates.join(zones, how="inner").select(day_str(d).alias("question_id"), q.alias("question"))


def _fmt(x: Column) -> Column:
    return F.format_number(F.round(x).cast("bigint"), 0)


def zone_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, result): per date, the per-zone revenue / orders markdown table."""
    s = sales(spark, sf_dir, ["ZONE", "INVOICE_DATE", "INVOICE_NO", "NET_AMT"])
    zd = s.groupBy("INVOICE_DATE", "ZONE").agg(
        F.round(F.sum("NET_AMT"), 2).cast("decimal(18,2)").alias("rev"), F.count_distinct("INVOICE_NO").alias("orders")
    )
    row = F.concat(F.lit("| "), F.col("ZONE"), F.lit(" | "), F.col("rev").cast("string"), F.lit(" | "), F.col("orders").cast("string"), F.lit(" |"))
    per_day = zd.groupBy("INVOICE_DATE").agg(F.array_sort(F.collect_list(F.struct("ZONE", row.alias("r")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["r"]), "\n")
    return per_day.select(
        day_str("INVOICE_DATE").alias("answer_id"),
        F.concat(F.lit("| outlet_name | revenue | orders |\n|---|---|---|\n"), body).alias("result"),
    )


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer): one generated answer per sales date."""
    s = sales(spark, sf_dir, ["INVOICE_DATE", "NET_AMT"])
    daily = s.groupBy("INVOICE_DATE").agg(F.sum("NET_AMT").alias("total"))
    d = F.col("INVOICE_DATE")
    dec = lambda v: F.lit(Decimal(v))  # noqa: E731  exact multipliers keep rounding engine-independent
    vals = {"d": day_str(d), "x1": _fmt(F.col("total")), "x16": _fmt(F.col("total") * dec("1.6")),
            "x03": _fmt(F.col("total") * dec("0.3"))}
    e = _epoch(d) % len(ANSWER_TEMPLATES)
    a = None
    for i, t in enumerate(ANSWER_TEMPLATES):
        a = F.when(e == i, _fill(t, vals)) if a is None else a.when(e == i, _fill(t, vals))
    return daily.select(day_str(d).alias("answer_id"), a.alias("answer"))


def evidence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, tool, result, success, fact_order): the tool results behind each answer."""
    tables = zone_tables(spark, sf_dir).select(
        "answer_id", F.lit("query_sales_db").alias("tool"), "result", F.lit(True).alias("success"), F.lit(0).alias("fact_order"))
    ctx = cf.context_feed(spark, sf_dir)
    usable = cx.usable_weather(ctx)
    weather = ctx.select(
        F.col("date").alias("answer_id"), F.lit("get_weather_context").alias("tool"),
        F.when(usable, F.concat(F.lit("Avg temp="), F.col("temp_max_c").cast("string"), F.lit("°C, Precipitation="),
                                F.col("precipitation_mm").cast("string"), F.lit("mm, Condition="), F.col("weather_condition")))
        .otherwise(F.lit("No row")).alias("result"),
        F.lit(True).alias("success"), F.lit(1).alias("fact_order"))
    holiday = ctx.select(
        F.col("date").alias("answer_id"), F.lit("get_holiday_status").alias("tool"),
        F.when(F.col("is_holiday") == 1, F.concat(F.col("holiday_type"), F.lit(" holiday: "), F.col("holiday_name")))
        .otherwise(F.lit("regular trading day")).alias("result"),
        F.lit(True).alias("success"), F.lit(2).alias("fact_order"))
    news = cx.news_selection(ctx).select(
        F.col("date").alias("answer_id"), F.lit("get_news_context").alias("tool"),
        F.coalesce("disruptors", F.lit("No row")).alias("result"),
        (F.col("news_kind") != "none").alias("success"), F.lit(3).alias("fact_order"))
    return tables.unionByName(weather).unionByName(holiday).unionByName(news)


def scenario_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, text, ref_date): a what-if prompt per context date."""
    ctx = cf.weather_feed(spark, sf_dir)
    zones = sales(spark, sf_dir, ["ZONE"]).select("ZONE").distinct().agg(F.array_sort(F.collect_list("ZONE")).alias("zs"))
    d = F.col("date").cast("date")
    e = _epoch(d)
    cond = F.lower(F.coalesce("weather_condition", F.lit("clear sky")))
    t = F.col("temp_max_c")
    feel = F.when(t >= 35, "hot").when(t >= 32, "warm").when(t <= 22, "cool").otherwise("mild")
    zone = F.element_at(F.col("zs"), (e % F.size("zs")).cast("int") + 1)
    text = F.concat(F.lit("What if there is "), cond, F.lit(" and it is "), feel, F.lit(" in "), zone,
                    F.lit(" on "), F.date_format(d, "EEEE"), F.lit("?"))
    return ctx.join(zones, how="inner").select(F.col("date").alias("scenario_id"), text.alias("text"), d.alias("ref_date"))


# ── DuckDB twins (CTE bodies) ─────────────────────────────────────────────────
def _sql_fill(template: str, values: dict[str, str]) -> str:
    out, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append("'" + head.replace("'", "''") + "'")
        out.append(values[name])
    if rest:
        out.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(out)


def question_sql() -> str:
    vals = {
        "d": "strftime(date, '%Y-%m-%d')", "d7": "strftime(date + INTERVAL 7 DAY, '%Y-%m-%d')", "m": "strftime(date, '%Y-%m')",
        "z1": "zs[1]", "z2": "zs[2]", "dfar": f"strftime(date + INTERVAL {FAR_DAYS} DAY, '%Y-%m-%d')",
    }
    cases = " ".join(f"WHEN {i} THEN {_sql_fill(t, vals)}" for i, t in enumerate(QUESTION_TEMPLATES))
    return f"""questions AS (SELECT strftime(date, '%Y-%m-%d') AS question_id,
      CASE date_diff('day', DATE '1970-01-01', date) % {len(QUESTION_TEMPLATES)} {cases} END AS question
    FROM (SELECT DISTINCT INVOICE_DATE AS date FROM sales) CROSS JOIN (SELECT list_sort(list(DISTINCT ZONE)) AS zs FROM sales))"""


def answer_sql() -> str:
    f = lambda x: f"format('{{:,}}', CAST(ROUND({x}) AS BIGINT))"
    vals = {"d": "strftime(d, '%Y-%m-%d')", "x1": f("total"), "x16": f("total * 1.6"), "x03": f("total * 0.3")}
    cases = " ".join(f"WHEN {i} THEN {_sql_fill(t, vals)}" for i, t in enumerate(ANSWER_TEMPLATES))
    return f"""answers AS (SELECT strftime(d, '%Y-%m-%d') AS answer_id,
      CASE date_diff('day', DATE '1970-01-01', d) % {len(ANSWER_TEMPLATES)} {cases} END AS answer
    FROM (SELECT INVOICE_DATE AS d, SUM(NET_AMT) AS total FROM sales GROUP BY INVOICE_DATE))"""
