"""Answer audit as batch jobs over tables of questions / answers / evidence:
T1–T10, W1, J8, J9.

The reference checks one string at a time; here every check is an expression over a
column (regex, arrays, higher-order functions) plus equi-joins to small per-date
aggregates, so a question log of any size is one distributed job.

The markdown-table digest (T4) is a sequential scan over each text's lines (a table
starts at a header followed by a separator row and runs until a blank, non-table or
ragged line, and that line is examined again).  It is written as Spark's ``aggregate``
higher-order function — a fold with a struct state, evaluated in the JVM per row — so
there is no Python in the path and no cross-row shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import day_str, plain_number, short_hash, strip
from tillroll.operators.ranks import higher_since

# ── Fixed values: patterns that must equal the reference's behaviour ──────────
ISO_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
DECLINE = (
    r"\b(drop|declin|worst|fell|fallen|underperform|slow\s+day|low\s+sales|"
    r"plummet|tank|slump|downturn|dip\b|down\s+vs|below\s+avg|below\s+average)\b"
)
COMPARE = r"\b(compare|vs\.?|versus)\b"
WORST_DAY = r"\b(worst|lowest|weakest)\b.{0,40}\b(day|daily)\b|\b(lowest|worst)\s+sales\s+day\b"
BEST_DAY = r"\b(best|highest|strongest)\b.{0,40}\b(day|daily)\b|\b(best|highest)\s+sales\s+day\b"
DAILY_TREND = r"\b(daily|day[- ]by[- ]day|each\s+day|trend)\b.{0,30}\b(revenue|sales)\b|\b(revenue|sales)\b.{0,30}\b(daily|trend)\b"
REV_WORD = r"\b(revenue|sales)\b"
HOW_MUCH = r"\b(how much|what was|how much was|total|combined|entire chain|all outlets)\b"
TOP_ITEMS = r"\b(top\s+\d+|top\s+items?|best\s+sell(?:ing|ers)?)\b"
PER_OUTLET = r"\b(per|by|each)\s+outlet\b"
BY_OUTLET = r"\b(by|per|each)\s+outlet\b|\boutlet\b.{0,48}\b(revenue|sales|performance)\b|\b(revenue|sales)\b.{0,48}\boutlet\b"
NOT_PRODUCT = r"\b(product|item|selling|top|highest)\b"
TOTAL = r"\b(total|overall|chain|aggregate)\b.{0,40}\b(revenue|sales|net)\b|\b(revenue|sales)\b.{0,40}\b(total|overall|chain)\b"
NOT_TOTAL = r"\b(product|item|selling|top|highest|by outlet|per outlet)\b"
MONEY = r"(?i)(?:₹\s*|INR\s*|Rs\.?\s*)([\d,]+(?:\.\d+)?)|\b([\d,]{5,}(?:\.\d+)?)\b"
CAUSAL = r"(?i)\b(because|due to|caused by|led to|resulted in|driven by|attributed to)\b"
WEATHERISH = r"(?i)\b(weather|rain|precip|storm|temperature)\b"
HOLIDAYISH = r"(?i)\b(holiday|festival|public holiday)\b"
NEWSISH = r"(?i)\b(news|headline|market intelligence)\b"
PREMISE_CONFLICT_MAX_RANK = 3
DEFAULT_YEAR = 2026
# Scenario keywords: rain (mm) tried longest first; temperature (°C) in this order.
RAIN_KEYWORDS = {
    "torrential": 30, "downpour": 30, "cyclone": 40, "heavy rain": 20, "thunderstorm": 15, "storm": 15,
    "moderate rain": 10, "rain": 8, "drizzle": 5, "light rain": 5, "showers": 8, "sunny": 0, "clear": 0,
}
TEMP_KEYWORDS = {"heatwave": 42, "scorching": 40, "hot": 35, "warm": 32, "cool": 22, "cold": 18, "freezing": 12}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _rx(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def iso_dates(text: Column) -> Column:
    """T9 — sorted distinct ISO dates (20xx only, as the source pattern)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ISO_DATE), 1)))


# ── W1 / T1 / J8 ───────────────────────────────────────────────────────────────
def daily_ranks(sales: DataFrame, window: str = "all") -> DataFrame:
    """W1 — rank of every day by revenue (desc) and the day count of its window.

    ``all``: one ranking over all days; ``month``: ranking within each calendar month;
    ``last90``: each day ranked among the days from 90 days before it onward (lower bound
    only, as in the source), counted block by block (``ranks.higher_since``).
    Runs over *daily* rows only (one per day, calendar-bounded), never over lines.
    """
    daily = sales.filter(F.col("ZONE").isNotNull()).groupBy("INVOICE_DATE").agg(F.round(F.sum("NET_AMT"), 2).alias("rev"))
    if window == "last90":
        ranked = higher_since(daily.withColumnRenamed("INVOICE_DATE", "d"), 90)
        return ranked.select(day_str("d").alias("d"), F.col("rev").cast("double").alias("rev"),
                             (F.col("higher") + 1).alias("rank_desc"), F.col("total").alias("total_days"))
    part = [] if window == "all" else [F.date_format("INVOICE_DATE", "yyyy-MM")]
    w = Window.partitionBy(*part).orderBy(F.col("rev").desc())
    return daily.select(
        day_str("INVOICE_DATE").alias("d"), F.col("rev").cast("double").alias("rev"),
        F.rank().over(w).alias("rank_desc"), F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("total_days"),
    )


def premise_audit(questions: DataFrame, ranks: DataFrame, window: str = "all") -> DataFrame:
    """T1 + J8 — questions with decline wording and exactly one distinct ISO date, joined to
    the ranked days; conflict iff rank ≤ 3, peak iff rank 1; an unranked date gives nulls."""
    q = questions.select("question_id", iso_dates(F.col("question")).alias("dates"),
                         _rx(F.lower("question"), DECLINE).alias("decline"))
    q = q.filter(F.col("decline") & (F.size("dates") == 1)).select(
        "question_id", F.col("dates")[0].alias("queried_date")
    ).filter(F.to_date("queried_date").isNotNull())
    j = q.join(ranks, q["queried_date"] == ranks["d"], "left")
    rank = F.col("rank_desc")
    return j.select(
        "question_id", "queried_date", F.col("rev").alias("day_revenue"), rank.alias("rank"), "total_days",
        F.coalesce(rank == 1, F.lit(False)).alias("is_peak"),
        F.coalesce(rank <= PREMISE_CONFLICT_MAX_RANK, F.lit(False)).alias("premise_conflict"),
        F.lit(window).alias("rank_window"),
    )


def intent_evidence(tags: DataFrame, premises: DataFrame) -> DataFrame:
    """Evidence row of every question that an intent answers: window, statement with its hash, and for
    a decline on a date the premise (``premise_audit``) with its flag."""
    statement = F.concat_ws(" ", "intent", F.lit("from"), "date_start", F.lit("to"), "date_end", F.lit("zones"),
                            F.coalesce("zones_named", F.lit("")))
    asked = tags.where(F.col("intent").isNotNull()).select(
        "question_id", "intent", "date_start", "date_end", short_hash(statement).alias("statement_hash"))
    found = premises.select("question_id", F.lit("decline_on_date").alias("intent"), "day_revenue", "rank", "premise_conflict")
    flagged = F.coalesce("premise_conflict", F.lit(False))
    return asked.join(found, ["question_id", "intent"], "left").select(
        "question_id", "intent", "date_start", "date_end", "statement_hash", F.lit("template_sql").alias("premise"),
        "day_revenue", "rank", F.when(flagged, F.lit("premise_conflict")).alias("guardrail_flags"))


# ── T6 / T7 / T8 / T9 ──────────────────────────────────────────────────────────
def tag_questions(questions: DataFrame, bounds: DataFrame) -> DataFrame:
    """T6–T9 — intent (first match in code order), interpreted window, named zones,
    dates found and year assumption, per question.

    ``bounds`` is the one-row A20 frame (zones array, min_date, max_date); it is attached
    as a scalar (one row), and named zones are found with a higher-order filter over that
    bounded zone array — no join against the question log.
    """
    q = questions.join(bounds, how="inner")
    low = F.lower(F.trim("question"))
    dates = iso_dates(F.col("question"))
    n = F.size(dates)
    ds = F.when(n >= 2, F.least(dates[0], F.element_at(dates, -1))).when(n == 1, dates[0]).otherwise(F.col("min_date"))
    de = F.when(n >= 2, F.greatest(dates[0], F.element_at(dates, -1))).when(n == 1, dates[0]).otherwise(F.col("max_date"))
    named = F.filter("zones", lambda z: F.instr(low, F.lower(z)) > 0)
    two = F.size(named) >= 2
    rx = lambda p: low.rlike(p)
    intent = (
        F.when(F.length(F.trim("question")) < 8, F.lit(None))
        .when((ds > F.col("max_date")) | (de > F.col("max_date")), F.lit(None))
        .when((n >= 2) & rx(COMPARE), F.lit("compare_two_dates"))
        .when((n == 1) & rx(DECLINE), F.lit("decline_on_date"))
        .when(two & rx(COMPARE), F.lit("outlet_comparison"))
        .when(rx(WORST_DAY), F.lit("best_worst_day"))
        .when(rx(BEST_DAY), F.lit("best_worst_day"))
        .when(rx(DAILY_TREND), F.lit("daily_trend"))
        .when((n == 1) & rx(REV_WORD) & rx(HOW_MUCH), F.lit("single_day_chain_revenue"))
        .when(rx(TOP_ITEMS) & ~rx(PER_OUTLET), F.lit("top_items"))
        .when(rx(BY_OUTLET) & ~rx(NOT_PRODUCT), F.lit("revenue_by_outlet"))
        .when(rx(TOTAL) & ~rx(NOT_TOTAL), F.lit("total_revenue"))
    )
    worst = rx(WORST_DAY)
    return q.select(
        "question_id", "question",
        intent.alias("intent"),
        F.when(intent == "best_worst_day", F.when(worst, F.lit("worst")).otherwise(F.lit("best"))).alias("day_kind"),
        ds.alias("date_start"), de.alias("date_end"),
        F.array_join(F.slice(named, 1, 2), ",").alias("zones_named"),
        F.array_join(dates, ",").alias("dates_found"),
        F.when(n > 0, F.substring(dates[0], 1, 4).cast("int")).otherwise(F.lit(DEFAULT_YEAR)).alias("year_assumption"),
        F.when(n > 0, F.lit("regex_iso_in_question")).otherwise(F.lit("default_dataset_year")).alias("year_source"),
    )


# ── T2 / T3 / T4 / J9 ──────────────────────────────────────────────────────────
def money_numbers(text: Column) -> Column:
    """T2 — money-like numbers in text (₹/INR/Rs prefix, or ≥ 5 digit-or-comma chars)."""
    g1 = F.regexp_extract_all(text, F.lit(MONEY), 1)
    g2 = F.regexp_extract_all(text, F.lit(MONEY), 2)
    raw = F.arrays_zip(g1.alias("a"), g2.alias("b"))
    nums = F.transform(raw, lambda r: F.replace(F.when(r["a"] != "", r["a"]).otherwise(r["b"]), F.lit(","), F.lit("")))
    return F.filter(F.transform(nums, lambda s: F.when(s != "", s.try_cast("double"))), lambda x: x.isNotNull())


# Fold state (scalars only): in-table flag, separator line to skip, column count, current
# table's header line and row count, and the best (largest, first on ties) finished table.
_STATE_T = "STRUCT<intab: BOOLEAN, skip: INT, ncols: INT, start: INT, nrows: INT, bstart: INT, brows: INT>"


def table_digest(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """T4 — per text: the largest pipe table (first on ties), its row count, and per-column
    sums for columns whose every cell is numeric (commas allowed), rounded to 6 dp.
    Error texts ('ERROR:' / 'SQL ERROR' lead) and 'Query returned 0 rows' texts → null.

    Output columns: ``row_count`` and ``column_sums`` (array of (col, sum) in column order).

    A fold over the text's lines finds the table boundaries with scalar state only; the
    chosen table's cells are then parsed and summed once (in row order), so the per-line
    work is a handful of integer comparisons.
    """
    head = F.upper(F.substring(_strip(F.col(text_col)), 1, 200))
    bad = (
        F.col(text_col).isNull() | (_strip(F.col(text_col)) == "")
        | head.startswith("ERROR:") | head.startswith("SQL ERROR")
        | F.upper(F.col(text_col)).contains("QUERY RETURNED 0 ROWS")
    )
    lines = F.split(F.col(text_col), "\n", -1)
    # Higher-order functions are evaluated without common-subexpression elimination, so
    # each intermediate array is materialised once through a one-row generator.
    staged = texts.select("*", F.inline(F.array(F.struct(
        F.when(~bad, F.transform(lines, lambda l: _cells(l))).otherwise(F.array().cast("array<array<string>>")).alias("_c"),
        F.when(~bad, F.transform(lines, lambda l: _strip(l) == "")).otherwise(F.array().cast("array<boolean>")).alias("_b"),
    ))))
    c = F.col("_c")
    sep = F.transform(c, lambda x: x.isNotNull() & F.forall(x, lambda y: y.rlike("^:?-{3,}:?$")))
    per_line = F.arrays_zip(
        F.sequence(F.lit(1), F.size(c)).alias("i"),
        F.transform(c, lambda x: F.coalesce(F.size(x), F.lit(-1))).alias("nc"),
        F.col("_b").alias("b"),
        F.concat(F.slice(sep, 2, F.greatest(F.size(sep) - 1, F.lit(0))), F.array(F.lit(False))).alias("sn"),
    )
    found = F.aggregate(
        per_line,
        F.expr(f"CAST(named_struct('intab', false, 'skip', 0, 'ncols', 0, 'start', 0, 'nrows', 0, 'bstart', 0, 'brows', 0) AS {_STATE_T})"),
        _step,
        _finish,
    )
    located = staged.select("*", F.inline(F.array(F.struct(found.alias("_t")))))
    start, nrows = F.col("_t.start"), F.col("_t.rows")
    tbl = located.select(
        *texts.columns, nrows.alias("_n"),
        F.try_element_at(c, F.greatest(start, F.lit(1))).alias("_h"),
        F.transform(F.slice(c, start + 2, F.greatest(nrows, F.lit(0))), lambda r: F.transform(r, lambda x: _num(x))).alias("_v"),
    ).select("*", F.inline(F.array(F.struct(F.col("_h").alias("hdr"), F.col("_v").alias("nums")))))
    hdr, nums = F.col("hdr"), F.col("nums")
    col_sums = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(hdr) - 1), lambda j: F.struct(
            F.when(_strip(hdr[j]) == "", F.concat(F.lit("col_"), j.cast("string"))).otherwise(_strip(hdr[j])).alias("col"),
            F.forall(nums, lambda r: r[j].isNotNull()).alias("num"),
            F.round(F.aggregate(nums, F.lit(0.0), lambda acc, r: acc + F.coalesce(r[j], F.lit(0.0))), 6).alias("sum"),
        )),
        lambda x: x["num"],
    )
    ok = F.col("_n") > 0
    return tbl.select(
        *texts.columns,
        F.when(ok, F.col("_n")).alias("row_count"),
        F.when(ok, F.transform(col_sums, lambda x: F.struct(x["col"].alias("col"), x["sum"].alias("sum")))).alias("column_sums"),
    )


def _strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return strip(c)


def _cells(line: Column) -> Column:
    """Cells of a pipe-table row: the stripped line without one leading and one trailing
    ``|``, split on ``|``, each cell stripped; null unless the line has a ``|`` and ≥ 2 cells
    (same as dropping an empty first / last part after splitting)."""
    s = _strip(line)
    cells = F.transform(F.split(F.regexp_replace(s, r"^[|]|[|]$", ""), "[|]", -1), lambda x: _strip(x))
    return F.when(s.contains("|") & (F.size(cells) >= 2), cells)


def _num(c: Column) -> Column:
    t = F.replace(_strip(c), F.lit(","), F.lit(""))
    return plain_number(t)


def _named(**kv: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in kv.items()])


def _step(st: Column, x: Column) -> Column:
    """One line of the table scan: open / extend / close a table (scalar state)."""
    i, nc = x["i"], x["nc"]
    intab = st["intab"]
    skip_now = intab & (i == st["skip"])
    is_row = ~x["b"] & (nc == st["ncols"])
    add_now = intab & ~skip_now & is_row
    close_now = intab & ~skip_now & ~is_row
    open_now = (close_now | ~intab) & (nc >= 2) & x["sn"]
    keep_best = close_now & (st["nrows"] > 0) & (st["nrows"] > st["brows"])
    return _named(
        intab=skip_now | add_now | open_now,
        skip=F.when(open_now, i + 1).otherwise(st["skip"]),
        ncols=F.when(open_now, nc).otherwise(st["ncols"]),
        start=F.when(open_now, i).otherwise(st["start"]),
        nrows=F.when(open_now, F.lit(0)).when(add_now, st["nrows"] + 1).otherwise(st["nrows"]),
        bstart=F.when(keep_best, st["start"]).otherwise(st["bstart"]),
        brows=F.when(keep_best, st["nrows"]).otherwise(st["brows"]),
    )


def _finish(r: Column) -> Column:
    better = r["intab"] & (r["nrows"] > 0) & (r["nrows"] > r["brows"])
    return _named(
        start=F.when(better, r["start"]).otherwise(r["bstart"]),
        rows=F.when(better, r["nrows"]).otherwise(r["brows"]),
    )


def primary_total(digests: DataFrame, key: str = "answer_id") -> DataFrame:
    """T3 — per answer: the first digested column named like revenue / total / netamt,
    else the column with the largest sum (first on ties) of the first digest with sums.
    Digests are taken in ``fact_order`` order when several tool outputs belong to one answer."""
    cols = digests.filter(F.col("column_sums").isNotNull()).select(
        key, "fact_order", F.posexplode("column_sums").alias("pos", "c")
    ).select(key, "fact_order", "pos", F.col("c.col").alias("col"), F.col("c.sum").alias("sum"))
    named = F.lower("col").rlike("revenue|total|netamt")
    order_named = F.struct("fact_order", "pos")
    order_max = F.struct("fact_order", (-F.col("sum")).alias("neg"), "pos")
    return cols.groupBy(key).agg(
        F.min_by(F.struct("sum", "col"), F.when(named, order_named)).alias("n"),
        F.min_by(F.struct("sum", "col"), order_max).alias("m"),
        F.count_if(named).alias("n_named"),
    ).select(
        key,
        F.when(F.col("n_named") > 0, F.col("n.sum")).otherwise(F.col("m.sum")).alias("verified_total"),
        F.when(F.col("n_named") > 0, F.col("n.col")).otherwise(F.col("m.col")).alias("verified_column"),
    )


def numeric_audit(answers: DataFrame, verified: DataFrame, key: str = "answer_id", enabled: bool = True) -> DataFrame:
    """T2 + J9 — claimed figures vs the verified total of the same answer.

    Cut-off 10 000 (or max(500, 5 %) when the total is under 10 000); the largest claim
    above 1.02 × total → ``numeric_mismatch``; total ≥ 5 000 and largest claim under
    0.48 × total → ``numeric_mismatch_low``; no total, total ≤ 0 or no claim → no flag.
    """
    j = answers.join(verified, key, "left")
    v = F.col("verified_total")
    cut = F.when(v >= 10000, F.lit(10000.0)).otherwise(F.greatest(F.lit(500.0), v * 0.05))
    nums = F.filter(money_numbers(F.col("answer")), lambda x: x >= cut)
    mx = F.array_max(nums)
    flag = (
        F.when(~F.lit(enabled) | v.isNull() | (v <= 0) | (F.size(nums) == 0), F.lit(None))
        .when(mx > v * 1.02, F.lit("numeric_mismatch"))
        .when((v >= 5000) & (mx < v * 0.48), F.lit("numeric_mismatch_low"))
    )
    return j.select(key, "verified_total", "verified_column", F.when(F.size(nums) > 0, mx).alias("max_claim"), flag.alias("flag"))


# ── T5 ─────────────────────────────────────────────────────────────────────────
def causal_audit(answers: DataFrame, evidence: DataFrame, key: str = "answer_id", enabled: bool = True) -> DataFrame:
    """T5 — causal wording + a topic (weather / holiday / news) whose tool was called but
    whose merged successful results lack the topic's keywords → ``causal_language_review``.

    ``evidence``: (answer_id, tool, result, success).  Evidence is reduced per answer to
    a few booleans before the join, so large tool outputs never travel with the answer.
    """
    ok = F.col("success")
    blob = F.lower(F.coalesce("result", F.lit("")))
    ev = evidence.groupBy(key).agg(
        F.bool_or(F.col("tool") == "get_weather_context").alias("had_weather"),
        F.bool_or(F.col("tool") == "get_holiday_status").alias("had_holiday"),
        F.bool_or(F.col("tool") == "get_news_context").alias("had_news"),
        F.bool_or(ok & (blob.contains("temp") | blob.contains("precip") | blob.contains("condition"))).alias("blob_weather"),
        F.bool_or(ok & blob.contains("holiday")).alias("blob_holiday"),
        F.bool_or(ok & (blob.contains("headline") | blob.contains("disruptor"))).alias("blob_news"),
    )
    j = answers.join(ev, key, "left")
    a = F.coalesce("answer", F.lit(""))
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    suspect = (
        (a.rlike(WEATHERISH) & t("had_weather") & ~t("blob_weather"))
        | (a.rlike(HOLIDAYISH) & t("had_holiday") & ~t("blob_holiday"))
        | (a.rlike(NEWSISH) & t("had_news") & ~t("blob_news"))
    )
    active = F.lit(enabled) & (_strip(a) != "") & a.rlike(CAUSAL)
    return j.select(key, F.when(active & suspect, F.lit("causal_language_review")).alias("flag"))


# ── T10 ────────────────────────────────────────────────────────────────────────
def scenario_tags(texts: DataFrame, zones: DataFrame, ref_col: str = "ref_date", default_zone: str | None = None) -> DataFrame:
    """T10 — rain (longest keyword first), temperature (first keyword in table order),
    next occurrence of a named weekday after the reference date, zone by containment
    (first zone in name order).  ``zones`` is the one-row A20 frame."""
    low = F.lower("text")
    rain = None
    for kw, mm in sorted(RAIN_KEYWORDS.items(), key=lambda x: -len(x[0])):
        cond = F.instr(low, kw) > 0
        rain = F.when(cond, F.lit(float(mm))) if rain is None else rain.when(cond, F.lit(float(mm)))
    temp = None
    for kw, tc in TEMP_KEYWORDS.items():
        cond = F.instr(low, kw) > 0
        temp = F.when(cond, F.lit(float(tc))) if temp is None else temp.when(cond, F.lit(float(tc)))
    day = None
    for name in WEEKDAYS:
        cond = F.instr(low, name) > 0
        nxt = F.next_day(F.col(ref_col), name[:3].capitalize())
        day = F.when(cond, nxt) if day is None else day.when(cond, nxt)
    j = texts.join(zones.select("zones"), how="inner")
    hit = F.filter("zones", lambda z: F.instr(low, F.lower(z)) > 0)
    return j.select(
        "scenario_id", "text",
        F.coalesce(F.get(hit, F.lit(0)), F.lit(default_zone)).alias("zone"),
        rain.otherwise(F.lit(0.0)).alias("rain_mm"),
        temp.otherwise(F.lit(27.0)).alias("temp_c"),
        day_str(F.coalesce(day, F.col(ref_col))).alias("date"),
        F.lit("Rule-based fallback").alias("parse_method"),
    )
