"""Registered answer-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import audit, forecast
from tillroll.operators.kpi import zone_bounds
from tillroll.plans.q_context import _CTX
from tillroll.plans.registry import ORACLES, QUERIES, register, sales_of, with_sales
from tillroll.sources import question_log as ql

_P = {k: getattr(audit, k).replace("'", "''") for k in (
    "ISO_DATE", "DECLINE", "COMPARE", "WORST_DAY", "BEST_DAY", "DAILY_TREND", "REV_WORD", "HOW_MUCH", "TOP_ITEMS",
    "PER_OUTLET", "BY_OUTLET", "NOT_PRODUCT", "TOTAL", "NOT_TOTAL", "MONEY", "CAUSAL", "WEATHERISH", "HOLIDAYISH", "NEWSISH")}

_RANKS = """
daily AS (SELECT INVOICE_DATE AS d, ROUND(SUM(NET_AMT), 2) AS rev FROM sales WHERE ZONE IS NOT NULL GROUP BY INVOICE_DATE),
ranks_all AS (SELECT strftime(d, '%Y-%m-%d') AS d, CAST(rev AS DOUBLE) AS rev, RANK() OVER (ORDER BY rev DESC) AS rank_desc,
                     COUNT(*) OVER () AS total_days FROM daily),
ranks_month AS (SELECT strftime(d, '%Y-%m-%d') AS d, CAST(rev AS DOUBLE) AS rev,
                       RANK() OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY rev DESC) AS rank_desc,
                       COUNT(*) OVER (PARTITION BY strftime(d, '%Y-%m')) AS total_days FROM daily),
ranks_last90 AS (SELECT strftime(a.d, '%Y-%m-%d') AS d, CAST(a.rev AS DOUBLE) AS rev,
                        1 + (SELECT COUNT(*) FROM daily b WHERE b.d >= a.d - INTERVAL 90 DAY AND b.rev > a.rev) AS rank_desc,
                        (SELECT COUNT(*) FROM daily b WHERE b.d >= a.d - INTERVAL 90 DAY) AS total_days FROM daily a)"""


def _qdates(col: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({col}, '{_P['ISO_DATE']}', 1)))"


@register("W1_daily_rank_all", with_sales("WITH " + _RANKS + "\nSELECT * FROM ranks_all"))
def w1(spark, sf):
    return audit.daily_ranks(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), "all")


@register("W1_daily_rank_month", with_sales("WITH " + _RANKS + "\nSELECT * FROM ranks_month"))
def w1m(spark, sf):
    return audit.daily_ranks(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), "month")


def _premise_sql(window: str) -> str:
    return with_sales("WITH " + _RANKS + ",\n" + ql.question_sql() + f""",
q AS (SELECT question_id, {_qdates('question')} AS dates, regexp_matches(lower(question), '{_P['DECLINE']}') AS decline FROM questions),
t AS (SELECT question_id, dates[1] AS queried_date FROM q WHERE decline AND len(dates) = 1 AND try_cast(dates[1] AS DATE) IS NOT NULL)
SELECT t.question_id, t.queried_date, r.rev AS day_revenue, r.rank_desc AS rank, r.total_days,
       COALESCE(r.rank_desc = 1, false) AS is_peak, COALESCE(r.rank_desc <= 3, false) AS premise_conflict, '{window}' AS rank_window
FROM t LEFT JOIN ranks_{window} r ON r.d = t.queried_date""")


@register("T1_J8_premise_audit", _premise_sql("all"))
def t1(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")
    return audit.premise_audit(ql.question_log(spark, sf), audit.daily_ranks(s, "all"), "all")


@register("W1_daily_rank_last90", with_sales("WITH " + _RANKS + "\nSELECT * FROM ranks_last90"))
def w1l(spark, sf):
    return audit.daily_ranks(sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT"), "last90")


@register("T1_J8_premise_audit_last90", _premise_sql("last90"))
def t1l(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")
    return audit.premise_audit(ql.question_log(spark, sf), audit.daily_ranks(s, "last90"), "last90")


@register("T1_J8_premise_audit_month", _premise_sql("month"))
def t1m(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "NET_AMT")
    return audit.premise_audit(ql.question_log(spark, sf), audit.daily_ranks(s, "month"), "month")


def _rx(p: str) -> str:
    return f"regexp_matches(low, '{_P[p]}')"


@register("T6_T7_T8_T9_intent_tags", with_sales("WITH " + ql.question_sql() + f""",
b AS (SELECT list_sort(list(DISTINCT ZONE) FILTER (WHERE ZONE IS NOT NULL AND ZONE <> '')) AS zones,
             strftime(MIN(INVOICE_DATE), '%Y-%m-%d') AS min_date, strftime(MAX(INVOICE_DATE), '%Y-%m-%d') AS max_date FROM sales),
q0 AS (SELECT question_id, question, lower(trim(question)) AS low, {_qdates('question')} AS dates, zones, min_date, max_date
       FROM questions CROSS JOIN b),
q1 AS (SELECT *, len(dates) AS n,
              CASE WHEN len(dates) >= 2 THEN least(dates[1], dates[-1]) WHEN len(dates) = 1 THEN dates[1] ELSE min_date END AS ds,
              CASE WHEN len(dates) >= 2 THEN greatest(dates[1], dates[-1]) WHEN len(dates) = 1 THEN dates[1] ELSE max_date END AS de,
              list_filter(zones, lambda z: instr(lower(trim(question)), lower(z)) > 0) AS named FROM q0),
q2 AS (SELECT *, CASE
         WHEN length(trim(question)) < 8 THEN NULL
         WHEN ds > max_date OR de > max_date THEN NULL
         WHEN n >= 2 AND {_rx('COMPARE')} THEN 'compare_two_dates'
         WHEN n = 1 AND {_rx('DECLINE')} THEN 'decline_on_date'
         WHEN len(named) >= 2 AND {_rx('COMPARE')} THEN 'outlet_comparison'
         WHEN {_rx('WORST_DAY')} THEN 'best_worst_day'
         WHEN {_rx('BEST_DAY')} THEN 'best_worst_day'
         WHEN {_rx('DAILY_TREND')} THEN 'daily_trend'
         WHEN n = 1 AND {_rx('REV_WORD')} AND {_rx('HOW_MUCH')} THEN 'single_day_chain_revenue'
         WHEN {_rx('TOP_ITEMS')} AND NOT {_rx('PER_OUTLET')} THEN 'top_items'
         WHEN {_rx('BY_OUTLET')} AND NOT {_rx('NOT_PRODUCT')} THEN 'revenue_by_outlet'
         WHEN {_rx('TOTAL')} AND NOT {_rx('NOT_TOTAL')} THEN 'total_revenue' END AS intent FROM q1)
SELECT question_id, question, intent,
       CASE WHEN intent = 'best_worst_day' THEN CASE WHEN {_rx('WORST_DAY')} THEN 'worst' ELSE 'best' END END AS day_kind,
       ds AS date_start, de AS date_end, array_to_string(list_slice(named, 1, 2), ',') AS zones_named,
       array_to_string(dates, ',') AS dates_found,
       CASE WHEN n > 0 THEN CAST(substr(dates[1], 1, 4) AS INTEGER) ELSE 2026 END AS year_assumption,
       CASE WHEN n > 0 THEN 'regex_iso_in_question' ELSE 'default_dataset_year' END AS year_source
FROM q2"""))
def t6(spark, sf):
    bounds = zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))
    return audit.tag_questions(ql.question_log(spark, sf), bounds)


_ZONE_DAY = """zd AS (SELECT INVOICE_DATE AS d, ZONE, CAST(ROUND(SUM(NET_AMT), 2) AS DECIMAL(18,2)) AS rev,
                    COUNT(DISTINCT INVOICE_NO) AS orders FROM sales GROUP BY INVOICE_DATE, ZONE),
verified AS (SELECT strftime(d, '%Y-%m-%d') AS answer_id, COUNT(*) AS row_count,
                    CAST(SUM(rev) AS DOUBLE) AS rev_sum, CAST(SUM(orders) AS DOUBLE) AS orders_sum FROM zd GROUP BY d)"""


def _digests(spark, sf):
    ev = ql.evidence_log(spark, sf).filter(F.col("tool") == "query_sales_db")
    return audit.table_digest(ev, "result")


@register("T4_table_digest_zone_tables", with_sales("WITH " + _ZONE_DAY + """
SELECT answer_id, row_count, 'revenue' AS col, rev_sum AS sum FROM verified
UNION ALL SELECT answer_id, row_count, 'orders' AS col, orders_sum AS sum FROM verified"""))
def t4(spark, sf):
    d = _digests(spark, sf)
    return d.select("answer_id", "row_count", F.explode("column_sums").alias("c")).select(
        "answer_id", "row_count", F.col("c.col").alias("col"), F.col("c.sum").alias("sum"))


@register("T4_table_digest_documents")
def t4_docs(spark, sf):
    # whole document texts; rows-only check (the fold has no SQL twin)
    from tillroll.sources.tables import read_table
    d = audit.table_digest(read_table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", "row_count", F.explode_outer("column_sums").alias("c")).select(
        "doc_id", "row_count", F.col("c.col").alias("col"), F.col("c.sum").alias("sum"))


@register("T3_primary_total", with_sales("WITH " + _ZONE_DAY + """
SELECT answer_id, rev_sum AS verified_total, 'revenue' AS verified_column FROM verified"""))
def t3(spark, sf):
    return audit.primary_total(_digests(spark, sf))


def _money_sql(col: str) -> str:
    g1 = f"regexp_extract_all({col}, '{_P['MONEY']}', 1)"
    g2 = f"regexp_extract_all({col}, '{_P['MONEY']}', 2)"
    return (f"list_filter(list_transform(list_transform(list_zip({g1}, {g2}), lambda r: replace(COALESCE(NULLIF(r[1], ''), r[2]), ',', '')),"
            f" lambda s: CASE WHEN s <> '' THEN try_cast(s AS DOUBLE) END), lambda x: x IS NOT NULL)")


@register("T2_J9_numeric_audit", with_sales("WITH " + _ZONE_DAY + ",\n" + ql.answer_sql() + f""",
j AS (SELECT a.answer_id, a.answer, v.rev_sum AS verified_total, CASE WHEN v.answer_id IS NOT NULL THEN 'revenue' END AS verified_column,
             {_money_sql('a.answer')} AS nums0
      FROM answers a LEFT JOIN verified v ON v.answer_id = a.answer_id),
k AS (SELECT *, list_filter(nums0, lambda x: x >= CASE WHEN verified_total >= 10000 THEN 10000.0 ELSE greatest(500.0, verified_total * 0.05) END) AS nums FROM j)
SELECT answer_id, verified_total, verified_column, CASE WHEN len(nums) > 0 THEN list_max(nums) END AS max_claim,
       CASE WHEN verified_total IS NULL OR verified_total <= 0 OR len(nums) = 0 THEN NULL
            WHEN list_max(nums) > verified_total * 1.02 THEN 'numeric_mismatch'
            WHEN verified_total >= 5000 AND list_max(nums) < verified_total * 0.48 THEN 'numeric_mismatch_low' END AS flag
FROM k"""))
def t2(spark, sf):
    return audit.numeric_audit(ql.answer_log(spark, sf), audit.primary_total(_digests(spark, sf)))


@register("T5_causal_audit", with_sales(_CTX + ",\n" + ql.answer_sql() + f""",
ev AS (SELECT date AS answer_id,
              weather_condition IS NOT NULL AND weather_condition <> '' AND NOT contains(weather_condition, 'Unavailable') AS blob_weather,
              is_holiday = 1 AS blob_holiday,
              news_disruptors NOT ILIKE 'no headlines%' AS blob_news FROM ctx)
SELECT a.answer_id,
       CASE WHEN trim(a.answer) <> '' AND regexp_matches(a.answer, '{_P['CAUSAL']}')
             AND ((regexp_matches(a.answer, '{_P['WEATHERISH']}') AND NOT COALESCE(ev.blob_weather, false))
               OR (regexp_matches(a.answer, '{_P['HOLIDAYISH']}') AND NOT COALESCE(ev.blob_holiday, false))
               OR (regexp_matches(a.answer, '{_P['NEWSISH']}') AND NOT COALESCE(ev.blob_news, false)))
            THEN 'causal_language_review' END AS flag
FROM answers a LEFT JOIN ev ON ev.answer_id = a.answer_id"""))
def t5(spark, sf):
    return audit.causal_audit(ql.answer_log(spark, sf), ql.evidence_log(spark, sf))


def _case_chain(items, col: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN instr({col}, '{k}') > 0 THEN {v}" for k, v in items) + f" ELSE {default} END"


@register("T10_scenario_tags", with_sales(_CTX + f""",
zs AS (SELECT list_sort(list(DISTINCT ZONE)) AS zs FROM sales),
sc AS (SELECT date AS scenario_id, CAST(date AS DATE) AS ref_date,
              'What if there is ' || lower(COALESCE(weather_condition, 'clear sky')) || ' and it is '
              || CASE WHEN temp_max_c >= 35 THEN 'hot' WHEN temp_max_c >= 32 THEN 'warm' WHEN temp_max_c <= 22 THEN 'cool' ELSE 'mild' END
              || ' in ' || zs[(date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) % len(zs)) + 1]
              || ' on ' || strftime(CAST(date AS DATE), '%A') || '?' AS text
       FROM ctx CROSS JOIN zs),
t AS (SELECT sc.*, lower(text) AS low, list_filter(zs, lambda z: instr(lower(text), lower(z)) > 0) AS hit FROM sc CROSS JOIN zs)
SELECT scenario_id, text, hit[1] AS zone,
       {_case_chain([(k, float(v)) for k, v in sorted(audit.RAIN_KEYWORDS.items(), key=lambda x: -len(x[0]))], 'low', '0.0')} AS rain_mm,
       {_case_chain([(k, float(v)) for k, v in audit.TEMP_KEYWORDS.items()], 'low', '27.0')} AS temp_c,
       strftime(COALESCE({_case_chain([(d, f"ref_date + INTERVAL ((({i} - (isodow(ref_date) - 1) + 6) % 7) + 1) DAY") for i, d in enumerate(audit.WEEKDAYS)], 'low', 'NULL')}, ref_date), '%Y-%m-%d') AS date,
       'Rule-based fallback' AS parse_method
FROM t"""))
def t10(spark, sf):
    zones = zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))
    return audit.scenario_tags(ql.scenario_log(spark, sf), zones)


@register("T6_intent_counts", with_sales("WITH " + ql.question_sql() + f""",
b AS (SELECT list_sort(list(DISTINCT ZONE) FILTER (WHERE ZONE IS NOT NULL AND ZONE <> '')) AS zones,
             strftime(MIN(INVOICE_DATE), '%Y-%m-%d') AS min_date, strftime(MAX(INVOICE_DATE), '%Y-%m-%d') AS max_date FROM sales),
q0 AS (SELECT question, lower(trim(question)) AS low, {_qdates('question')} AS dates, zones, min_date, max_date FROM questions CROSS JOIN b),
q1 AS (SELECT *, len(dates) AS n,
              CASE WHEN len(dates) >= 2 THEN least(dates[1], dates[-1]) WHEN len(dates) = 1 THEN dates[1] ELSE min_date END AS ds,
              CASE WHEN len(dates) >= 2 THEN greatest(dates[1], dates[-1]) WHEN len(dates) = 1 THEN dates[1] ELSE max_date END AS de,
              list_filter(zones, lambda z: instr(lower(trim(question)), lower(z)) > 0) AS named FROM q0),
q2 AS (SELECT CASE
         WHEN length(trim(question)) < 8 THEN NULL
         WHEN ds > max_date OR de > max_date THEN NULL
         WHEN n >= 2 AND {_rx('COMPARE')} THEN 'compare_two_dates'
         WHEN n = 1 AND {_rx('DECLINE')} THEN 'decline_on_date'
         WHEN len(named) >= 2 AND {_rx('COMPARE')} THEN 'outlet_comparison'
         WHEN {_rx('WORST_DAY')} THEN 'best_worst_day'
         WHEN {_rx('BEST_DAY')} THEN 'best_worst_day'
         WHEN {_rx('DAILY_TREND')} THEN 'daily_trend'
         WHEN n = 1 AND {_rx('REV_WORD')} AND {_rx('HOW_MUCH')} THEN 'single_day_chain_revenue'
         WHEN {_rx('TOP_ITEMS')} AND NOT {_rx('PER_OUTLET')} THEN 'top_items'
         WHEN {_rx('BY_OUTLET')} AND NOT {_rx('NOT_PRODUCT')} THEN 'revenue_by_outlet'
         WHEN {_rx('TOTAL')} AND NOT {_rx('NOT_TOTAL')} THEN 'total_revenue' END AS intent FROM q1)
SELECT COALESCE(intent, 'none') AS intent, COUNT(*) AS questions FROM q2 GROUP BY 1"""))
def t6_counts(spark, sf):
    tags = t6(spark, sf)
    return tags.groupBy(F.coalesce("intent", F.lit("none")).alias("intent")).agg(F.count(F.lit(1)).alias("questions"))


@register("fn_Hash_intent_evidence", f"""
WITH tags AS ({ORACLES["T6_T7_T8_T9_intent_tags"]}), premises AS ({ORACLES["T1_J8_premise_audit"]})
SELECT t.question_id, t.intent, t.date_start, t.date_end,
       left(sha256(t.intent || ' from ' || t.date_start || ' to ' || t.date_end || ' zones ' || COALESCE(t.zones_named, '')), 16) AS statement_hash,
       'template_sql' AS premise, p.day_revenue, p.rank,
       CASE WHEN p.premise_conflict THEN 'premise_conflict' END AS guardrail_flags
FROM tags t LEFT JOIN premises p ON p.question_id = t.question_id AND t.intent = 'decline_on_date'
WHERE t.intent IS NOT NULL""")
def evidence(spark, sf):
    return audit.intent_evidence(t6(spark, sf), QUERIES["T1_J8_premise_audit"](spark, sf))


@register("M10_zone_matches", with_sales(f"""
WITH t AS ({ORACLES["T10_scenario_tags"]}),
named AS (SELECT scenario_id, CASE WHEN substr(scenario_id, 10, 1) = '1' THEN lower(left(zone, 4)) WHEN substr(scenario_id, 10, 1) = '2'
          THEN 'the ' || zone || ' zone' WHEN substr(scenario_id, 10, 1) = '3' THEN 'nowhere' ELSE zone END AS asked FROM t),
z AS (SELECT DISTINCT ZONE FROM sales WHERE ZONE IS NOT NULL AND ZONE <> '')
SELECT scenario_id, asked, COALESCE((SELECT MIN(ZONE) FROM z WHERE contains(upper(z.ZONE), upper(asked)) OR contains(upper(asked), upper(z.ZONE))), asked) AS zone
FROM named"""))
def m10(spark, sf):
    """Zones asked for in part, inside other words, by unknown names, and in full."""
    bounds = zone_bounds(sales_of(spark, sf, "ZONE", "INVOICE_DATE"))
    last = F.substring("scenario_id", 10, 1)
    asked = (F.when(last == "1", F.lower(F.left("zone", F.lit(4)))).when(last == "2", F.concat(F.lit("the "), "zone", F.lit(" zone")))
             .when(last == "3", F.lit("nowhere")).otherwise(F.col("zone")))
    named = QUERIES["T10_scenario_tags"](spark, sf).select("scenario_id", asked.alias("asked"))
    return named.join(bounds.select("zones"), how="inner").select(
        "scenario_id", "asked", forecast.match_zone(F.col("asked"), F.col("zones")).alias("zone"))
