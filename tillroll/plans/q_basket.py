"""Registered basket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions.exprs import rnd
from tillroll.operators import basket
from tillroll.operators.basket import QUADRANTS
from tillroll.operators.kpi import optional_filters
from tillroll.plans.registry import register, sales_of, with_sales


def _r(expr: str, d: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {d}) AS DOUBLE)"


_COLS = ("INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS")
_BI = """WITH bi AS (SELECT INVOICE_NO AS bill, PRODUCT AS item, SUM(NET_AMT) AS rev, SUM(QTY_PACKS) AS qty
            FROM sales WHERE PRODUCT IS NOT NULL AND PRODUCT <> '' GROUP BY INVOICE_NO, PRODUCT)"""
_PRICE = """pr AS (SELECT PRODUCT AS item, CAST(SUM(BASIC_RATE) AS DOUBLE) / COUNT(BASIC_RATE) AS price
            FROM sales WHERE PRODUCT IS NOT NULL GROUP BY PRODUCT)"""
_QVALUES = "(VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}')".format(*v) for v in QUADRANTS.values()
) + ") qv(quadrant, icon, action, color)"

_PAIRS = _BI + """,
tot AS (SELECT COUNT(DISTINCT bill) AS t FROM bi),
sup AS (SELECT item, COUNT(*) AS c FROM bi GROUP BY item),
co AS (SELECT x.item AS a, y.item AS b, COUNT(*) AS co FROM bi x JOIN bi y ON x.bill = y.bill AND x.item < y.item
       GROUP BY x.item, y.item HAVING COUNT(*) >= 3),
pairs AS (SELECT a AS item_a, b AS item_b, co AS co_count,
                 {s} AS support, {cab} AS conf_a_b, {cba} AS conf_b_a, {l} AS lift
          FROM co JOIN sup sa ON sa.item = a JOIN sup sb ON sb.item = b CROSS JOIN tot)""".format(
    s=_r("CAST(co AS DOUBLE) / t", 4), cab=_r("CAST(co AS DOUBLE) / sa.c", 4), cba=_r("CAST(co AS DOUBLE) / sb.c", 4),
    l=_r("(CAST(co AS DOUBLE) * t) / (CAST(sa.c AS DOUBLE) * sb.c)", 3),
)
_TOP30 = "top30 AS (SELECT * FROM pairs ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 30)"

_MATRIX = _PRICE + """,
per_item AS (SELECT item, SUM(rev) AS rev, SUM(qty) AS qty FROM bi GROUP BY item),
items AS (SELECT p.item AS item_name, {rev} AS total_revenue, CAST(qty AS DOUBLE) AS total_qty, {price} AS avg_price
          FROM per_item p LEFT JOIN pr ON p.item = pr.item WHERE CAST(qty AS DOUBLE) >= 2),
th AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY total_qty DESC) AS med_qty,
              percentile_disc(0.5) WITHIN GROUP (ORDER BY avg_price DESC) AS med_price FROM items),
matrix AS (SELECT item_name, total_revenue, total_qty, avg_price,
                  CASE WHEN total_qty >= med_qty AND avg_price >= med_price THEN 'Star'
                       WHEN total_qty < med_qty AND avg_price >= med_price THEN 'Puzzle'
                       WHEN total_qty >= med_qty THEN 'Plowhorse' ELSE 'Dog' END AS quadrant
           FROM items CROSS JOIN th)""".format(rev=_r("CAST(rev AS DOUBLE)", 2), price=_r("COALESCE(price, 0)", 2))


def _bi(spark, sf):
    return basket.bill_items(sales_of(spark, sf, *_COLS))


def _matrix(spark, sf):
    return basket.menu_matrix(sales_of(spark, sf, *_COLS, "BASIC_RATE"))


@register("A26_bill_item_preagg", with_sales(_BI + """
SELECT bill, item, CAST(rev AS DOUBLE) AS rev, CAST(qty AS DOUBLE) AS qty FROM bi"""))
def a26(spark, sf):
    return _bi(spark, sf).select("bill", "item", F.col("rev").cast("double").alias("rev"), F.col("qty").cast("double").alias("qty"))


@register("A25_item_avg_price", with_sales("WITH " + _PRICE + f"""
SELECT item, {_r('price', 2)} AS avg_price FROM pr"""))
def a25(spark, sf):
    return basket.item_prices(sales_of(spark, sf, "PRODUCT", "BASIC_RATE")).select("item", rnd(F.col("price"), 2).alias("avg_price"))


@register("A27_basket_header", with_sales(_BI + f""",
pb AS (SELECT bill, COUNT(*) AS n_items FROM bi GROUP BY bill)
SELECT COUNT(*) AS total_bills, COUNT(*) FILTER (WHERE n_items > 1) AS multi_item_bills,
       {_r('CAST(COUNT(*) FILTER (WHERE n_items > 1) * 100 AS DOUBLE) / COUNT(*)', 1)} AS multi_item_pct,
       (SELECT COUNT(DISTINCT item) FROM bi) AS unique_items
FROM pb"""))
def a27(spark, sf):
    return basket.basket_header(_bi(spark, sf))


@register("B1_item_support", with_sales(_BI + """
SELECT item, COUNT(*) AS bills FROM bi GROUP BY item"""))
def b1(spark, sf):
    return basket.item_support(_bi(spark, sf))


@register("J2_pair_counts", with_sales(_BI + """
SELECT x.item AS a, y.item AS b, COUNT(*) AS co FROM bi x JOIN bi y ON x.bill = y.bill AND x.item < y.item GROUP BY x.item, y.item"""))
def j2(spark, sf):
    return basket.pair_counts(_bi(spark, sf))


@register("J2_pair_counts_small_blocks", with_sales(_BI + """
SELECT x.item AS a, y.item AS b, COUNT(*) AS co FROM bi x JOIN bi y ON x.bill = y.bill AND x.item < y.item GROUP BY x.item, y.item"""))
def j2_blocks(spark, sf):
    # block size 2 forces every multi-item bill through the split path (hot-bill plan)
    return basket.pair_counts(_bi(spark, sf), block=2)


@register("B2_affinity_pairs_top30", with_sales(_PAIRS + """
SELECT * FROM pairs ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 30"""))
def b2(spark, sf):
    return basket.affinity_pairs(_bi(spark, sf))


@register("B2_affinity_pairs_all", with_sales(_PAIRS + """
SELECT * FROM pairs"""))
def b2_all(spark, sf):
    return basket.affinity_pairs(_bi(spark, sf), top_n=None)


@register("W6_upper_median_qty", with_sales(_BI + """,
per_item AS (SELECT item, CAST(SUM(qty) AS DOUBLE) AS qty FROM bi GROUP BY item)
SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY qty DESC) AS med_qty FROM per_item"""))
def w6(spark, sf):
    per_item = _bi(spark, sf).groupBy("item").agg(F.sum("qty").cast("double").alias("qty"))
    return basket.upper_median(per_item, "qty", "med_qty")


@register("B3_menu_matrix", with_sales(_BI + ",\n" + _MATRIX + f"""
SELECT m.item_name, m.total_revenue, m.total_qty, m.avg_price, m.quadrant, qv.icon, qv.action, qv.color
FROM matrix m JOIN {_QVALUES} ON qv.quadrant = m.quadrant"""))
def b3(spark, sf):
    return _matrix(spark, sf)


@register("B8_quadrant_population", with_sales(_BI + ",\n" + _MATRIX + f"""
SELECT qv.quadrant, COUNT(m.item_name) AS items FROM {_QVALUES} LEFT JOIN matrix m ON m.quadrant = qv.quadrant
GROUP BY qv.quadrant"""))
def b8(spark, sf):
    return basket.quadrant_population(_matrix(spark, sf))


@register("O4_top5_per_quadrant", with_sales(_BI + ",\n" + _MATRIX + """
SELECT * FROM (SELECT m.item_name, m.total_revenue, m.total_qty, m.avg_price, m.quadrant,
                      ROW_NUMBER() OVER (PARTITION BY quadrant ORDER BY total_revenue DESC, item_name) AS rank FROM matrix m)
WHERE rank <= 5"""))
def o4(spark, sf):
    return basket.top_per_quadrant(_matrix(spark, sf), 5).select("item_name", "total_revenue", "total_qty", "avg_price", "quadrant", "rank")


def _combos_sql(final: str) -> str:
    return with_sales(_PAIRS + ",\n" + _TOP30 + ",\n" + _MATRIX + """,
cur AS (SELECT item_a, item_b FROM top30 ORDER BY co_count DESC, item_a, item_b LIMIT 1),
cand AS (SELECT t.* FROM top30 t WHERE co_count >= 5 AND lift > 1.0
         AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.item_a = t.item_a AND cur.item_b = t.item_b)),
j AS (SELECT c.item_a, c.item_b, c.lift, c.co_count, c.support,
             COALESCE(qa.quadrant, 'Unknown') AS quad_a, COALESCE(qb.quadrant, 'Unknown') AS quad_b,
             COALESCE(pa.price, 0.0) AS price_a, COALESCE(pb.price, 0.0) AS price_b
      FROM cand c LEFT JOIN matrix qa ON qa.item_name = c.item_a LEFT JOIN matrix qb ON qb.item_name = c.item_b
      LEFT JOIN pr pa ON pa.item = c.item_a LEFT JOIN pr pb ON pb.item = c.item_b
      WHERE NOT (COALESCE(qa.quadrant, 'Unknown') = 'Dog' AND COALESCE(qb.quadrant, 'Unknown') = 'Dog')),
combos AS (SELECT item_a, item_b, lift, co_count, {sp} AS support_pct, quad_a, quad_b,
                  {pa} AS price_a, {pb} AS price_b, {bundle} AS bundle_price, {reg} AS regular_aov,
                  CASE WHEN GREATEST(price_a, price_b) > 0
                       THEN {aov} ELSE 0.0 END AS aov_lift_pct,
                  left(trim(split_part(item_a, '(', 1)), 28) || ' + ' || left(trim(split_part(item_b, '(', 1)), 28) AS combo_label
           FROM j ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 5)
""".format(
        sp=_r("support * 100", 2), pa=_r("price_a", 2), pb=_r("price_b", 2), bundle=_r("(price_a + price_b) * 0.85", 2),
        reg=_r("price_a + price_b", 2),
        aov=_r("(" + _r("(price_a + price_b) * 0.85", 2) + " - GREATEST(price_a, price_b)) / GREATEST(price_a, price_b, 1.0) * 100", 1),
    ) + final)


def _combos(spark, sf):
    s = sales_of(spark, sf, *_COLS, "BASIC_RATE")
    bi = basket.bill_items(s)
    top30 = basket.affinity_pairs(bi)
    current = top30.orderBy(F.col("co_count").desc(), "item_a", "item_b").limit(1)
    return basket.combo_recommendations(top30, basket.menu_matrix(s), basket.item_prices(s), current), top30, s


@register("B4_power_combos", _combos_sql("SELECT * FROM combos"))
def b4(spark, sf):
    return _combos(spark, sf)[0]


@register("B9_brief_selections", _combos_sql(""",
q AS (SELECT quadrant AS section, rank, item_name AS item_a, CAST(NULL AS VARCHAR) AS item_b, total_revenue AS value
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY quadrant ORDER BY total_revenue DESC, item_name) AS rank FROM matrix)
      WHERE rank <= 3 AND quadrant IN ('Star', 'Dog', 'Puzzle')),
c AS (SELECT 'combo' AS section, ROW_NUMBER() OVER (ORDER BY lift DESC, co_count DESC, item_a, item_b) AS rank, item_a, item_b,
             bundle_price AS value FROM combos),
p AS (SELECT 'pair' AS section, ROW_NUMBER() OVER (ORDER BY lift DESC, co_count DESC, item_a, item_b) AS rank, item_a, item_b,
             lift AS value FROM top30)
SELECT * FROM q UNION ALL SELECT * FROM c WHERE rank <= 5 UNION ALL SELECT * FROM p WHERE rank <= 5"""))
def b9(spark, sf):
    combos, top30, s = _combos(spark, sf)
    return basket.brief_selections(basket.menu_matrix(s), combos, top30)


# Live basket for one zone and window, group text blank (no class filter).
_LIVE_ZONE, _LIVE_FROM, _LIVE_TO = "ASIA", "1996-01-01", "1998-12-31"


@register("B5_live_basket", with_sales(f"""
WITH f AS (SELECT * FROM sales WHERE ZONE = '{_LIVE_ZONE}' AND INVOICE_DATE >= DATE '{_LIVE_FROM}' AND INVOICE_DATE <= DATE '{_LIVE_TO}'),
bi AS (SELECT INVOICE_NO AS bill, PRODUCT AS item, SUM(NET_AMT) AS rev, SUM(QTY_PACKS) AS qty
       FROM f GROUP BY INVOICE_NO, PRODUCT),
per_item AS (SELECT item, CAST(SUM(rev) AS DOUBLE) AS rev, CAST(SUM(qty) AS DOUBLE) AS qty, COUNT(*) AS bills FROM bi GROUP BY item),
tot AS (SELECT COUNT(DISTINCT bill) AS t FROM bi HAVING COUNT(DISTINCT bill) >= 2),
ok AS (SELECT item, rev / GREATEST(qty, 1.0) AS avg, bills FROM per_item WHERE qty >= 2 AND rev / GREATEST(qty, 1.0) >= 10),
th AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY qty DESC) AS mq,
              percentile_disc(0.5) WITHIN GROUP (ORDER BY rev DESC) AS mr FROM per_item),
quad AS (SELECT item, CASE WHEN qty >= mq AND rev >= mr THEN 'Star' WHEN qty < mq AND rev >= mr THEN 'Puzzle'
                           WHEN qty >= mq THEN 'Plowhorse' ELSE 'Dog' END AS quadrant FROM per_item CROSS JOIN th),
co AS (SELECT x.item AS a, y.item AS b, COUNT(*) AS co FROM bi x JOIN bi y ON x.bill = y.bill AND x.item < y.item
       WHERE x.item IN (SELECT item FROM ok) AND y.item IN (SELECT item FROM ok) GROUP BY 1, 2),
m AS (SELECT co.a, co.b, co.co, oa.avg AS avg_a, ob.avg AS avg_b, oa.bills AS ca, ob.bills AS cb, t,
             qa.quadrant AS quad_a, qb.quadrant AS quad_b
      FROM co JOIN ok oa ON oa.item = co.a JOIN ok ob ON ob.item = co.b CROSS JOIN tot
      JOIN quad qa ON qa.item = co.a JOIN quad qb ON qb.item = co.b),
s AS (SELECT *, CAST(co AS DOUBLE) / t AS sab, CAST(ca AS DOUBLE) / t AS sa, CAST(cb AS DOUBLE) / t AS sb FROM m)
SELECT a AS item_a, b AS item_b, co AS co_count, {_r('(sab / sa) / sb', 2)} AS lift, {_r('sab * 100', 2)} AS support_pct,
       {_r('(sab / sa) * 100', 1)} AS conf_pct, {_r('avg_a', 0)} AS avg_a, {_r('avg_b', 0)} AS avg_b, quad_a, quad_b,
       {_r(f"({_r('avg_a', 0)} + {_r('avg_b', 0)}) * 0.85", 0)} AS bundle_price
FROM s ORDER BY lift DESC, co_count DESC, item_a, item_b LIMIT 8"""))
def b5(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "PRODUCT_CLASS", *_COLS)
    return basket.live_basket(optional_filters(s, zone=_LIVE_ZONE, date_from=_LIVE_FROM, date_to=_LIVE_TO), top_n=8)


@register("B5_live_header", with_sales(f"""
WITH pb AS (SELECT INVOICE_NO AS bill, COUNT(DISTINCT PRODUCT) AS n_items FROM sales
            WHERE ZONE = '{_LIVE_ZONE}' AND INVOICE_DATE BETWEEN DATE '{_LIVE_FROM}' AND DATE '{_LIVE_TO}' GROUP BY 1)
SELECT COUNT(*) AS total_bills, COUNT(*) FILTER (WHERE n_items > 1) AS multi_item_bills,
       {_r('CAST(COUNT(*) FILTER (WHERE n_items > 1) * 100 AS DOUBLE) / COUNT(*)', 1)} AS multi_item_pct,
       (SELECT COUNT(DISTINCT PRODUCT) FROM sales WHERE ZONE = '{_LIVE_ZONE}'
        AND INVOICE_DATE BETWEEN DATE '{_LIVE_FROM}' AND DATE '{_LIVE_TO}') AS unique_items
FROM pb"""))
def b5_header(spark, sf):
    s = sales_of(spark, sf, "ZONE", "INVOICE_DATE", "PRODUCT_CLASS", *_COLS)
    live = optional_filters(s, zone=_LIVE_ZONE, date_from=_LIVE_FROM, date_to=_LIVE_TO)
    return basket.basket_header(basket.bill_items(live, keep_blank=True))


@register("B6_live_quadrants", with_sales(_BI + """,
per_item AS (SELECT item, CAST(SUM(rev) AS DOUBLE) AS rev, CAST(SUM(qty) AS DOUBLE) AS qty FROM bi GROUP BY item),
th AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY qty DESC) AS mq,
              percentile_disc(0.5) WITHIN GROUP (ORDER BY rev DESC) AS mr FROM per_item)
SELECT item, CASE WHEN qty >= mq AND rev >= mr THEN 'Star' WHEN qty < mq AND rev >= mr THEN 'Puzzle'
                  WHEN qty >= mq THEN 'Plowhorse' ELSE 'Dog' END AS quadrant FROM per_item CROSS JOIN th"""))
def b6(spark, sf):
    per_item = _bi(spark, sf).groupBy("item").agg(F.sum("rev").cast("double").alias("rev"), F.sum("qty").cast("double").alias("qty"))
    return basket.live_quadrants(per_item)
