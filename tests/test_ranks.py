"""Order statistics and later-day counts against plain Python, and the shape of their plans."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fixtures import SF_MID, sales_df
from tillroll.operators import audit, basket, ranks
from tillroll.sources.tables import sales


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upper_medians_of_odd_columns(spark):
    random.seed(1)
    cases = [[], [3.0], [1.0, 2.0], [2.0] * 50 + [7.0], [random.gauss(0, 9) for _ in range(501)], [-1.0, -1.0, -2.0, 1e300]]
    for values in cases:
        rows = [(v, -v) for v in values] + [(None, None)]
        got = ranks.upper_medians(spark.createDataFrame(rows, "a double, b double"), {"x": "a", "y": "b"}).first()
        want = [sorted(c)[len(c) // 2] if c else None for c in (values, [-v for v in values])]
        assert [got["x"], got["y"]] == want


def test_no_percentile_buffer_in_the_matrix(spark):
    s = sales(spark, SF_MID, ["INVOICE_NO", "PRODUCT", "NET_AMT", "QTY_PACKS", "BASIC_RATE"])
    plan = _plan(basket.menu_matrix(s))
    assert "percentile" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_ranks_since_90_days_before(spark):
    random.seed(2)
    day0 = dt.date(1969, 11, 1)  # both sides of the epoch
    values = {day0 + dt.timedelta(days=d): random.randint(1, 40) for d in range(400) if random.random() < 0.8}
    got = audit.daily_ranks(sales_df(spark, [("Z", d.isoformat(), i, v) for i, (d, v) in enumerate(values.items())]), "last90")
    want = {}
    for d, v in values.items():
        window = [x for e, x in values.items() if e >= d - dt.timedelta(days=90)]
        want[d.isoformat()] = (float(v), 1 + sum(x > v for x in window), len(window))
    assert {r["d"]: (r["rev"], r["rank_desc"], r["total_days"]) for r in got.collect()} == want
    assert "collect_list" not in _plan(got)


def _live_rows():
    """A few rare items that go together, and many that are in most bills."""
    random.seed(3)
    rows = []
    for bill in range(300):
        items = [f"common {i}" for i in range(30) if random.random() < 0.6]
        items += [f"rare {bill // 30} {k}" for k in range(2)] if bill % 30 < 3 else []
        rows += [("Z", "2026-01-01", bill, 100, item, 2) for item in items]
    return rows


def test_live_basket_leaves_out_what_cannot_win(spark):
    s = sales_df(spark, _live_rows())
    lines = basket.bill_items(s, keep_blank=True)
    items = lines.groupBy("item").agg(F.count("*").alias("bills")).select(
        "item", F.lit(50.0).alias("avg"), "bills", F.lit("Star").alias("quadrant"))
    limit = basket.live_limit(lines, items, 300, 8)
    kept = items.filter(F.col("bills") <= limit)
    few = basket.pair_counts(lines.join(kept.select("item"), "item", "left_semi")).count()
    every = basket.pair_counts(lines).count()
    assert few <= 10 < every / 10  # rows that the pair shuffle carries
    cut = basket._live_pairs(lines, items, 300, 8, limit).collect()
    assert cut == basket._live_pairs(lines, items, 300, 8).collect() and len(cut) == 8
    got = basket.live_basket(s)
    plan = _plan(got)
    assert "NestedLoop" not in plan and plan.count("- Exchange") + plan.count("BroadcastExchange") < 20
    assert [(r["item_a"], r["item_b"], r["lift"]) for r in got.collect()] == [(r["item_a"], r["item_b"], r["lift"]) for r in cut]


def test_hot_bill_is_joined_by_slices(spark):
    rows = [("Z", "2026-01-01", 1, 10, f"i{i}") for i in range(60)] + [("Z", "2026-01-01", b, 10, f"i{b}") for b in range(2, 30)]
    bi = basket.bill_items(sales_df(spark, rows + [("Z", "2026-01-01", 5, 10, "i1")]))
    got = {(r["a"], r["b"]): r["co"] for r in basket.pair_counts(bi, block=4).collect()}
    assert len(got) == 60 * 59 // 2 and sum(got.values()) == 60 * 59 // 2 + 1
