"""Basket operators on a small fixture against a brute-force Python computation."""

import itertools
from decimal import Decimal, ROUND_HALF_UP

from pyspark.sql import functions as F

from fixtures import sales_df
from tillroll.operators import basket

BILLS = {
    1: ["Latte", "Muffin", "Latte"],          # repeated item in a bill
    2: ["Latte"],                              # one-item bill
    3: ["Latte", "Muffin", "Cookie (Choc)"],   # name with '('
    4: ["Muffin", "Cookie (Choc)", "", None],  # empty / null items are dropped
    5: ["Latte", "Muffin"],
    6: ["Tea", "Cookie (Choc)"],
}


def _r(x, d):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


def _expected(min_support):
    baskets = {b: {i for i in items if i} for b, items in BILLS.items()}
    baskets = {b: s for b, s in baskets.items() if s}
    t = len(baskets)
    cnt = {}
    for s in baskets.values():
        for i in s:
            cnt[i] = cnt.get(i, 0) + 1
    pairs = {}
    for s in baskets.values():
        for a, b in itertools.combinations(sorted(s), 2):
            pairs[(a, b)] = pairs.get((a, b), 0) + 1
    out = {}
    for (a, b), co in pairs.items():
        if co >= min_support:
            out[(a, b)] = (co, _r(co / t, 4), _r(co / cnt[a], 4), _r(co / cnt[b], 4), _r(co * t / (cnt[a] * cnt[b]), 3))
    return out


def test_affinity_pairs_brute_force(spark):
    rows = [("Z", "2026-01-01", b, 10, item) for b, items in BILLS.items() for item in items]
    bi = basket.bill_items(sales_df(spark, rows))
    for ms in (1, 2):
        got = {(r["item_a"], r["item_b"]): (r["co_count"], r["support"], r["conf_a_b"], r["conf_b_a"], r["lift"])
               for r in basket.affinity_pairs(bi, min_support=ms, top_n=None).collect()}
        assert got == _expected(ms)
    for blk in (1, 2, 512):
        pc = {(r["a"], r["b"]): r["co"] for r in basket.pair_counts(bi, block=blk).collect()}
        assert pc == {k: v[0] for k, v in _expected(1).items()}


def test_combo_label_and_header(spark):
    rows = [("Z", "2026-01-01", b, 10, item) for b, items in BILLS.items() for item in items]
    bi = basket.bill_items(sales_df(spark, rows))
    h = basket.basket_header(bi).first()
    assert (h["total_bills"], h["multi_item_bills"], h["unique_items"]) == (6, 5, 4)
    lab = spark.createDataFrame([("Cookie (Choc)", "Latte")], "item_a string, item_b string").select(
        F.concat_ws(" + ", basket.label_before_paren("item_a"), basket.label_before_paren("item_b")).alias("l")).first()["l"]
    assert lab == "Cookie + Latte"
