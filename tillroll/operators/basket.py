"""Market basket and product matrix: A25–A27, B1–B9, J2–J5, W6, O2, O4.

Pair generation (J2) at scale
-----------------------------
Co-occurrence counting needs, per bill, the unordered pairs of its distinct items.  The
plan keeps that bounded per task:

1. bills are reduced to distinct ``(bill, item)`` rows first (hash-partitioned on both
   columns, so one huge bill is spread over many tasks);
2. items that cannot reach the support threshold are removed before pairing (an exact
   Apriori cut: a pair's co-count never exceeds either item's support);
3. bills with one item form no pair in the join below;
4. a bill of more than ``block`` items is cut into ``ceil(k / block)`` item blocks by a hash of
   the item, and the self-join runs on ``(bill, block_i, block_j)``: a bill of k items becomes
   (k/block)² independent joins of at most block × block rows, so a hot bill holding a
   third of all lines is split across tasks instead of landing in one; the number of blocks
   reaches the lines by a join on ``(bill, slice)``, ``SLICES`` rows for each such bill;
5. pair rows go straight into a partially aggregated ``groupBy(a, b).count()``, so the
   shuffle carries at most one row per distinct pair per task.

The item counts per bill come from a ``groupBy`` (partial aggregation), not a window, so a
hot bill never has to sit in a single task.

Thresholds (W6 upper median) come from range-dealt value counts (``ranks``).  The item frames they are
taken from are written once, so the fact is read once for thresholds and rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import fdiv, label_before_paren, non_empty, rnd
from tillroll.operators.ranks import upper_medians
from tillroll.sources.io import staged

# ── Fixed values: quadrant names, icons, actions, colours ─────────────────────
QUADRANTS = {
    # (high popularity, high price) -> (name, icon, action, colour)
    (True, True): ("Star", "⭐", "Maintain — high-volume, high-margin", "green"),
    (False, True): ("Puzzle", "🔮", "Promote — high-margin but under-ordered", "blue"),
    (True, False): ("Plowhorse", "🐴", "Reposition — popular but low-margin", "orange"),
    (False, False): ("Dog", "🐕", "Review/Remove — low-volume, low-margin", "red"),
}
BUNDLE_DISCOUNT = 0.85
PAIR_BLOCK = 512
SLICES = 64


# ── A26 / A25 / A27 / B1 ───────────────────────────────────────────────────────
def bill_items(sales: DataFrame, with_rate: bool = False, keep_blank: bool = False) -> DataFrame:
    """A26 — (bill, item) pre-aggregation of revenue and quantity; empty items dropped
    unless ``keep_blank``.

    ``with_rate`` also carries the price sum / count so item prices (A25) come from the
    same single pass over the fact."""
    extra = [F.sum("BASIC_RATE").alias("rate_sum"), F.count("BASIC_RATE").alias("rate_n")] if with_rate else []
    return (
        (sales if keep_blank else sales.filter(non_empty("PRODUCT")))
        .groupBy(F.col("INVOICE_NO").alias("bill"), F.col("PRODUCT").alias("item"))
        .agg(F.sum("NET_AMT").alias("rev"), F.sum("QTY_PACKS").alias("qty"), *extra)
    )


def prices_from_bill_items(bi: DataFrame) -> DataFrame:
    """A25 from the (bill, item) aggregate: row-weighted mean price per item."""
    return bi.groupBy("item").agg(fdiv(F.sum("rate_sum"), F.sum("rate_n")).alias("price"))


def item_prices(sales: DataFrame) -> DataFrame:
    """A25 — row-weighted average price per item (unrounded double)."""
    return (
        sales.filter(F.col("PRODUCT").isNotNull())
        .groupBy(F.col("PRODUCT").alias("item"))
        .agg(fdiv(F.sum("BASIC_RATE"), F.count("BASIC_RATE")).alias("price"))
    )


def item_support(bi: DataFrame) -> DataFrame:
    """B1 — number of bills containing each item (once per bill)."""
    return bi.select("bill", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("bills"))


def basket_header(bi: DataFrame) -> DataFrame:
    """A27 — bills, multi-item bills, their share (%), distinct items."""
    per_bill = bi.groupBy("bill").agg(F.count(F.lit(1)).alias("n_items"))
    h = per_bill.agg(
        F.count(F.lit(1)).alias("total_bills"),
        F.count_if(F.col("n_items") > 1).alias("multi_item_bills"),
    )
    items = bi.select("item").distinct().agg(F.count(F.lit(1)).alias("unique_items"))
    return h.join(items, how="inner").select(
        "total_bills", "multi_item_bills",
        rnd(fdiv(F.col("multi_item_bills") * 100, F.col("total_bills")), 1).alias("multi_item_pct"),
        "unique_items",
    )


# ── J2: co-occurrence ──────────────────────────────────────────────────────────
def pair_counts(bi: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """J2 — (item_a < item_b, co) over distinct (bill, item) rows, hot bills split in blocks."""
    d = bi.select("bill", "item").distinct().withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)))
    large = d.groupBy("bill").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > block)
    large = large.select("bill", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("n"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))).alias("slice"))
    d = d.join(large, ["bill", "slice"], "left").withColumn("nb", F.coalesce("n", F.lit(1)))
    d = d.select("bill", "item", "nb", F.pmod(F.xxhash64(F.lit(1), "item"), F.col("nb")).cast("int").alias("blk"))
    left = d.select("bill", F.col("blk").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bj"), F.col("item").alias("a"))
    right = d.select("bill", F.col("blk").alias("bj"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bi"), F.col("item").alias("b"))
    pairs = left.join(right, ["bill", "bi", "bj"]).filter(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co"))


# ── B2 ─────────────────────────────────────────────────────────────────────────
def affinity_pairs(bi: DataFrame, min_support: int = 3, top_n: int | None = 30) -> DataFrame:
    """B2 — pairs with co ≥ min_support; support / confidences 4dp, lift 3dp; ordered by
    the *rounded* lift then co-count (then names), top ``top_n``."""
    # one distinct (bill, item) frame feeds the bill count, the supports and the pairs, so
    # the planner reuses its exchange and the fact is read once
    d = bi.select("bill", "item").distinct()
    total = d.agg(F.count_distinct("bill").alias("t"))
    sup = d.groupBy("item").agg(F.count(F.lit(1)).alias("bills"))
    frequent = sup.filter(F.col("bills") >= min_support).select("item")
    co = pair_counts(d.join(frequent, "item", "left_semi")).filter(F.col("co") >= min_support)
    sa = sup.select(F.col("item").alias("a"), F.col("bills").alias("ca"))
    sb = sup.select(F.col("item").alias("b"), F.col("bills").alias("cb"))
    m = co.join(sa, "a").join(sb, "b").join(total, how="inner")
    co_d = F.col("co").cast("double")
    out = m.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("co").alias("co_count"),
        rnd(co_d / F.col("t"), 4).alias("support"),
        rnd(co_d / F.col("ca"), 4).alias("conf_a_b"),
        rnd(co_d / F.col("cb"), 4).alias("conf_b_a"),
        rnd((co_d * F.col("t")) / (F.col("ca").cast("double") * F.col("cb")), 3).alias("lift"),
    )
    out = out.orderBy(F.col("lift").desc(), F.col("co_count").desc(), "item_a", "item_b")  # O2
    return out.limit(top_n) if top_n else out


# ── W6 / B3 / B8 ───────────────────────────────────────────────────────────────
def upper_median(df: DataFrame, col: str, alias: str) -> DataFrame:
    """W6 — ``sorted(x)[len(x)//2]`` as a one-row frame."""
    return upper_medians(df, {alias: col})


def _quadrant(high_pop: Column, high_val: Column) -> tuple[Column, Column, Column, Column]:
    def pick(idx: int) -> Column:
        expr = None
        for (p, v), vals in QUADRANTS.items():
            cond = (high_pop == F.lit(p)) & (high_val == F.lit(v))
            expr = F.when(cond, F.lit(vals[idx])) if expr is None else expr.when(cond, F.lit(vals[idx]))
        return expr

    return pick(0), pick(1), pick(2), pick(3)


def menu_matrix(sales: DataFrame, min_qty: float = 2) -> DataFrame:
    """B3 — items with qty ≥ min_qty; thresholds are the upper medians of qty and of the
    2-dp average price; ``>=`` is high; sorted by revenue descending."""
    bi = bill_items(sales, with_rate=True)
    per_item = bi.groupBy("item").agg(
        F.sum("rev").alias("rev"), F.sum("qty").alias("qty"), fdiv(F.sum("rate_sum"), F.sum("rate_n")).alias("price"))
    items = per_item.select(
        F.col("item").alias("item_name"),
        rnd(F.col("rev").cast("double"), 2).alias("total_revenue"),
        F.col("qty").cast("double").alias("total_qty"),
        rnd(F.coalesce("price", F.lit(0.0)), 2).alias("avg_price"),
    ).filter(F.col("total_qty") >= min_qty)
    items = staged(items, "menu-items")
    half = upper_medians(items, {"qty": "total_qty", "price": "avg_price"}).first()
    q, icon, action, color = _quadrant(F.col("total_qty") >= F.lit(half["qty"]), F.col("avg_price") >= F.lit(half["price"]))
    return (
        items
        .select("item_name", "total_revenue", "total_qty", "avg_price",
                q.alias("quadrant"), icon.alias("icon"), action.alias("action"), color.alias("color"))
        .orderBy(F.col("total_revenue").desc(), "item_name")
    )


def quadrant_population(matrix: DataFrame) -> DataFrame:
    """B8 — items per quadrant (all four quadrants listed, zero when empty)."""
    names = matrix.sparkSession.createDataFrame([(v[0],) for v in QUADRANTS.values()], "quadrant string")
    counts = matrix.groupBy("quadrant").agg(F.count(F.lit(1)).alias("items"))
    return names.join(counts, "quadrant", "left").select("quadrant", F.coalesce("items", F.lit(0)).alias("items"))


def top_per_quadrant(matrix: DataFrame, n: int = 5, quadrants: list[str] | None = None) -> DataFrame:
    """O4 — top-n items by revenue within each quadrant."""
    m = matrix if quadrants is None else matrix.filter(F.col("quadrant").isin(quadrants))
    w = Window.partitionBy("quadrant").orderBy(F.col("total_revenue").desc(), "item_name")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ── B4 ─────────────────────────────────────────────────────────────────────────
def combo_recommendations(
    pairs: DataFrame, matrix: DataFrame, prices: DataFrame,
    current_combos: DataFrame | None = None, top_n: int = 5, min_co: int = 5, min_lift: float = 1.0,
) -> DataFrame:
    """B4 — from the affinity list: co ≥ 5, lift > 1.0, not Dog+Dog, not already a combo
    (J5, anti-join on (item_a, item_b)); quadrant and price attached by left joins with
    'Unknown' / 0 defaults (J4); bundle = 0.85·(pa+pb)."""
    p = pairs.filter((F.col("co_count") >= min_co) & (F.col("lift") > min_lift))
    if current_combos is not None:
        p = p.join(current_combos.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
    qa = matrix.select(F.col("item_name").alias("item_a"), F.col("quadrant").alias("quad_a"))
    qb = matrix.select(F.col("item_name").alias("item_b"), F.col("quadrant").alias("quad_b"))
    pa = prices.select(F.col("item").alias("item_a"), F.col("price").alias("price_a"))
    pb = prices.select(F.col("item").alias("item_b"), F.col("price").alias("price_b"))
    j = (
        p.join(qa, "item_a", "left").join(qb, "item_b", "left")
        .join(pa, "item_a", "left").join(pb, "item_b", "left")
        .select(
            "item_a", "item_b", "lift", "co_count", "support",
            F.coalesce("quad_a", F.lit("Unknown")).alias("quad_a"),
            F.coalesce("quad_b", F.lit("Unknown")).alias("quad_b"),
            F.coalesce("price_a", F.lit(0.0)).alias("price_a"),
            F.coalesce("price_b", F.lit(0.0)).alias("price_b"),
        )
        .filter(~((F.col("quad_a") == "Dog") & (F.col("quad_b") == "Dog")))
    )
    both = F.col("price_a") + F.col("price_b")
    hi = F.greatest("price_a", "price_b")
    bundle = rnd(both * BUNDLE_DISCOUNT, 2)
    out = j.select(
        "item_a", "item_b", "lift", "co_count",
        rnd(F.col("support") * 100, 2).alias("support_pct"),
        "quad_a", "quad_b",
        rnd(F.col("price_a"), 2).alias("price_a"), rnd(F.col("price_b"), 2).alias("price_b"),
        bundle.alias("bundle_price"),
        rnd(both, 2).alias("regular_aov"),
        F.when(hi > 0, rnd((bundle - hi) / F.greatest(hi, F.lit(1.0)) * 100, 1)).otherwise(F.lit(0.0)).alias("aov_lift_pct"),
        F.concat_ws(" + ", label_before_paren("item_a"), label_before_paren("item_b")).alias("combo_label"),
    )
    return out.orderBy(F.col("lift").desc(), F.col("co_count").desc(), "item_a", "item_b").limit(top_n)


# ── B5 / B6 / B7 ───────────────────────────────────────────────────────────────
def _live_quadrant(per_item: DataFrame) -> Column:
    half = upper_medians(per_item, {"qty": "qty", "rev": "rev"}).first()
    return _quadrant(F.col("qty") >= F.lit(half["qty"]), F.col("rev") >= F.lit(half["rev"]))[0]


def live_quadrants(per_item: DataFrame) -> DataFrame:
    """B6 — quadrant by upper medians of quantity and of revenue over all items."""
    per_item = staged(per_item, "live-items")
    return per_item.select("item", _live_quadrant(per_item).alias("quadrant"))


def _live_pairs(lines: DataFrame, items: DataFrame, total: int, top_n: int, most: float | None = None) -> DataFrame:
    """The ``top_n`` pairs of ``items`` (item, avg, bills, quadrant) that are in at most ``most`` bills."""
    some = items if most is None else items.filter(F.col("bills") <= F.lit(most))
    co = pair_counts(lines.join(some.select("item"), "item", "left_semi"))
    a = some.select(F.col("item").alias("a"), F.col("avg").alias("avg_a"), F.col("bills").alias("ca"), F.col("quadrant").alias("quad_a"))
    b = some.select(F.col("item").alias("b"), F.col("avg").alias("avg_b"), F.col("bills").alias("cb"), F.col("quadrant").alias("quad_b"))
    t = F.lit(total)
    sup_ab = F.col("co").cast("double") / t
    conf = sup_ab / (F.col("ca").cast("double") / t)
    lift = conf / (F.col("cb").cast("double") / t)
    ra, rb = rnd(F.col("avg_a"), 0), rnd(F.col("avg_b"), 0)
    out = co.join(a, "a").join(b, "b").select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("co").alias("co_count"),
        rnd(lift, 2).alias("lift"), rnd(sup_ab * 100, 2).alias("support_pct"), rnd(conf * 100, 1).alias("conf_pct"),
        ra.alias("avg_a"), rb.alias("avg_b"), "quad_a", "quad_b",
        rnd((ra + rb) * BUNDLE_DISCOUNT, 0).alias("bundle_price"),  # B7
    )
    return out.orderBy(F.col("lift").desc(), F.col("co_count").desc(), "item_a", "item_b").limit(top_n)


def live_limit(lines: DataFrame, items: DataFrame, total: int, top_n: int, share: float = 0.25) -> float | None:
    """Bills beyond which an item can be in no pair of the ``top_n``, or None.

    A pair's lift is at most ``total / max(bills of a, bills of b)``, as it can't be in more bills than
    the rarer item.  The pairs of the rarest ``share`` of the items, few rows, give a k-th best
    lift (rounded to 2 digits), which the final one can only exceed."""
    rare = items.agg(F.percentile_approx("bills", share)).first()[0]
    if rare is None:
        return None
    kth, n = _live_pairs(lines, items, total, top_n, rare).agg(F.min("lift"), F.count(F.lit(1))).first()
    return total / (kth - 0.005) * (1 + 1e-9) if n == top_n and kth > 0.005 else None


def live_basket(filtered_sales: DataFrame, top_n: int = 8) -> DataFrame:
    """B5 (+B6, B7) — basket analysis on a filtered fact (F8 applied by the caller).

    No minimum co-count; both items need qty ≥ 2 and average revenue per unit ≥ 10 (those
    item-level cuts are applied before pairing, which is exact).  Needs ≥ 2 bills.
    Support % 2dp, confidence % 1dp, lift 2dp; ordered by lift descending.

    The (bill, item) lines and the item frame are written once.  Items in too many bills for a lift
    among the best (``live_limit``) are left out before pairing, also exact.
    """
    lines = staged(bill_items(filtered_sales, keep_blank=True), "live-lines")  # bills of blank products count as bills
    per_item = staged(lines.groupBy("item").agg(
        F.sum("rev").cast("double").alias("rev"), F.sum("qty").cast("double").alias("qty"),
        F.count(F.lit(1)).alias("bills"),
    ), "live-items")
    total = lines.agg(F.count_distinct("bill")).first()[0]
    avg_unit = F.col("rev") / F.greatest(F.col("qty"), F.lit(1.0))
    enough = F.lit(total >= 2) & (F.col("qty") >= 2) & (avg_unit >= 10)
    items = per_item.filter(enough).select("item", avg_unit.alias("avg"), "bills", _live_quadrant(per_item).alias("quadrant"))
    return _live_pairs(lines, items, total, top_n, live_limit(lines, items, total, top_n))


# ── B9 ─────────────────────────────────────────────────────────────────────────
def brief_selections(matrix: DataFrame, combos: DataFrame, pairs: DataFrame) -> DataFrame:
    """B9 — top 3 Star / Dog / Puzzle by revenue, top 5 combos, top 5 pairs, as rows of
    (section, rank, item_a, item_b, value)."""
    q = top_per_quadrant(matrix, 3, ["Star", "Dog", "Puzzle"]).select(
        F.col("quadrant").alias("section"), "rank", F.col("item_name").alias("item_a"),
        F.lit(None).cast("string").alias("item_b"), F.col("total_revenue").alias("value"),
    )
    wc = Window.orderBy(F.col("lift").desc(), F.col("co_count").desc(), "item_a", "item_b")
    c = combos.select(F.lit("combo").alias("section"), F.row_number().over(wc).alias("rank"), "item_a", "item_b",
                      F.col("bundle_price").alias("value")).filter(F.col("rank") <= 5)
    p = pairs.select(F.lit("pair").alias("section"), F.row_number().over(wc).alias("rank"), "item_a", "item_b",
                     F.col("lift").alias("value")).filter(F.col("rank") <= 5)
    return q.unionByName(c).unionByName(p)
