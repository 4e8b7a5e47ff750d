"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget of words by weight; a target stops at ``MOST`` times its source's size and
the excess is shared again by weight until none is above.  A source's documents are taken as many
whole times as the target allows, and a subset of them once more for the rest of the budget:
documents are counted by exact length, every length gives the same fraction of its documents
(floors), and what the floors leave is fitted by bounded-knapsack dynamic programming over the
lengths that still have documents.  Of each length the documents with the smallest seeded hash are
taken, so only counts per length, never documents, meet in one place, and reruns agree.

What one task holds is the length counts of one source, at most sqrt(2 * words) of them.  Which
documents are taken is settled by counts per (source, length, leading 16 bits of the hash): only in
the one slot that holds the border are documents put in order.

Defined results: null texts have no words; null and empty sources are two sources, null the last;
sources without words have target 0; repeated rows are documents of their own, told apart
arbitrarily; if no subset meets a target exactly the nearest reachable sum is taken, the lesser of
two equally near (for what is left below ``EXACT`` words; above it the floors and one document of each
length, largest remainder first, go before); an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from tillroll.llm.common import ROW, document_text, field, packed, shuffle_partitions, staged, unpacked

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), (3, 2), 2, 42
#: words of remaining budget that dynamic programming covers
EXACT = 1 << 14
_BIG = "decimal(38,0)"


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Maximal runs of bytes other than ASCII white space."""
    return pa.array([len(t.encode().split()) for t in texts.to_pylist()], pa.int64())


def sized(docs: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """Written table (row, source, size, slot, key) of all documents."""
    key = F.xxhash64(F.lit(seed), field("doc_id"), field("source"), document_text())
    return staged(packed(docs).select(F.struct(*[field(c).alias(c) for c in columns]).alias(ROW),
                                      field("source").cast("string").alias("source"),
                                      word_count(document_text()).alias("size"), key.alias("key"))
                  .withColumn("slot", F.shiftrightunsigned("key", 48).cast("int")), "sized")


def weighted(totals: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``totals`` (source, words) with ``weight``: the given ones in turn, sources by code point and
    null last.  Places come from counts per range of sources, so no task sees all of them."""
    ranged = totals.repartitionByRange(shuffle_partitions(totals), F.col("source").asc_nulls_last())
    put = staged(ranged.sortWithinPartitions(F.col("source").asc_nulls_last())
                 .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranges")
    before, starts = 0, []
    for r in put.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("low")).orderBy("part").collect():
        starts.append((r["part"], before - r["low"]))  # as many rows as ranges
        before += r["n"]
    shift = put.sparkSession.createDataFrame(starts, "part int, shift long")
    put = put.join(F.broadcast(shift), "part").withColumn("place", F.col("at") + F.col("shift"))
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    return put.select("source", "words", F.get(turn, (F.col("place") % len(weights)).cast("int")).alias("weight"))


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, most: int = MOST) -> DataFrame:
    """Written (source, words, target): targets by weight, capped at ``most`` times the words, in exact
    integer comparisons; a round caps all that are above and shares the rest again."""
    open_ = staged(weighted(totals, weights), "weights")
    budget = (open_.agg(F.sum(F.col("words").cast(_BIG))).first()[0] or 0) * share[0]  # in units of 1 / share[1]
    done = []
    while True:
        weight = open_.agg(F.sum("weight")).first()[0] or 1
        over = (F.col("words") * F.lit(most * share[1])).cast(_BIG) * F.lit(weight) < F.col("weight").cast(_BIG) * F.lit(budget).cast(_BIG)
        capped = open_.where(over)
        taken = capped.agg(F.sum(F.col("words").cast(_BIG))).first()[0]
        if taken is None:
            break
        done.append(capped.select("source", "words", (F.col("words") * most).cast("double").alias("target")))
        open_ = staged(open_.where(~over), "weights")
        budget -= taken * most * share[1]
    rest = open_.select("source", "words", (F.col("weight").cast("double") * F.lit(float(budget))
                                            / F.lit(float(weight * share[1]))).alias("target"))
    for part in done:
        rest = rest.unionByName(part)
    return staged(rest, "targets")


def _nearest_sum(left: dict[int, int], budget: int) -> dict[int, int]:
    """Copies per length, within ``left``, whose words come nearest to ``budget`` (at most ``EXACT``):
    bounded knapsack over the bits of reachable sums, counts split into powers of two."""
    limit = 2 * budget + 1  # a sum above twice the budget is farther than none at all
    mask, reach, steps = (1 << limit) - 1, 1, []
    for length, n in left.items():
        copies, n = 1, min(n, limit // length)
        while n > 0 and not reach >> budget & 1:
            now = min(copies, n)
            new = reach << now * length & mask & ~reach
            if new:
                steps.append((length, now, new))
                reach |= new
            copies, n = copies * 2, n - now
    at = min((s for s in _bits_near(reach, budget)), key=lambda s: (abs(s - budget), s))
    found: dict[int, int] = {}
    for length, now, new in reversed(steps):
        if new >> at & 1:
            found[length] = found.get(length, 0) + now
            at -= now * length
    return found


def _bits_near(reach: int, budget: int):
    """The highest reachable sum up to the budget and the lowest above it."""
    yield (reach & (1 << budget + 1) - 1).bit_length() - 1
    above = reach >> budget + 1
    if above:
        yield budget + (above & -above).bit_length()


def fit_lengths(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take for ``budget`` words."""
    counts = {length: n for length, n in sorted(counts.items()) if length > 0}
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return counts
    take = {length: n * budget // total for length, n in counts.items()}
    rest = budget - sum(length * n for length, n in take.items())
    by_remainder = sorted(counts, key=lambda length: (-(counts[length] * budget % total), length))
    moved = True
    while rest > EXACT and moved:
        moved = False
        for length in by_remainder:
            if EXACT < rest and length <= rest and take[length] < counts[length]:
                take[length] += 1
                rest -= length
                moved = True
    left = {length: counts[length] - take[length] for length in by_remainder if take[length] < counts[length]}
    if rest > EXACT:  # no document left is that short: none more, or the shortest for some of the taken
        low = min(left)
        fall = _nearest_sum({length: n for length, n in take.items() if n}, low - rest) if 0 < low - rest <= EXACT else {}
        if abs(low - rest - sum(length * n for length, n in fall.items())) >= rest:
            return take
        return {length: n - fall.get(length, 0) + (length == low) for length, n in take.items()}
    more = _nearest_sum({length: n for length, n in left.items() if length <= 2 * rest}, rest)
    fitted = {length: n + more.get(length, 0) for length, n in take.items()}
    short = budget - sum(length * n for length, n in fitted.items())
    if short and budget <= EXACT:  # small enough to fit all of it, floors set aside
        whole = _nearest_sum({length: counts[length] for length in by_remainder if length <= 2 * budget}, budget)
        if abs(budget - sum(length * n for length, n in whole.items())) < abs(short):
            return whole
    return fitted


def _fit_source(part: pd.DataFrame) -> pd.DataFrame:
    """(source, size, n, words, target) of one source -> with ``passes`` and ``extra`` per length."""
    words, target = int(part["words"].iloc[0]), int(part["target"].iloc[0])
    passes, rest = divmod(target, words) if words else (0, 0)
    extra = fit_lengths(dict(zip(part["size"].tolist(), part["n"].tolist())), rest)
    return part.assign(passes=passes, extra=[extra.get(s, 0) for s in part["size"].tolist()])[
        ["source", "size", "words", "target", "passes", "extra"]]


def _same(a: str, b: str, *columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return test


def mix(docs: DataFrame, columns: list[str] | None = None, weights: tuple = WEIGHTS, share: tuple = SHARE,
        most: int = MOST, seed: int = SEED) -> DataFrame:
    """Row (of ``columns``, all by default), source, size, source_size, target, copies (times that
    the mix takes the document) and taken (its words in the mix); one row per document."""
    rows = sized(docs, list(docs.columns if columns is None else columns), seed)
    slots = staged(rows.groupBy("source", "size", "slot").agg(F.count("*").alias("n")), "slots")
    lengths = staged(slots.groupBy("source", "size").agg(F.sum("n").alias("n")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = targets(totals, weights, share, most)
    counted = lengths.alias("l").join(goal.alias("g"), _same("l", "g", "source")).select("l.*", "words", "target")
    fitted = counted.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, words long, target double, passes long, extra long")
    return _select(rows, slots, staged(fitted, "fitted"))


def _select(rows: DataFrame, slots: DataFrame, fitted: DataFrame) -> DataFrame:
    """Deal each length's ``extra`` to its documents in the order of (slot, key)."""
    group = Window.partitionBy("source", "size").orderBy("slot")
    dealt = (slots.alias("s").join(fitted.alias("f"), _same("s", "f", "source", "size"))
             .select("s.*", "words", "target", "passes", "extra")
             .withColumn("before", F.sum("n").over(group.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("due", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.coalesce("before", F.lit(0))))))
    cut = (rows.alias("r").join(dealt.alias("d"), _same("r", "d", "source", "size", "slot"))
           .select("r.*", "words", "target", "passes", "due", "n"))
    place = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("key"))
    border = (F.col("due") > 0) & (F.col("due") < F.col("n"))
    settled = cut.where(~border).withColumn("more", (F.col("due") > 0).cast("long"))
    placed = (cut.where(border).withColumn("place", place)
              .withColumn("more", (F.col("place") <= F.col("due")).cast("long")).drop("place"))
    return settled.unionByName(placed).select(
        ROW, "source", "size", F.col("words").alias("source_size"), "target",
        (F.col("passes") + F.col("more")).alias("copies"),
        (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken"))


def mixed_documents(mixed: DataFrame) -> DataFrame:
    """The rows of the mix themselves, each as many times as it is taken."""
    return unpacked(mixed.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))
