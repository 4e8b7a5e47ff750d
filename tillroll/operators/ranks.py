"""Exact order statistics (W6) and counts over later days (W1) without a sort or an array in one task.

Values are counted, the (value, count) rows are dealt by range and written with the number of their
range.  The counts per range, a few rows, say which range holds the asked place; only that range
is put in order.  No task sees more than one range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.io import staged


def value_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Written histogram (name, value, n, part) of the non-null values of ``columns`` (name -> column);
    ``part`` numbers the ranges of (name, value) in ascending order."""
    one = [F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in columns.items()]
    counts = (df.select(F.explode(F.array(*one)).alias("x")).select("x.*").where("value IS NOT NULL")
              .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(counts.repartitionByRange(parts, "name", "value").withColumn("part", F.spark_partition_id()), "value-counts")


def upper_medians(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """W6 — one row with ``sorted(x)[len(x) // 2]`` of every column (null without values)."""
    counts = value_counts(df, columns)
    ranges: dict[str, list] = {}
    for r in counts.groupBy("name", "part").agg(F.sum("n").alias("n")).orderBy("name", "part").collect():
        ranges.setdefault(r["name"], []).append((r["part"], r["n"]))
    spots = []
    for name, parts in ranges.items():
        place = sum(n for _, n in parts) // 2
        for part, n in parts:
            if place < n:
                spots.append((name, part, place))
                break
            place -= n
    spot = df.sparkSession.createDataFrame(spots, "name string, part int, place long")
    upto = F.sum("n").over(Window.partitionBy("name").orderBy("value"))
    found = counts.join(F.broadcast(spot), ["name", "part"]).withColumn("upto", upto).where("upto > place")
    return found.agg(*[F.min(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in columns])


# day numbers are counted from 2^20 days before 1970, so they lie within (0, 2^21)
_LEVELS = 21


def _day_no(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(1 << (_LEVELS - 1))


def higher_since(days: DataFrame, back: int) -> DataFrame:
    """W1 — ``days`` (d date, rev), one row a day, with ``higher`` (days from ``back`` days before it on, later
    ones included, whose rev is higher) and ``total`` (all days from there on).

    Time is cut into blocks of 1, 2, 4, ... days.  A day lies in one block of every length, and all
    days from a given one on are at most one block of every length, so each day asks and answers
    ``_LEVELS`` times; inside a block the askers are put among the days by rev and count those
    before them.  Work is linear in the days but for a logarithm."""
    day = _day_no(F.col("d"))
    since = F.greatest(day - F.lit(back), F.lit(1))
    held = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(day, k).alias("block")) for k in range(_LEVELS)])
    from_on = [F.shiftright(since + F.lit((1 << k) - 1), k) for k in range(_LEVELS)]
    asks = F.filter(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("block")) for k, c in enumerate(from_on)]),
                    lambda x: x.block % 2 == 1)
    rows = (days.select("d", "rev", F.explode(held).alias("x"), F.lit(1).alias("is_day"))
            .unionByName(days.select("d", "rev", F.explode(asks).alias("x"), F.lit(0).alias("is_day"))))
    block = Window.partitionBy("x")
    before = block.orderBy(F.col("rev").desc(), "is_day").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("d", "is_day", F.sum("is_day").over(before).alias("higher"), F.sum("is_day").over(block).alias("total"))
    sums = counted.where("is_day = 0").groupBy("d").agg(F.sum("higher").alias("higher"), F.sum("total").alias("total"))
    return days.join(sums, "d")
