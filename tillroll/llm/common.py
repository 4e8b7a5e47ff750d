"""Helpers shared by the training-data operators.

Every operator packs the caller's row into one struct column (``ROW``) before it adds
columns of its own, so extra or clashing column names in the input never matter.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.session import checkpoint_dir

ROW = "__row"
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def on_workers(spark: SparkSession) -> None:
    """Python workers import this package by name: put its folder on their path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _HOME])


def packed(df: DataFrame) -> DataFrame:
    """One struct column holding the whole input row."""
    on_workers(df.sparkSession)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(f"{ROW}.`{name}`")


def unpacked(df: DataFrame, *extra: Column) -> DataFrame:
    return df.select(f"{ROW}.*", *extra)


def shared_path(df_or_spark, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and several consumers see the very same rows."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def document_text(column: str = "text") -> Column:
    """Text of a packed document, null as empty."""
    return F.coalesce(field(column).cast("string"), F.lit(""))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id modulo ``parts``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def with_group_sum(rows: DataFrame, key: str, value: str, name: str, parts: int = 1000) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over equal ``key`` (nulls together; null where it
    passes 64 bits).  Keys of more than ``1 / parts`` of the rows, fewer than ``parts``, get theirs by
    a broadcast; only the rest is shuffled."""
    sums = staged(rows.groupBy(F.col(key).alias("k")).agg(F.try_sum(value).alias(name), F.count("*").alias("of")),
                  "group-sums")
    total = sums.agg(F.sum("of")).first()[0] or 0
    hot, cool = (sums.where(F.col("of") * parts > total), sums.where(F.col("of") * parts <= total))
    near = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("k")), "left")
    far = near.where("of IS NULL").drop("k", name, "of").join(cool, F.col(key).eqNullSafe(F.col("k")))
    return near.where("of IS NOT NULL").drop("k", "of").unionByName(far.drop("k", "of"))


_held: dict = {}


def held(name: str, make):
    """The one large object (an encoder) that this worker process keeps between tasks: made when
    missing, in place of any other."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Drop what ``held`` keeps: work that has no use for it calls this first, as workers are reused."""
    _held.clear()


@contextmanager
def documents_at_once(spark: SparkSession, rows: int):
    """While this lasts, at most ``rows`` rows (fewer where the session says so) go to a Python worker at once:
    what a batch of long texts holds, in the executor and in the worker, stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sliced(batches, rows: int):
    """Record batches of at most ``rows`` rows: what is made of a batch at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_bytes(batches, column: int, size: int):
    """Parts of the record batches whose strings in ``column`` make up about ``size`` bytes, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            yield batch.slice(at, to - at)


class Memo(dict):
    """Bounded memo of ``make``: when full, the older half goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            for old in list(islice(self, self.limit // 2)):
                del self[old]
        self[key] = value = self.make(key)
        return value
