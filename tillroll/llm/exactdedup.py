"""Exact document dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z.  Digests (SHA-256 of the folded
UTF-8 text) are written once as a narrow table.  Misra-Gries summaries, one per task,
find every digest that may hold more than ``1 / counters`` of the rows; their exact counts
and winners are verified on the whole table and broadcast (at most ``counters + 1`` rows),
so members of large groups are settled where they lie.  All other digests go through an
ordinary shuffle on the digest, where no group can hold more than ``1 / counters`` of the rows.

Defined results: null text counts as empty; of equal texts the largest ``doc_id`` stays
(null ids lose to any other); rows equal in both id and text are one group of which exactly
one row stays; an empty table gives an empty result; other columns ride along untouched.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from tillroll.llm.common import ROW, document_text, documents_at_once, field, packed, release, staged, unpacked

COUNTERS = 2000
BATCH = 500  # documents that go to a Python worker at once


@F.arrow_udf(BinaryType())
def folded_digest(text: pa.Array) -> pa.Array:
    release()
    return pa.array([hashlib.sha256(t.encode().lower()).digest() for t in text.to_pylist()], pa.binary())


# as if not deterministic: else the filter for digests that aren't null, which joins add, takes each digest a second
# time, in a second Python worker of the same task
folded_digest = folded_digest.asNondeterministic()


def _trim(counts: Counter, counters: int) -> Counter:
    """Misra-Gries reduction: take the (k+1)-th largest count from all, keep what is positive."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates ``(digest, low)``: every digest above ``rows / counters`` is among them.

    A task's summary undercounts by at most its rows / (counters + 1), hence the summed
    counts by at most rows / (counters + 1); keeping sums above that loses no frequent digest
    and, as all sums together are at most the row count, keeps at most ``counters + 1`` digests.
    """

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = _trim(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    rows = digests.count()
    twice = 2 * counters  # undercount of 1/(2k+1) leaves every digest above 1/k well over the cut
    counters = twice
    return (digests.select("digest").mapInArrow(summarise, "digest binary, low long")
            .groupBy("digest").agg(F.sum("low").alias("low"))
            .where(F.col("low") * (counters + 1) >= F.lit(rows)))


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Verified ``(digest, keep_id, group_size)`` of the frequent digests: exact counts."""
    found = staged(misra_gries(digests, counters).select("digest"), "frequent-digests")
    exact = (digests.join(F.broadcast(found), "digest").groupBy("digest")
             .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return staged(exact, "heavy-winners")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary SHA-256)."""
    with documents_at_once(docs.sparkSession, BATCH):
        digests = staged(packed(docs).select(field("doc_id").cast("long").alias("doc_id"),
                                             folded_digest(document_text()).alias("digest"))
                         .withColumn("uid", F.monotonically_increasing_id()), "digests")
    heavy = heavy_winners(digests, counters)
    settled = digests.join(F.broadcast(heavy), "digest", "left")
    light = settled.where(F.col("group_size").isNull())
    group = Window.partitionBy("digest")
    first = group.orderBy(F.desc_nulls_last("doc_id"), "uid")
    light = light.select("doc_id", F.max("doc_id").over(group).alias("keep_id"),
                         F.count("*").over(group).alias("group_size"),
                         (F.row_number().over(first) == 1).alias("kept"), "digest")
    # repeated rows of a winner tie on the id: the smallest uid of them stays
    winners = (digests.join(F.broadcast(heavy), "digest")
               .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .groupBy("digest").agg(F.min("uid").alias("keep_uid")))
    hot = (settled.where(F.col("group_size").isNotNull()).join(F.broadcast(winners), "digest")
           .select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "digest"))
    return light.unionByName(hot)


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept.

    Members of heavy groups are filtered map-side against the broadcast winners; only the
    rest is shuffled with its text, by digest.
    """
    rows = packed(docs).withColumn("digest", folded_digest(document_text()))
    digests = staged(rows.select(field("doc_id").cast("long").alias("doc_id"), "digest"), "digests")
    heavy = heavy_winners(digests, counters)
    settled = rows.join(F.broadcast(heavy), "digest", "left")
    hot = (settled.where(F.col("group_size").isNotNull() & field("doc_id").cast("long").eqNullSafe(F.col("keep_id")))
           .dropDuplicates(["digest"]))
    order = Window.partitionBy("digest").orderBy(F.desc_nulls_last(field("doc_id").cast("long")))
    light = (settled.where(F.col("group_size").isNull())
             .withColumn("place", F.row_number().over(order)).where("place = 1"))
    return unpacked(light.select(ROW).unionByName(hot.select(ROW)))
