"""Line dedup across documents.

Lines are exploded with their positions, normalised, and hashed to 128 bits; distinct
documents per hash are told apart by the smallest and largest id (two different ids mean at
least two documents), which pre-aggregates map-side however common a line is.  Lines of
repeated keys lose their positions in every document but the first holder, and the document
is put together again by position.

Defined results: null or empty text is one empty line; a null ``doc_id`` is a document of its
own that sorts before all ids; rows that share an id are one document, each put together
from its own text; an empty table gives an empty result; other columns ride along untouched.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import document_text, documents_at_once, field, packed, release, staged

BATCH = 500  # documents that go to a Python worker at once
BLANKS = b" \t\n\x0b\x0c\r"
NULL_ID = -(2**63)


def _explode(min_chars: int):
    """(d, h1, h2, text) -> a row per line whose key is long enough: position and key hash."""

    def run(batches):
        release()
        for batch in batches:
            ids, a, b, texts = (batch.column(i) for i in range(4))
            row, place, k1, k2 = [], [], [], []
            for r, text in enumerate(texts.to_pylist()):
                for pos, line in enumerate(text.encode().split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
                        continue
                    h = xxhash.xxh3_128_intdigest(key)
                    row.append(r), place.append(pos)
                    k1.append((h >> 64) - 2**63), k2.append((h & (2**64 - 1)) - 2**63)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), a.take(at), b.take(at), pa.array(place, pa.int32()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64())], ["d", "h1", "h2", "pos", "k1", "k2"])

    return run


def _identity(text: Column) -> list[Column]:
    """A row's own key beside its id: two seeded hashes of its text."""
    return [F.coalesce(field("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"),
            F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every countable line: document, row hashes, position, 128-bit key hash."""
    text = document_text()
    return (packed(docs).select(*_identity(text), text.alias("t"))
            .mapInArrow(_explode(min_chars), "d long, h1 long, h2 long, pos int, k1 long, k2 long"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` rows plus ``n_lines``, ``n_dropped`` and ``kept_text`` under column ``lines``
    (a struct, so that it clashes with nothing); the row itself is the struct ``__row``."""
    with documents_at_once(docs.sparkSession, BATCH):
        lines = staged(line_keys(docs, min_chars), "line-keys")
    repeated = (lines.groupBy("k1", "k2").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
                .where("first_d <> last_d").select("k1", "k2", "first_d"))
    drops = (lines.join(repeated, ["k1", "k2"]).where("d <> first_d")
             .groupBy("d", "h1", "h2").agg(F.collect_set("pos").alias("drops")))
    text = document_text()
    rows = packed(docs).select("*", *_identity(text)).join(drops, ["d", "h1", "h2"], "left")
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops"))
    kept_text = F.when(F.col("drops").isNull(), text).otherwise(
        F.array_join(F.transform(kept, lambda p: F.get(F.col("parts"), p)), "\n"))
    return (rows.withColumn("parts", parts)
            .select("__row", F.struct(F.size("parts").cast("long").alias("n_lines"),
                                      F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
                                      kept_text.alias("kept_text")).alias("lines")))
