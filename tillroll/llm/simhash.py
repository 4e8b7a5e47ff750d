"""SimHash near-dedup with pivot distance tables.

Fingerprints: words are split at ASCII white space and lower-cased in A-Z; the XXH64 (seed 42) of
every shingle of ``SHINGLE`` words, repeats included, votes on 64 bits; a bit is set if over half
have it.

Linking works on distinct fingerprints.  A table holds each one's Hamming distances to
``PIVOTS`` reference fingerprints, kept as partial distances over ``BLOCKS`` blocks of bits.  Two
fingerprints within ``bits`` differ in at most ``bits`` blocks, so they have equal partial
distances to every pivot on the others: each choice of ``BLOCKS - bits`` blocks gives a join key.
Pairs under a key are discarded if any coordinate, the full distance to a pivot, differs by
more than ``bits`` (triangle inequality); survivors are verified bit by bit.

Keys with more than ``CROWD`` fingerprints would pair quadratically; their members are linked
exactly another way: each is listed under itself and the 64 fingerprints one bit away, and those
that meet are linked.  Two fingerprints meet exactly if they are within two bits, and at most 65
can meet in one place (so this way holds for ``bits`` = 2, the limit it is used for).

Defined results: null text is empty; texts without words have fingerprint zero and link like any
other; null ids never become a component's id unless all of it are null; copies share one
fingerprint row; an empty table gives an empty result; other columns ride along untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import ROW, document_text, field, packed, release, staged, unpacked
from tillroll.llm.components import components

SHINGLE, BITS, BLOCKS, PIVOTS, CROWD = 3, 2, 5, 16, 64
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint as a signed number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    n = len(words) - k + 1
    firsts, lasts = starts[:n], ends[k - 1:]
    hash64, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(firsts[at:at + _CHUNK].tolist(), lasts[at:at + _CHUNK].tolist())
        h = np.array([hash64(joined[a:b], 42) for a, b in spans], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        release()
        return pa.array([simhash(t, shingle) for t in texts.to_pylist()], pa.int64())

    return run(text)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, spread by hashing their numbers."""
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}")) for i in range(n)]


def _blocks(blocks: int) -> list[int]:
    """Bit masks of the blocks, as equal as 64 bits allow."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [_signed((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]


def _distance(x: Column, y: int | Column, mask: int = -1) -> Column:
    y = F.lit(y) if isinstance(y, int) else y
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(mask)))


def pivot_table(nodes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``nodes`` (fp, ...) with ``partial``, per block the digest of the distances to all pivots on
    that block, and ``coords``, the full distances."""
    fp = F.col("fp")
    partial = [F.xxhash64(*[_distance(fp, p, mask) for p in pivots()]) for mask in _blocks(blocks)]
    coords = [_distance(fp, p).cast("byte") for p in pivots()]
    return nodes.withColumn("partial", F.array(*partial)).withColumn("coords", F.array(*coords))


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` within ``bits`` of each other."""
    if bits != 2:
        raise ValueError("crowded keys are linked exactly for a distance of 2 only")
    table = pivot_table(nodes.select("fp"), blocks)
    chosen = [F.xxhash64(F.lit(i), *[F.col("partial")[b] for b in some])
              for i, some in enumerate(combinations(range(blocks), blocks - bits))]
    keyed = table.select(F.explode(F.array(*chosen)).alias("key"), "fp", "coords")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(sizes, "key"), "pivot-keys")
    few = shared.where(F.col("n") <= CROWD)
    x = few.select("key", F.col("fp").alias("a"), F.col("coords").alias("ca"))
    y = few.select("key", F.col("fp").alias("b"), F.col("coords").alias("cb"))
    gaps = [F.abs(F.col("ca")[i] - F.col("cb")[i]) for i in range(PIVOTS)]
    near = (x.join(y, "key").where((F.col("a") < F.col("b")) & (F.greatest(*gaps) <= bits))
            .where(_distance(F.col("a"), F.col("b")) <= bits).select("a", "b"))
    crowd = shared.where(F.col("n") > CROWD).select("fp").distinct()
    around = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))
    spots = crowd.select(F.col("fp").alias("b"), around.alias("spot"))
    first = spots.groupBy("spot").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    met = spots.join(first, "spot").where("a < b").select("a", "b")
    return near.unionByName(met).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> fp, component_id: smallest doc_id reachable; one row per distinct fp."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-nodes")
    roots = components(links(nodes))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return staged(joined.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id."""
    prints = staged(packed(docs).select(field("doc_id").cast("long").alias("doc_id"),
                                        fingerprint(document_text(), shingle).alias("fp")), "simhash")
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (ties by
    text and fingerprint), all columns kept.

    Decisions are made on (doc_id, fingerprint, text hash) alone; texts move once, to meet them.
    """
    text = document_text()
    key = [field("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
           F.xxhash64(F.lit(1), text).alias("h2")]
    prints = staged(packed(docs).select(*key, fingerprint(text, shingle).alias("fp")), "simhash")
    best = (prints.join(classes(prints).select("fp", "root"), "fp").groupBy("root")
            .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "doc_id", "h1", "h2")).alias("k")))
    stay = best.select("k.doc_id", "k.h1", "k.h2").withColumn("stays", F.lit(True))
    rows = packed(docs).select(ROW, *key)
    same = (F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.h1") == F.col("s.h1"))
            & (F.col("r.h2") == F.col("s.h2")))
    kept = rows.alias("r").join(stay.alias("s"), same, "left_semi")
    repeats = prints.groupBy("doc_id", "h1", "h2").count().where("count > 1").limit(1).count()
    if repeats:  # rows equal in id and text: one of them stays
        kept = kept.dropDuplicates(["doc_id", "h1", "h2"])
    return unpacked(kept)
