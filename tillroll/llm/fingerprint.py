"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every window of three bytes is hashed to one of 256 buckets; a bucket is encoded in two bits
by how many of the three quartiles of all bucket counts it exceeds, behind one byte for the
length (an eighth of an octave per step) and one for the ratios of the quartiles.  Two
digests compare by a difference score bounded by ``BOUND``; likeness is one minus its share.

Successive documents (descending id) are neighbours inside range-sorted partitions; the rows
at partition edges are written along with the results, and only these are joined.

Defined results: null text is empty; texts of fewer than three bytes have empty buckets;
null ids come last, rows of one id follow each other by text; a table of one row has itself as
its next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.llm.common import document_text, field, packed, shuffle_partitions, staged

BUCKETS = 256
BOUND = 512
_BLOCK = 1 << 20
#: difference of two 2-bit codes; opposite quartiles count double
_STEP = np.array([0, 1, 2, 6], np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(raw) - 2), _BLOCK):
        d = raw[at:at + _BLOCK + 2].astype(np.uint32)
        h = (d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(24)
        counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """Length byte, ratio byte, 64 bytes of 2-bit bucket codes."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(q) for q in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]])
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = (q1 * 15 // q3) << 4 | q2 * 15 // q3 if q3 else 0
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    return bytes((length, ratios)) + (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).tobytes()


def _codes(d: bytes) -> np.ndarray:
    body = np.frombuffer(d, np.uint8, offset=2)
    return np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=1).ravel().astype(np.int64)


def difference(a: bytes, b: bytes) -> int:
    """Bucket differences, plus the gaps in length and quartile ratios; at most ``BOUND``."""
    if a == b:
        return 0
    body = int(_STEP[np.abs(_codes(a) - _codes(b))].sum())
    ratio = abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return min(BOUND, body + 2 * min(16, abs(a[0] - b[0])) + 2 * ratio)


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / BOUND


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the next document's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = ("kind string, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double, text string")
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
          pa.float64(), pa.string()]


def _compare(doc_id, text, own, following, next_own) -> tuple:
    edited = edit(text, following).encode()
    other = digest(edited)
    return ("row", None, doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), other.hex(),
            likeness(own, other), likeness(own, next_own), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _neighbours(batches):
    """Compare each row of a sorted partition with the one after it; pass on the edge rows."""
    pid = last = None
    for batch in batches:
        rows = []
        for p, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = digest(text.encode())
            if last is None:
                pid = p
                rows.append(("head", p, doc_id, None, None, None, None, None, None, text))
            else:
                rows.append(_compare(*last, text, own))
            last = (doc_id, text, own)
        yield _batch(rows)
    if last is not None:
        yield _batch([("tail", pid, last[0], None, None, None, None, None, None, last[1])])


def _edges(batches):
    for batch in batches:
        yield _batch([_compare(doc_id, text, digest(text.encode()), following, digest(following.encode()))
                      for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = packed(docs).select(field("doc_id").cast("long").alias("doc_id"), document_text().alias("text"))
    ordered = (rows.repartitionByRange(shuffle_partitions(docs), F.desc_nulls_last("doc_id"))
               .sortWithinPartitions(F.desc_nulls_last("doc_id"), "text"))
    found = staged(ordered.select(F.spark_partition_id().alias("pid"), "doc_id", "text")
                   .mapInArrow(_neighbours, _SCHEMA), "fingerprints")
    heads = found.where("kind = 'head'").select(F.col("pid").alias("next_pid"), F.col("text").alias("following"))
    # one short row per partition: which partition with rows comes next, the first after the last
    pids = found.where("kind = 'head'").select("pid")
    ring = pids.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")),
                                         F.min("pid").over(Window.partitionBy())).alias("next_pid"))
    tails = found.where("kind = 'tail'").select("pid", "doc_id", "text").join(ring, "pid").join(heads, "next_pid")
    closed = tails.select("doc_id", "text", "following").mapInArrow(_edges, _SCHEMA)
    return found.where("kind = 'row'").unionByName(closed).drop("kind", "pid", "text")
