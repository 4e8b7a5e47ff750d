"""Language ID by prediction by partial matching (PPM).

Per language an order-3 byte context tree is counted on a bounded training sample and frozen.
A byte costs -log2 of its probability under the longest context of up to three bytes that the
language has seen; a symbol new to a context pays the escape (distinct symbols over symbols plus
distinct symbols, method C, no exclusion) and is coded one order shorter, down to a uniform byte.
Every text starts behind three zero bytes.  The language with the shortest exact code length of
the whole text wins.

Costs are tabled for every context and symbol that any language has seen, so a text is scored
by array lookups; what no language has seen falls through to the escape tables.

Training sample: at most ``DOCS`` pieces of ``PIECE`` code points per language, one from each
document drawn by hash, for every language of the training folds.  Languages are counted in groups
(``TABLE``), each with tables of its own, so the model grows with the languages and not their square.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything when
nothing was learned; equal code lengths go to the language first in order; repeated rows are
predicted alike; an empty table gives an empty result; other columns ride along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import document_text, field, fold_of, on_workers, packed, release, staged

DOCS, PIECE = 256, 8192
#: pieces times languages that share tables at most
TABLE = 1 << 14
FOLDS, HELD = 4, 2
#: bytes of text whose code lengths are weighed at most when two languages are compared for the score
EVIDENCE = 64
_LETTER = regex.compile(r"\p{L}")


def windows(data: bytes) -> np.ndarray:
    """For each byte, it and the three before it as one big-endian number."""
    d = np.frombuffer(b"\0\0\0" + data, np.uint8).astype(np.uint32)
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


class Ppm:
    """Frozen cost tables of all languages; ``bits(data)`` is the code length in each."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        grams = [[np.unique(np.concatenate([windows(t) for t in samples[lang]] or [np.zeros(0, np.uint32)])
                            & np.uint32(256 ** (k + 1) - 1), return_counts=True) for k in range(4)] for lang in self.langs]
        n = len(self.langs)
        self.block = max(1 << 14, (1 << 21) // max(1, n))
        below = np.full((256, n), 8.0)  # order -1: a uniform byte
        keys, self.tables = np.arange(256, dtype=np.uint32), []
        for k in range(4):
            contexts = np.unique(np.concatenate([g[k][0] >> 8 for g in grams])) if n else keys[:0]
            seen = np.unique(np.concatenate([g[k][0] for g in grams])) if n else keys[:0]
            escape = np.zeros((len(contexts), n))
            cost = np.zeros((len(seen), n))
            for i in range(n):
                own, counts = grams[i][k]
                at = np.searchsorted(contexts, own >> 8)
                total = np.bincount(at, counts, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts)).astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, i] = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)
                shorter = self._shorter(seen, k)[:, i] if k else np.full(len(seen), 8.0)
                cost[:, i] = escape[np.searchsorted(contexts, seen >> 8), i] + shorter
                cost[np.searchsorted(seen, own), i] = -np.log2(counts / (total + kinds)[at])
            self.tables.append((contexts, escape, seen, cost))

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Cost of each symbol one order below ``k``."""
        return self.costs(keys & np.uint32(256 ** k - 1), k - 1)

    def costs(self, keys: np.ndarray, k: int = 3) -> np.ndarray:
        """Bits of each (context of k bytes, symbol) in every language."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        contexts, escape, seen, cost = self.tables[k]
        at = np.minimum(np.searchsorted(seen, keys), max(0, len(seen) - 1))
        hit = seen[at] == keys if len(seen) else np.zeros(len(keys), bool)
        if hit.all():
            return cost[at]
        out = np.empty((len(keys), len(self.langs)))
        out[hit] = cost[at[hit]]
        rest = keys[~hit]
        low = self._shorter(rest, k)
        if len(contexts):
            c = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
            known = contexts[c] == rest >> 8
            low[known] += escape[c[known]]
        out[~hit] = low
        return out

    def bits(self, data: bytes) -> np.ndarray:
        keys, total = windows(data), np.zeros(len(self.langs))
        for at in range(0, len(keys), self.block):
            total += self.costs(keys[at:at + self.block]).sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        data = text.encode()
        bits = self.bits(data)
        best = int(bits.argmin())
        odds = np.exp2((bits[best] - bits) * min(1.0, EVIDENCE / len(data)))
        return self.langs[best], float(1 / odds.sum())


class Panel(Ppm):
    """Models of several groups of languages side by side."""

    def __init__(self, parts: list[Ppm]):
        self.parts, self.langs = parts, [lang for part in parts for lang in part.langs]

    def bits(self, data: bytes) -> np.ndarray:
        return np.concatenate([part.bits(data) for part in self.parts])


def groups(sizes: dict[str, int]) -> list[list[str]]:
    """Languages in order, parted so that pieces times languages stay within ``TABLE``."""
    found, pieces = [[]], 0
    for lang in sorted(sizes):
        more = min(DOCS, sizes[lang])
        if found[-1] and (pieces + more) * (len(found[-1]) + 1) > TABLE:
            found.append([])
            pieces = 0
        found[-1].append(lang)
        pieces += more
    return found


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, FOLDS) == HELD


def fit(docs: DataFrame) -> Ppm:
    """Count the trees on a bounded sample of documents outside the held-out fold."""
    spark = docs.sparkSession
    train = (packed(docs).select(field("doc_id").alias("doc_id"), field("lang").cast("string").alias("lang"),
                                 document_text().alias("text"))
             .where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))))
    sizes = train.groupBy("lang").count().collect()
    if not sizes:
        return Ppm({})
    shares = spark.createDataFrame([(r["lang"], min(1.0, 4 * DOCS / r["count"])) for r in sizes], "lang string, share double")
    draw = F.xxhash64(F.lit(5), "doc_id")
    drawn = train.join(F.broadcast(shares), "lang").withColumn("draw", draw).where(
        F.pmod("draw", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    room = F.greatest(F.lit(1), F.length("text") - PIECE + 1)
    piece = F.substring("text", (F.pmod(F.xxhash64("draw"), room) + 1).cast("int"), F.lit(PIECE))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    rows = (drawn.select("lang", "draw", "doc_id", piece.alias("piece")).withColumn("place", place)
            .where(F.col("place") <= DOCS).select("lang", "piece"))
    parted = groups({r["lang"]: r["count"] for r in sizes})
    if len(parted) == 1:
        return _count(rows)
    rows = staged(rows, "language-samples")
    return Panel([_count(rows.where(F.col("lang").isin(part))) for part in parted])


def _count(rows: DataFrame) -> Ppm:
    samples: dict[str, list[bytes]] = {}
    for r in rows.collect():
        samples.setdefault(r["lang"], []).append(r["piece"].encode())
    return Ppm(samples)


def predict(docs: DataFrame, model: Ppm) -> DataFrame:
    """``__row`` (the document) with ``lang_pred`` and ``score`` beside it."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(text: pa.Array) -> pa.Array:
        release()
        found = [shared.value.predict(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                           pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return packed(docs).withColumn("lang", run(field("text").cast("string"))).select("__row", "lang.*")
