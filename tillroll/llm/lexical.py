"""Ranked lexical search over per-term posting lists cut into geometric blocks.

Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
lower-cased.  An item's score of a document sums, over the item's terms once each, the term's weight
``floor(1000 * ln((2N + 2) / (2 df + 1)))`` times the document's impact
``10^9 tf div (1000 tf + 8 m)``, where ``m`` is ``10 + 90 n N div L``: integers but for the logarithm.

Two passes.  The first counts terms and writes, per document, its length and the counts of the terms
that some item asks for (other lists would never be read); document frequencies, N and L are
aggregates of that table.  The second searches it in shards of bounded size, within its tasks.
In a shard every posting list that an item visits is clustered by document similarity (each posting
joins the nearest of evenly drawn postings, under a random projection of the documents' impacts) into
blocks, and each block stores the coordinatewise maximum of its documents' impacts.  An item goes
through its lists in order of what they can contribute; a block's bound is the sum of weight times
summary over the item's terms from this list on, as documents with an earlier term were settled in
that list.  A block is skipped only if its bound is below the item's tenth best score so far, a list if
the maximum over all its blocks is.  Projection and clusters decide what is skipped, never what is right.

A task returns at most ``TOP`` documents an item, and two steps merge them: within slices of
documents, then over the slices.  Items are searched in blocks of about ``TERMS`` terms, so that what
goes to all tasks has a bounded size however many items there are (an item stays whole).

Defined results: null texts hold no terms; items without terms and items that no document matches
get no rows; every item row is ranked on its own, also where ids repeat or are null; equal scores
go by ascending doc_id, null last; repeated rows are documents of their own; empty tables give an
empty result; other columns ride along or are left behind, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType

from tillroll.llm.common import ROW, document_text, field, packed, shared_path, staged, unpacked

TOP, TERMS = 10, 16_384
#: documents of a block at most (but for copies, which share the nearest centre); impacts of a shard
BLOCK, CELLS = 32, 1 << 24
_PROJECTION, _AT_ONCE = 32, 8
_LAST = 2**63 - 1
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


@F.arrow_udf(ArrayType(BinaryType()))
def distinct_terms(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(set(terms_of(t))) for t in texts.to_pylist()], pa.list_(pa.binary()))


def impact(tf: int, m: int) -> int:
    return 10**9 * tf // (1000 * tf + 8 * m)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Written (doc_id, n, terms, tfs) of all documents with a term: n terms with repeats, and the
    counts of those in ``vocabulary`` (its places)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = packed(docs).select(field("doc_id").cast("long").alias("doc_id"), document_text().alias("text"))

    def run(batches):
        places = known.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = [(places[t], c) for t, c in Counter(words).items() if t in places]
                sizes.append(len(words))
                terms.append([t for t, _ in found])
                tfs.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return staged(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0"), "terms")


class Shard:
    """Impacts (documents, terms) of some documents, and their posting lists in blocks."""

    def __init__(self, impacts: np.ndarray):
        self.impacts = impacts
        terms, docs = np.nonzero(impacts.T)
        self.docs, self.starts = docs, np.searchsorted(terms, np.arange(impacts.shape[1] + 1))
        self.most = impacts.max(axis=0, initial=0).astype(np.int64)
        self.places: np.ndarray | None = None
        self.lists: dict[int, tuple] = {}

    def _spots(self) -> np.ndarray:
        """Unit vectors of the documents under a random projection."""
        if self.places is None:
            signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (self.impacts.shape[1], _PROJECTION))
            spots = self.impacts.astype(np.float32) @ signs
            self.places = spots / np.maximum(np.linalg.norm(spots, axis=1, keepdims=True), 1)
        return self.places

    def blocks(self, term: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a term's list: documents by block, the blocks' borders, summaries over ``columns``."""
        if term not in self.lists:
            docs = self.docs[self.starts[term]:self.starts[term + 1]]
            if len(docs) > BLOCK:
                spots = self._spots()[docs]
                near = (spots @ spots[::BLOCK].T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                borders = np.concatenate([[0], np.flatnonzero(np.diff(near)) + 1, [len(docs)]])
            else:
                borders = np.array([0, len(docs)])
            summary = np.maximum.reduceat(self.impacts[np.ix_(docs, columns)], borders[:-1], axis=0)
            self.lists[term] = docs, borders, summary.astype(np.int64)
        return self.lists[term]


class Best:
    """The ``top`` documents of an item so far: highest score, then smallest id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.nulls = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A document that scores below this can't be among them."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        use = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[use]]), np.concatenate([self.ids, ids[use]])
        nulls = np.concatenate([self.nulls, nulls[use]])
        order = np.lexsort((nulls, ids, -scores))[:self.top]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def search(shard: Shard, ids: np.ndarray, nulls: np.ndarray, items: list[np.ndarray], weights: np.ndarray,
           columns: dict[int, np.ndarray], best: list[Best]) -> None:
    """Bring each item's best documents up to date with a shard."""
    gains = weights * shard.most
    for terms, found in zip(items, best):
        terms = terms[np.argsort(-gains[terms], kind="stable")]
        rest = gains[terms][::-1].cumsum()[::-1]
        seen = np.zeros(len(ids), bool)
        for i, term in enumerate(terms):
            if rest[i] < found.least or not shard.most[term]:
                break
            docs, borders, summary = shard.blocks(term, columns[term])
            here = np.searchsorted(columns[term], terms[i:])
            bounds = summary[:, here] @ weights[terms[i:]]
            order = np.argsort(-bounds, kind="stable")
            for at in range(0, len(order), _AT_ONCE):
                live = order[at:at + _AT_ONCE]
                live = live[bounds[live] >= found.least]
                if not len(live):
                    break
                some = np.concatenate([docs[borders[b]:borders[b + 1]] for b in live])
                some = some[~seen[some]]
                seen[some] = True
                scores = shard.impacts[np.ix_(some, terms)].astype(np.int64) @ weights[terms]
                found.add(scores, ids[some], nulls[some])


def _shards(batches, size: int, width: int, documents: int, length: int):
    """Bounded shards of (doc_id, n, terms, tfs) rows: ids, null flags and a ``Shard``."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            m = [10 + 90 * n * documents // length for n in part.column(1).to_pylist()]
            edges = part.column(2).offsets.to_numpy()
            terms, tfs = (part.column(i).values.to_numpy()[edges[0]:edges[-1]] for i in (2, 3))
            rows = np.repeat(np.arange(part.num_rows), np.diff(edges))
            impacts = np.zeros((part.num_rows, width), np.int32)
            impacts[rows, terms] = 10**9 * tfs // (1000 * tfs + 8 * np.array(m, np.int64)[rows])
            nulls = np.array(part.column(0).is_null())
            yield part.column(0).fill_null(_LAST).to_numpy(), nulls, Shard(impacts)


def _gathered(batches, size: int):
    """Record batches of at least ``size`` rows (the last one may have fewer)."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _search_block(docs: DataFrame, asked: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items ``asked`` (number, terms)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    rows = counted(docs, vocabulary)
    documents, length = rows.agg(F.count("*"), F.sum("n")).first()
    frequency = {r["term"]: r["count"] for r in  # at most as many as the vocabulary
                 rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(documents, frequency.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    items = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in asked]
    known = spark.sparkContext.broadcast((items, weights))
    numbers, width = [n for n, _ in asked], len(vocabulary)
    size = max(BLOCK, CELLS // max(width, 1))

    def run(batches):
        items, weights = known.value
        columns: dict[int, np.ndarray] = {}
        for terms in items:
            for t in terms:
                columns.setdefault(int(t), []).append(terms)
        columns = {t: np.unique(np.concatenate(some)) for t, some in columns.items()}
        best = [Best(top) for _ in items]
        for ids, nulls, shard in _shards(_gathered(batches, size), size, width, documents, length or 1):
            search(shard, ids, nulls, items, weights, columns, best)
        sizes = [len(b.scores) for b in best]
        every = lambda parts, kind: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(numbers, sizes).astype(np.int64)),
             pa.array(np.concatenate([np.zeros(0, np.int64), *[b.ids for b in best]]),
                      mask=np.concatenate([np.zeros(0, bool), *[b.nulls for b in best]])),
             every([b.scores for b in best], np.int64)], ["item", "doc_id", "score"])

    found = rows.mapInArrow(run, "item long, doc_id long, score long").withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(512)))
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for group in (["item", "slice"], ["item"]):  # a slice, then 512 slices of ``top`` rows
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col("rank") <= top)
    return found.select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, columns: list[str] | None = None, top: int = TOP,
         terms: int = TERMS) -> DataFrame:
    """The item's row (of ``columns``, all by default), rank, doc_id and score of the ``top``
    documents of every item."""
    columns = list(items.columns if columns is None else columns)
    asked = staged(packed(items).select(F.struct(*[field(c).alias(c) for c in columns]).alias(ROW),
                                        distinct_terms(document_text()).alias("terms"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms)
    path = shared_path(items, "ranked")
    schema = "item long, rank int, doc_id long, score long"
    items.sparkSession.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        mine = asked.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) & (F.size("terms") > 0)).select("item", "terms")
        some = [(r["item"], [bytes(t) for t in r["terms"]]) for r in mine.collect()]  # about ``terms`` terms
        if some:
            _search_block(docs, some, top).write.mode("append").parquet(path)
    ranked = items.sparkSession.read.schema(schema).parquet(path)
    return asked.select(ROW, "item").join(ranked, "item").select(ROW, "rank", "doc_id", "score")


def ranked_rows(ranked: DataFrame) -> DataFrame:
    """The items' columns beside rank, doc_id and score."""
    return unpacked(ranked, F.col("rank"), F.col("doc_id"), F.col("score"))
