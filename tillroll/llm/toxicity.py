"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs and digit substitutions to Latin letters,
punctuation to single spaces.  The lexicon holds word stems (matched at word starts) and whole
words with weights; hits inside an exception phrase do not count.  A text's weight is the sum
over hit words, normalised by the logarithm of its length in words, and its score is
``z / (z + t)`` with the threshold ``t`` learned beside the lexicon.

Learning uses a bounded sample of labelled rows outside the held-out fold: at most ``TOXIC`` toxic
and ``CLEAN`` clean documents, whole texts.  Stems enter by the distinct contexts (word with both
neighbours, so that copies count once) that they have in toxic and in clean texts: the log-likelihood
ratio must be beyond chance, and the weight is the log odds.  Every stem that passes enters, however
few its contexts; their number is bounded by the sample alone.

Defined results: null and empty texts score 0; null labels or ids are not learned from; a document
labelled twice counts with its larger label; without toxic labels the seed lexicon decides alone;
repeated rows score alike; an empty table gives an empty result; other columns ride along.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import document_text, field, fold_of, on_workers, packed, release, sliced, staged

FOLDS, HELD = 5, 0
TOXIC, CLEAN = 2000, 6000
STEM = (3, 10)
ODDS = 2.0

# General insults that hold before any label is seen, with their weight.
SEEDS = ("asshole bastard bitch dumbass idiot imbecile jerk loser moron pathetic retard scum stupid worthless").split()
SEED_WEIGHT = 6.0
# Harmless phrases around lexicon words.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "stupid question",
              "idiot proof", "jerk chicken", "pathetic fallacy")
# Letters and signs that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_TABLE = str.maketrans(
    {c: " " for c in map(chr, range(128)) if not c.isalnum()} | {c: " " for c in "«»¿¡“”„‘’‚…–—·•"}
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {c: None for c in "­​‌‍⁠﻿"}
    | LOOKALIKES)


def fold(text: str) -> str:
    """Folded words, one space around each."""
    return " " + " ".join(text.lower().translate(_TABLE).split()) + " "


class Lexicon:
    """``entries``: key (`` stem`` or `` word ``) -> weight; ``threshold``: weight at score 0.5."""

    def __init__(self, entries: dict[str, float], threshold: float = 0.25, exceptions=EXCEPTIONS):
        self.entries, self.threshold, self.exceptions = entries, threshold, tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for key, weight in self.entries.items():
                a.add_word(key, (len(key), weight))
            for phrase in self.exceptions:
                a.add_word(fold(phrase), (len(fold(phrase)), None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str) -> float:
        """Length-normalised weight of the hits outside exception phrases."""
        folded = fold(text)
        hits: dict[int, float] = {}
        quiet: set[int] = set()
        if len(self.automaton):
            for end, (size, weight) in self.automaton.iter(folded):
                at = end - size + 1
                if weight is None:
                    quiet.update(range(at, end))
                else:
                    hits[at] = max(weight, hits.get(at, 0.0))
        total = sum(weight for at, weight in hits.items() if at not in quiet)
        return total / math.log2(2 + folded.count(" "))

    def score(self, text: str) -> float:
        z = self.weigh(text)
        return z / (z + self.threshold)


SEEDED = {f" {w}": SEED_WEIGHT for w in SEEDS}


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, FOLDS) == HELD


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the drawn documents, one row an id (of several the least text): a
    bounded id list, broadcast to the scan."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(9), "doc_id")
    drawn = known.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(CLEAN))
    drawn = drawn.select(F.col("doc_id").alias("drawn_id"), "toxic")
    rows = packed(docs).select(field("doc_id").cast("long").alias("doc_id"), document_text().alias("text"))
    return (rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn_id"))
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def _contexts(batches):
    for batch in sliced(batches, 64):
        words, seen, toxic = [], [], []
        for label, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = fold(text).split()
            for before, word, after in zip(["", *own], own, [*own[1:], ""]):
                words.append(word), toxic.append(label)
                seen.append(xxhash.xxh64_intdigest(f"{before} {word} {after}") - 2**63)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(seen, pa.int64()),
                                          pa.array(toxic, pa.int32())], ["word", "context", "toxic"])


def _beyond(kinds: int) -> float:
    """The log-likelihood ratio that chance alone hardly reaches among ``kinds`` features."""
    return 2 * (math.log(max(kinds, 2)) + 1)


def _ratio(toxic: int, clean: int) -> Column:
    """Log-likelihood ratio of a feature with ``t`` toxic and ``c`` clean contexts out of all."""
    t, c, rate = F.col("t").cast("double"), F.col("c").cast("double"), toxic / (toxic + clean)
    rest = F.when(c > 0, c * (F.log(c) - F.log(t + c) - F.lit(math.log1p(-rate) if clean else 0.0))).otherwise(0.0)
    return 2 * (t * (F.log(t) - F.log(t + c) - F.lit(math.log(rate))) + rest)


def _choose(features: list, toxic: int, clean: int, kinds: int) -> dict[str, float]:
    """Entries from (feature, n_toxic, n_clean) by log-likelihood ratio: the strongest form of each
    stem, if it is beyond chance among ``kinds`` features and at least ``ODDS`` in its log odds."""
    rate, strong = toxic / max(1, toxic + clean), []
    for f, t, c in features:
        odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        ratio = 2 * (t * math.log(t / ((t + c) * rate)) + (c * math.log(c / ((t + c) * (1 - rate))) if c else 0))
        if odds >= ODDS and ratio >= _beyond(kinds):
            strong.append((-round(ratio, 6), f.endswith(" "), -len(f), f, odds))
    kept: dict[str, float] = {}
    below: set[str] = set()  # beginnings of what is kept, as long as a stem can be
    for *_, f, odds in sorted(strong):
        begins = {f[:n] for n in range(1, STEM[1] + 2)}
        if f not in below and begins.isdisjoint(kept):
            kept[f] = odds
            below |= begins
    return kept


def _threshold(pairs: list[tuple[float, int]]) -> float:
    """The weight that separates the labels best (F1), half way down to the next smaller one."""
    pairs = sorted(pairs, reverse=True)
    positives, hit, best, t = sum(label for _, label in pairs), 0, 0.0, 0.25
    for n, (z, label) in enumerate(pairs, 1):
        hit += label
        lower = pairs[n][0] if n < len(pairs) else 0.0
        if z > lower and (f1 := 2 * hit / (n + positives)) > best:
            best, t = f1, (z + lower) / 2
    return max(t, 1e-6)


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    spark = docs.sparkSession
    on_workers(spark)
    sample = staged(_sample(docs, labels).select("toxic", "text"), "toxicity-sample")
    words = (sample.mapInArrow(_contexts, "word string, context long, toxic int").distinct()
             .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.length("word"), F.lit(STEM[1]))),
                        lambda n: F.concat(F.lit(" "), F.substring("word", F.lit(1), n)))
    keys = F.when(F.length("word") >= STEM[0], stems).otherwise(F.array(F.concat(F.lit(" "), "word", F.lit(" "))))
    whole = F.when(F.length("word") > STEM[1], F.array(F.concat(F.lit(" "), "word", F.lit(" "))))
    features = (words.select(F.explode(F.concat(keys, F.coalesce(whole, F.array()))).alias("f"), "t", "c")
                .groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    size = words.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n")).first()
    if not size["t"]:
        return Lexicon(SEEDED)
    toxic, clean, kinds = size["t"], size["c"], 6 * size["n"]
    found = (features.where((F.col("t") > 0) & (F.col("t") * clean >= math.exp(ODDS) * F.col("c") * toxic))
             .where(_ratio(toxic, clean) >= _beyond(kinds) - 1e-3).collect())  # decided by _choose
    learned = _choose([tuple(r) for r in found], toxic, clean, kinds)
    lexicon = Lexicon(SEEDED | learned)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.weigh(t) for t in text.to_pylist()], pa.float64())

    pairs = sample.select(weigh("text").alias("z"), "toxic").collect()
    lexicon.threshold = _threshold([(r["z"], r["toxic"]) for r in pairs])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``__row`` (the document) with ``toxicity`` (0 to 1) beside it."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        release()
        return pa.array([shared.value.score(t) for t in text.to_pylist()], pa.float64())

    return packed(docs).withColumn("toxicity", run(document_text()))
