import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    """Every score of every document, by the formula."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:top])]
    return out


@pytest.fixture
def corpus():
    random.seed(11)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(150)] + ["straße", "日本", "é9"]
    pick = lambda n: " ".join(vocabulary[min(int(random.paretovariate(0.7)) - 1, len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, pick(random.randint(1, 60))) for i in range(600)]
    docs += [(1000 + i, "w3 w4 hot copy of the w5") for i in range(200)] + [(5, "w3 w3"), (5, "w3 w3"), (None, "w7 w7 W7!w8"), (None, "w7")]
    docs += [(2000, None), (2001, ""), (2002, "!!! ---"), (2003, "w9 " * 20000), (2004, "STRASSE straße_É9 é9")]
    items = [(i, pick(12)) for i in range(15)] + [(15, "w3 W4 copy"), (15, "w7 w8"), (None, "straße 日本"), (17, None),
                                                  (18, "nowhere"), (19, "w3 " * 4000 + "w9"), (20, "the THE of")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("n", F.lit("x")).withColumn("terms", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    return d, i


@pytest.mark.parametrize("cells, block, terms", [(1 << 24, 32, 16384), (2000, 2, 40)])
def test_ranking_against_brute_force(spark, corpus, monkeypatch, cells, block, terms):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = corpus
    ranked = lexical.rank(*frames(spark, docs, items), terms=terms)
    got = ranked.select("__row.item_id", "rank", "doc_id", "score").collect()
    assert Counter(map(tuple, got)) == Counter(brute(docs, items))
    assert lexical.ranked_rows(ranked).columns == ["item_id", "text", "rank", "score", "rank", "doc_id", "score"]


def test_empty_tables(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs[:5], items[:2])
    assert lexical.rank(d.limit(0), i).count() == lexical.rank(d, i.limit(0)).count() == 0


def test_blocks_are_skipped_and_none_that_matters():
    """Few documents of a shard are scored, and the best ones are among them."""
    random.seed(3)
    rng = np.random.default_rng(3)
    impacts = np.zeros((3000, 40), np.int32)
    for row in impacts:  # topics of five terms, beside two common ones
        topic = 5 * rng.integers(0, 7)
        row[topic:topic + 5] = rng.integers(0, 900_000, 5) * (rng.random(5) < 0.6)
        row[38:] = rng.integers(0, 900_000, 2)
    weights = np.array([6000] * 38 + [50] * 2)
    items = [np.array([5 * i, 5 * i + 1, 5 * i + 2, 38, 39]) for i in range(7)]
    shard, best = lexical.Shard(impacts), [lexical.Best(10) for _ in items]
    scored = Counter()
    add = lexical.Best.add

    class Counted(lexical.Best):
        def add(self, scores, ids, nulls):
            scored[id(self)] += len(scores)
            add(self, scores, ids, nulls)

    best = [Counted(10) for _ in items]
    columns = {t: np.arange(40) for t in range(40)}
    lexical.search(shard, np.arange(3000), np.zeros(3000, bool), items, weights, columns, best)
    for terms, found in zip(items, best):
        scores = impacts[:, terms].astype(np.int64) @ weights[terms]
        order = np.lexsort((np.arange(3000), -scores))[:10]
        assert found.ids.tolist() == order.tolist() and found.scores.tolist() == scores[order].tolist()
        assert scored[id(found)] < 1000
    docs, borders, summary = shard.blocks(0, columns[0])
    assert sorted(docs) == np.flatnonzero(impacts[:, 0]).tolist() and len(borders) > 3
    for b, (lo, hi) in enumerate(zip(borders, borders[1:])):
        assert (summary[b] == impacts[docs[lo:hi]].max(axis=0)).all()
