import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tillroll.llm import mixture, queries

SF = "/root/testdata/sf0.01"


def brute_targets(words):
    """Targets by source: shared by weight, capped at twice the words, until none is above."""
    order = sorted(words, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, goal = Fraction(3 * sum(words.values()), 2), {}
    while True:
        open_ = [s for s in order if s not in goal]
        total = sum(weight[s] for s in open_) or 1
        above = [s for s in open_ if budget * weight[s] / total > 2 * words[s]]
        if not above:
            return goal | {s: budget * weight[s] / total for s in open_}
        goal |= {s: Fraction(2 * words[s]) for s in above}
        budget -= sum(2 * words[s] for s in above)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    words = Counter()
    for _, t, *rest in rows:
        words[(rest or ("en", "s"))[1]] += size(t)
    goal = brute_targets(words)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, *_ in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == words[r["source"]]
        assert r["target"] == pytest.approx(float(goal[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    return goal, taken


def test_targets_and_sums_against_brute_force(spark, docs, odd_rows):
    random.seed(2)
    rows = list(odd_rows)
    rows += [(1000 + i, "w " * random.randint(0, 60), "en", f"s{random.randint(0, 6)}") for i in range(400)]
    rows += [(2000 + i, "same few words", "en", "hot") for i in range(500)] + [(3000, "big " * 40000, "en", "one")]
    rows += [(3001, "", "en", "none"), (3002, "  x y", "en", ""), (3003, "a b", "en", None)]
    got = mixture.mix(docs(rows)).select("__row.doc_id", "size", "source", "source_size", "target", "copies", "taken").collect()
    goal, taken = check(rows, got)
    few = lambda lengths: len(lengths) < 4 or sum(lengths.values()) < 20
    by_source = {s: Counter(r["size"] for r in got if r["source"] == s) for s in goal}
    for s, t in goal.items():
        total = sum(n * k for n, k in by_source[s].items())
        passes, rest = divmod(int(t), total) if total else (0, 0)
        sums = {0}
        for n, k in by_source[s].items():
            sums = {x + n * i for x in sums for i in range(k + 1)} if few(by_source[s]) else sums
        if few(by_source[s]):  # all subsets
            best = min(abs(rest - x) for x in sums)
            assert abs(taken[s] - total * passes - rest) == best, s
        else:
            assert abs(taken[s] - int(t)) <= 1, s
    again = mixture.mix(docs(rows).repartition(7, F.rand(5))).select("__row.doc_id", "size", "source", "copies")
    assert Counter(map(tuple, again.collect())) == Counter((r["doc_id"], r["size"], r["source"], r["copies"]) for r in got)


def test_mixed_rows_keep_columns_and_repeat(spark, docs):
    df = docs([(i, "a b c" * (i % 4), "en", "x" if i % 2 else "y") for i in range(30)])
    mixed = mixture.mix(df)
    out = mixture.mixed_documents(mixed)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in mixed.collect())
    assert mixture.mix(df.limit(0)).count() == 0


def test_lengths_fit_the_budget():
    random.seed(6)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 4) for _ in range(random.randint(1, 5))}
        total = sum(k * n for k, n in counts.items())
        budget = random.randint(0, total)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        take = mixture.fit_lengths(counts, budget)
        assert all(0 <= n <= counts[k] for k, n in take.items())
        best = min(abs(s - budget) for s in sums)
        assert abs(sum(k * n for k, n in take.items()) - budget) == best
    long = {100_000 + 1000 * i: 3 for i in range(50)}
    assert abs(sum(k * n for k, n in mixture.fit_lengths(long, 3_210_000).items()) - 3_210_000) <= 60_000
    many = {k: 10**6 for k in range(1, 3000)}
    assert sum(k * n for k, n in mixture.fit_lengths(many, 10**12 + 7).items()) == 10**12 + 7


def test_query_on_the_whole_table(spark):
    got = queries.QUERIES["op11_source_mixture"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    goal, taken = check(rows, got)
    assert all(abs(taken[s] - float(t)) <= 2 for s, t in goal.items())
