import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tillroll.llm import exactdedup, linededup

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_line_dedup_against_brute_force(docs, odd_rows):
    keys = lambda t: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(UPPER) for x in (t or "").split("\n")]
    low = lambda d: -2**63 if d is None else d
    held = {}
    for d, t, *_ in odd_rows:
        for k in keys(t):
            held.setdefault(k, set()).add(low(d))
    want = []
    for d, t, *_ in odd_rows:
        gone = [len(k) >= 10 and len(held[k]) > 1 and low(d) != min(held[k]) for k in keys(t)]
        want.append((d, len(gone), sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)))
    got = linededup.dedup_lines(docs(odd_rows)).select("__row.doc_id", "lines.*").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert linededup.dedup_lines(docs([(1, "a")]).limit(0)).count() == 0


def test_exact_groups_against_brute_force(docs, odd_rows):
    rows = odd_rows + [(100 + i, "Hot COPY") for i in range(60)] + [(300 + i, f"text {i}") for i in range(60)]
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(d)
    for counters in (2000, 3):  # all heavy; few heavy
        got = exactdedup.exact_groups(docs(rows), counters).collect()
        assert len(got) == len(rows)
        for text, ids in groups.items():
            digest = hashlib.sha256(text.encode()).digest()
            mine = [r for r in got if bytes(r["digest"]) == digest]
            best = max((i for i in ids if i is not None), default=None)
            assert sorted((r["doc_id"] for r in mine), key=str) == sorted(ids, key=str)
            assert {(r["keep_id"], r["group_size"]) for r in mine} == {(best, len(ids))}
            assert [r["doc_id"] for r in mine if r["kept"]] == [best]
        stay = exactdedup.drop_exact_copies(docs(rows), counters)
        assert stay.columns == docs(rows).columns
        assert Counter(r["text"] and r["text"].translate(UPPER) or "" for r in stay.collect()) == Counter(groups.keys())
    assert exactdedup.exact_groups(docs(rows).limit(0)).count() == 0
    assert exactdedup.drop_exact_copies(docs(rows).limit(0)).count() == 0


def test_misra_gries_keeps_every_frequent_digest(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.col("id").cast("string")).cast("binary").alias("digest"))
    found = exactdedup.misra_gries(rows, 5).collect()
    assert b"hot" in {bytes(r["digest"]) for r in found} and len(found) <= 11


def test_digests_are_taken_from_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    kept = exactdedup.staged
    monkeypatch.setattr(exactdedup, "staged", lambda df, name: (seen.append((name, spark.conf.get(key))), kept(df, name))[1])
    before = spark.conf.get(key)
    exactdedup.exact_groups(spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")).collect()
    assert int(dict(seen)["digests"]) <= 500 and spark.conf.get(key) == before


def test_lines_are_taken_once_from_small_batches(spark, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    kept = getattr(linededup, "staged", None)
    monkeypatch.setattr(linededup, "staged", lambda df, name: (seen.append((name, spark.conf.get(key))), kept(df, name))[1],
                        raising=False)
    before = spark.conf.get(key)
    rows = spark.createDataFrame([(1, "a line of some length\nb"), (2, "A line of some length")], "doc_id long, text string")
    got = linededup.dedup_lines(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["lines"]["kept_text"] for r in got.collect()) == ["", "a line of some length\nb"]
    assert int(dict(seen)["line-keys"]) <= 500 and spark.conf.get(key) == before
    assert "MapInArrow" not in plan


def test_a_task_takes_digests_in_one_python_worker(spark, docs):
    stay = exactdedup.drop_exact_copies(docs([(1, "a"), (2, "A"), (3, "b")]))
    plan = stay._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in stay.collect()) == [2, 3]
    assert plan.count("ArrowEvalPython") == 2  # of the rows whose digest is frequent, and of the others
