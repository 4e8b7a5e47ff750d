import random
from itertools import combinations

import pytest
import xxhash

from tillroll.llm import simhash
from tillroll.llm.components import components

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_print(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - 2**64 if out >= 2**63 else out


def classes(prints):
    """fp -> smallest id reachable over links of at most two bits."""
    root = {f: f for f in prints.values()}
    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a, b in combinations(set(prints.values()), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            root[find(a)] = find(b)
    low = {}
    for i, f in prints.items():
        low[find(f)] = min(low.get(find(f), i), i)
    return {i: low[find(f)] for i, f in prints.items()}


def test_fingerprints(odd_rows):
    for _, text, *_ in odd_rows + [(0, "one two"), (0, "a b c a b c a b c"), (0, "x\x1cy É")]:
        assert simhash.simhash(text or "") == brute_print(text)


def test_every_shingle_votes_in_texts_of_several_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 7919}" for i in range(65_540))
    assert simhash.simhash(text) == brute_print(text)
    monkeypatch.setattr(simhash, "_CHUNK", 2)
    for n in range(1, 40):
        text = " ".join(f"w{n * i % 17}" for i in range(n))
        assert simhash.simhash(text) == brute_print(text)


@pytest.mark.parametrize("crowd", [64, 3])
def test_components_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    random.seed(3)
    prints, i = {}, 0
    for _ in range(40):
        f = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 2, 40])):
            for _ in range(random.choice([0, 1, 1, 2, 3])):
                f ^= 1 << random.randrange(64)
            prints[i] = f - 2**64 if f >= 2**63 else f
            i += 1
    df = spark.createDataFrame([(k, v) for k, v in prints.items()], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert {i: got[f] for i, f in prints.items()} == classes(prints)


def test_documents_and_keeping(docs, odd_rows):
    rows = odd_rows + [(20 + i, "the quick brown fox jumps over the lazy dog " * 30 + f"tail{i % 3}") for i in range(12)]
    want = [(d, brute_print(t)) for d, t, *_ in rows]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["fp"]) for r in got), key=str) == sorted(want, key=str)
    kept = simhash.keep_first(docs(rows))
    assert kept.columns == docs(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({r["component_id"] for r in got}) and set(ids) == {r["component_id"] for r in got}
    assert simhash.near_duplicates(docs(rows).limit(0)).count() == 0 and simhash.keep_first(docs(rows).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7), (5, 6)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
