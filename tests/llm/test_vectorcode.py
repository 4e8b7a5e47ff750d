import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import vectorcode as vc
from tillroll.llm.common import with_group_sum

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Codes, errors and codebooks in Python integers, by the definition alone."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) or 1
    cut = []
    for i, v, l in kept:
        ints = [math.floor(1024 * float(np.float32(c))) for c in v] + [0] * (4 * width - len(v))
        cut.append((i, [ints[p * width:(p + 1) * width] for p in range(4)], l, [math.floor(1024 * float(np.float32(c))) for c in v]))
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    books = [[r[1][p] for r in cut[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(r[1][p], e), k) for k, e in enumerate(books[p])) for p in range(4)] for r in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = [r[1][p] for r, g in zip(cut, got) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    text = ",".join(str(c) for p in books for e in p for c in e)
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g)) for r, g in zip(cut, assign())], text


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("ints", F.lit("x")).withColumn("code", F.lit(1))
    coded, books = vc.compress(df)
    assert all(c in coded.select("__row.*").columns for c in ("ints", "code", "label"))
    out = coded.select("__row.vec_id", "__row.label", F.lower(F.hex("code")).alias("code"), "error")
    return [tuple(r) for r in out.collect()], books


def test_codes_against_brute_force(spark):
    random.seed(3)
    make = lambda n: [random.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, make(24), i % 3) for i in range(40)]
    rows += [(50 + i, [0.5] * 24, 1) for i in range(20)] + [(7, make(24), None), (None, make(24), None), (None, [0.1] * 24, 2)]
    rows += [(900, None, 1), (901, [0.1, None] + [0.0] * 22, 1), (902, [float("nan")] * 24, 1), (903, [float("inf")] * 24, 1)]
    rows += [(904, [], 1), (905, [0.25] * 5, 1), (906, [-0.0001] * 22, 4)]
    got, books = run(spark, rows)
    want, text = brute(rows)
    assert Counter(got) == Counter(want)
    assert books.text() == text and books.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_huge_components_stay_exact(spark):
    random.seed(4)
    rows = [(i, [random.choice((-1, 1)) * random.random() * 2.0**20 for _ in range(8)], 0) for i in range(300)]
    got, books = run(spark, rows)
    assert books.wide
    want, text = brute(rows)
    assert Counter(got) == Counter(want) and books.text() == text
    got, _ = run(spark, [(1, [3e38] * 4, 0), (2, [-3e38] * 4, 0), (3, [1.0] * 4, 0)])
    assert sorted(r[0] for r in got) == [1, 2, 3]


def test_early_elimination_finds_the_first_nearest_entry():
    random.seed(5)
    for width, high in ((1, 3), (5, 2), (16, 4), (16, 500)):
        entries = np.array([[[random.randint(-high, high) for _ in range(width)] for _ in range(40)]])
        x = np.array([[[random.randint(-high, high) for _ in range(width)]] for _ in range(300)])
        codes, errors = vc.Codebooks(entries, False).assign(x)
        d = ((x[:, 0, None, :] - entries[0][None]) ** 2).sum(axis=2)
        assert (codes[:, 0] == d.argmin(axis=1)).all() and (errors == d.min(axis=1)).all()


def test_transform_is_in_sequency_order():
    for size in (1, 2, 8, 32):
        base = vc.transform(np.eye(size, dtype=np.int64)).T
        assert [int((r[1:] != r[:-1]).sum()) for r in base] == list(range(size))
        assert (base @ base.T == size * np.eye(size)).all()


def test_decode_and_empty(spark):
    coded, books = vc.compress(spark.createDataFrame([(1, [0.5, 0.25, -1.0, 0.0], 0)], SCHEMA))
    assert vc.decode(coded, books).first()["vector"] == [0.5, 0.25, -1.0, 0.0]
    none, books = vc.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books.text() == ""


def test_group_sums_with_hot_and_cool_keys(spark):
    rows = [(1, 2**62), (1, 2**62), (None, 3), (None, 4)] + [(k, k) for k in range(2, 40)]
    df = spark.createDataFrame(rows, "label int, error long")
    for parts in (1, 10, 1000):
        got = with_group_sum(df, "label", "error", "s", parts).collect()
        want = Counter([(1, 2**62, None)] * 2 + [(None, 3, 7), (None, 4, 7)] + [(k, k, k) for k in range(2, 40)])
        assert Counter(map(tuple, got)) == want
