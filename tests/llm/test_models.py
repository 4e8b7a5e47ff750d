import math
import random
import zlib

import numpy as np
import pytest

from tillroll.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_bits(train, data):
    """Code length by the recursion of the method, byte by byte."""
    seen = [{} for _ in range(4)]
    for t in train:
        t = b"\0\0\0" + t
        for i in range(3, len(t)):
            for k in range(4):
                ctx = seen[k].setdefault(t[i - k:i], {})
                ctx[t[i]] = ctx.get(t[i], 0) + 1
    def p(ctx, sym):
        if ctx is None:
            return 1 / 256
        below = ctx[1:] if ctx else None
        counts = seen[len(ctx)].get(ctx)
        if not counts:
            return p(below, sym)
        total = sum(counts.values()) + len(counts)
        return counts[sym] / total if sym in counts else len(counts) / total * p(below, sym)
    data = b"\0\0\0" + data
    return sum(-math.log2(p(data[i - 3:i], data[i])) for i in range(3, len(data)))


def test_code_lengths_are_exact():
    random.seed(1)
    make = lambda alphabet, n: "".join(random.choice(alphabet) for _ in range(n)).encode()
    samples = {"a": [make("abcd ", 300), make("abc", 50)], "b": [make("xyzé ", 200)], "c": [b""]}
    model = langid.Ppm(samples)
    for text in (make("abcdxyzé qw", 120), b"a", make("ü", 9), b""):
        want = [brute_bits(samples[lang], text) for lang in model.langs]
        assert np.allclose(model.bits(text), want)
    model.block = 7
    assert np.allclose(model.bits(make("abcdx", 100)), model.bits(b"") + model.bits(b"")) is False


def test_undecided_texts():
    model = langid.Ppm({"a": [b"abc"], "b": [b"xyz"]})
    assert [model.predict(t)[0] for t in (None, "", "12 !?", "abc", "zyx")] == ["und", "und", "und", "a", "b"]
    assert langid.Ppm({}).predict("abc") == ("und", 0.0)


def test_language_of_odd_and_empty_tables(docs, odd_rows):
    model = langid.fit(docs(odd_rows))
    got = langid.predict(docs(odd_rows), model).collect()
    assert len(got) == len(odd_rows)
    assert all((r["lang_pred"] == "und") == (r["__row"]["text"] in (None, "", "!!! 123")) for r in got)
    assert langid.fit(docs(odd_rows).limit(0)).langs == [] and langid.predict(docs(odd_rows).limit(0), model).count() == 0


def test_every_language_is_learned(docs):
    langs = {f"l{i:03}": chr(0x4E00 + 40 * i) for i in range(90)}
    few = [(10 * i + j, "".join(chr(ord(first) + (j + 3 * k) % 20) for k in range(40)), lang, "s")
           for i, (lang, first) in enumerate(langs.items()) for j in range(8)]
    many = [(10_000 + i, f"plain english text number {i}", "en", "s") for i in range(300)]
    model = langid.fit(docs(few + many + [(20_000, "text", None, "s")]))
    assert model.langs == sorted([*langs, "en"]) and isinstance(model, langid.Panel)
    assert all(r["lang_pred"] == r["__row"]["lang"] for r in langid.predict(docs(few + many), model).collect())


def test_groups_of_languages_cost_the_same():
    random.seed(2)
    samples = {f"l{i}": [bytes(random.choices(range(97 + i, 110 + i), k=300))] for i in range(9)}
    whole = langid.Ppm(samples)
    parts = [langid.Ppm({k: samples[k] for k in whole.langs[i:i + 4]}) for i in (0, 4, 8)]
    for text in (b"", b"abcxyz", bytes(random.choices(range(95, 125), k=200))):
        assert np.allclose(langid.Panel(parts).bits(text), whole.bits(text))
    sizes = {f"l{i:05}": 1 + i % 7 * 300 for i in range(500)}
    parted = langid.groups(sizes)
    assert [lang for part in parted for lang in part] == sorted(sizes)
    assert all(len(p) * sum(min(langid.DOCS, sizes[x]) for x in p) <= langid.TABLE for p in parted)


def test_held_out_language_accuracy(spark):
    got = queries.QUERIES["op5_language_id"](spark, SF)
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot": 5.0, " trash": 5.0, " scum ": 5.0})
    assert lexicon.weigh("an 1d10t!") == lexicon.weigh("an IDIOT!") == lexicon.weigh("an іdіοt.") > 0
    assert lexicon.weigh("the trash can") == lexicon.weigh("scumble") == lexicon.score("") == 0
    assert lexicon.weigh("trash, idiots") > lexicon.weigh("trash can, idiots") > 0
    assert lexicon.weigh("idiot") > lexicon.weigh("idiot " + "fine " * 500) > 0


def test_toxicity_of_odd_tables(spark, docs, odd_rows):
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs(odd_rows), labels)
    assert lexicon.entries == toxicity.SEEDED
    rows = toxicity.score(docs(odd_rows), lexicon).collect()
    assert len(rows) == len(odd_rows) and {r["toxicity"] for r in rows} == {0.0}
    assert toxicity.score(docs(odd_rows).limit(0), toxicity.fit(docs(odd_rows).limit(0), labels.limit(0))).count() == 0


def test_rare_toxic_words_beside_a_rich_vocabulary(spark, docs):
    random.seed(4)
    word = lambda letters, n: "".join(random.choices(letters, k=n))
    often, rare = list({word("bcdfghjklmpqr", 10) for _ in range(3500)}), ["zazazu", "zezezo", "zizizi"]
    fine = [word("nostuvwxy", 5) for _ in range(500)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    bad = [" ".join(random.sample(often + rare * (i < 7), len(often) + len(rare) * (i < 7))) for i in range(9)]
    good = [" ".join(random.choices(fine, k=2000)) for _ in range(90)]
    rows = list(zip(ids, bad + good))
    labels = spark.createDataFrame([(i, int(n < len(bad))) for n, (i, _) in enumerate(rows)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs(rows), labels)
    assert [w for w in often + rare if not lexicon.weigh(w)] == []
    assert not any(lexicon.weigh(w) for w in fine)
    assert len(toxicity._choose([(f" {i:06}", 50, 0) for i in range(7000)], 350_000, 3_500_000, 7000)) == 7000


def test_ratio_as_a_column(spark):
    pairs = [(4, 0), (7, 3), (50, 1), (1000, 20), (5, 900)]
    rows = spark.createDataFrame(pairs, "t long, c long").select(toxicity._ratio(2000, 9000), toxicity._ratio(2000, 0)).collect()
    rate = 2000 / 11000
    for (t, c), (ratio, alone) in zip(pairs, rows):
        want = 2 * (t * math.log(t / ((t + c) * rate)) + (c * math.log(c / ((t + c) * (1 - rate))) if c else 0))
        assert math.isclose(ratio, want, rel_tol=1e-9) and (c or alone == 0)


def test_held_out_toxicity(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels)
    assert right >= 0.97 * len(labels)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


@pytest.mark.parametrize("pairs,want", [([(2.0, 1), (1.0, 0)], 1.5), ([(1.0, 1), (0.0, 0)], 0.5), ([(0.0, 0)], 0.25)])
def test_threshold(pairs, want):
    assert toxicity._threshold(pairs) == want
