import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tillroll.llm import bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
HARD = ["", " ", "  a  b ", "a \n b", "foo\n \nbar", "a" * 300, " " * 700 + "z", "'s don't", "日本語 é" * 40, "x\x1c\x85 y", "=" * 999]


@pytest.fixture(scope="module")
def both():
    raw = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(both, text):
    own, ref = both
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text) and own.decode(ids) == text.encode()


@given(text=st.one_of(st.text(max_size=60), st.text("ab c'\n\t 1é", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_any_text(both, text):
    own, ref = both
    assert np.frombuffer(own.encode(text), "<u4").tolist() == ref.encode_ordinary(text)


def test_bpe_of_documents(docs, odd_rows, both):
    coded = bpe.encode(docs(odd_rows), RANKS, P.PATTERN)
    rows = bpe.decode(coded, RANKS, P.PATTERN).collect()
    for r in rows:
        text = r["__row"]["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == both[1].encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert bpe.encode(docs(odd_rows).limit(0), RANKS, P.PATTERN).count() == 0


@given(st.one_of(st.text(max_size=40), st.text("abC .,!'éΣς\n<|>", max_size=40)))
@settings(max_examples=300, deadline=None)
def test_words_encode_like_whole_texts(text):
    own = packing.encoder(open(WORDS, encoding="utf-8").read())
    assert own.direct
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_in_any_case_and_before_any_stops_are_one_piece():
    own = packing.WordEncoder(open(WORDS, encoding="utf-8").read())
    before = set(own.pieces)
    text = "Zebra zebra, ZEBRA; (zebra) ébène Ébène. x²! İÇ Σας don't '' m1n -- \x1c e\u0301"
    for _ in range(2):
        for t in (text, text[:30], text[30:60]):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
    own.encode("zebra Zebra, ZEBRA;")
    assert {p for p in set(own.pieces) - before if p.isascii() and p.startswith("zeb")} == {"zebra"}


def check_packing(pieces, rows, window):
    tok = Tokenizer.from_file(WORDS)
    want = sorted((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, *_ in rows)
    total = sum(len(ids) for _, ids in want)
    sequences, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["source"]))
        by_doc.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
    for k, parts in sequences.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == min(window, total - k * window)
    assert sorted(sequences) == list(range(-(-total // window)))
    for d, ids in want:
        got = sorted(by_doc[d])
        assert sum((i for _, i, _ in got), []) == list(ids) and {n for *_, n in got} == {len(ids)}
        assert [s for s, *_ in got] == np.cumsum([0] + [len(i) for _, i, _ in got])[:-1].tolist()
    return sequences, total


def test_packing_mixture(docs):
    rows = [(i, f"word{i} " * (i % 37 * 5), "en", ["a", "a", "b", None, f"tiny{i}"][i % 5 if i < 290 else 4]) for i in range(300)]
    window = 256
    pieces = packing.pack(docs(rows).repartition(7), WORDS, window).collect()
    sequences, total = check_packing(pieces, rows, window)
    sizes = {}
    for parts in sequences.values():
        for _, n, s in parts:
            sizes[s] = sizes.get(s, 0) + n
    for s in ("a", "b", ""):
        for k, parts in sequences.items():
            if (k + 1) * window <= total:
                assert abs(sum(n for _, n, x in parts if x == s) - window * sizes[s] / total) < 2


def test_packing_odd_and_empty(docs, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (9, None)] + [(12, "x", "en", None)]
    check_packing(packing.pack(docs(rows), WORDS).collect(), rows, packing.WINDOW)
    assert len(packing.pack(docs(odd_rows), WORDS).collect()) >= len(odd_rows)
    assert packing.pack(docs(rows).limit(0), WORDS).count() == 0
    short = packing.pack(docs([(1, "a b c")]), WORDS).collect()[0]
    assert short["length"] == 4 and short["padded_length"] == 4  # a power of two is not padded


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=30), st.integers(0, 2000))
@settings(max_examples=150, deadline=None)
def test_credits(totals, rest):
    _, sizes = packing.queues_of([(str(i), n) for i, n in enumerate(totals)], rest, 1024)
    assert sum(sizes) == sum(totals) + rest
    mix = packing.Mixture(sizes, 1024)
    q = mix.served(np.arange(mix.windows + 1)).astype(int)
    assert (np.diff(q, axis=0) >= 0).all() and (q[-1] == sizes).all() and (q.sum(axis=1)[:-1] == 1024 * np.arange(mix.windows)).all()
    mix.small = False
    assert (mix.served(np.arange(mix.windows + 1)).astype(int) == q).all()


def test_crc_of_ids_is_little_endian(spark):
    import pyspark.sql.functions as F
    data = np.array([1, 70000], "<u4").tobytes()
    assert spark.createDataFrame([(data,)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(data)
