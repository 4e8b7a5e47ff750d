"""Byte-level BPE encoding and decoding in linear time.

A text is split by the tokenizer's pattern; each piece's bytes are read as Latin-1 so that
pyahocorasick's trie finds the longest token at a position.  Tokens are laid from the left,
longest first; a token may follow another only if the two are compatible, that is if BPE applied to
their joined bytes would keep them apart.  Where no token fits, the search steps back once
and marks the position, which no other path can use: compatible neighbours make the encoding of a
prefix unique, so each position is tried once and the merges' exact result is found in linear time.

Compatibility is decided on the merge histories: the parts of the left token that touch the
boundary against those of the right token, each alive until its merge; a merge across the boundary
that comes before both ends the pair.  Results are memoised, as are whole pieces and words.

Defined results: null text encodes as empty; an empty text has no ids; ids beyond the
vocabulary fail; ids are packed as little-endian unsigned 32-bit integers; repeated rows
encode alike; an empty table gives an empty result; other columns ride along untouched.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import Memo, document_text, packed

MEMO = 400_000
_NEVER = 1 << 62
_DOUBLE = re.compile(r" (?=\s)| \Z")


def vocabulary(ranks: bytes) -> dict[int, bytes]:
    """Rank -> bytes of a token, from a rank file."""
    pairs = (line.split() for line in ranks.splitlines() if line)
    return {int(rank): base64.b64decode(token) for token, rank in pairs}


class Decoder:
    """Bytes of packed ids; ``tokens``: bytes by rank, empty where a rank is not used."""

    def __init__(self, ranks: bytes):
        tokens = vocabulary(ranks)
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec(Decoder):
    def __init__(self, ranks: bytes, pattern: str):
        super().__init__(ranks)
        self.ids = {raw.decode("latin-1"): rank for rank, raw in enumerate(self.tokens) if raw}
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.trie.add_word(token, rank)
        self.longest_token = max(map(len, self.tokens), default=1)
        self.find = regex.compile(pattern).findall
        self.sizes = list(map(len, self.tokens))
        #: longest token that each token begins with, apart from itself
        self.shorter = [self._match(raw.decode("latin-1")[:-1]) for raw in self.tokens]
        self.fits = Memo(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), MEMO)
        self.touching_right = lru_cache(None)(lambda t: self._touching(t, 1))
        self.touching_left = lru_cache(None)(lambda t: self._touching(t, 0))
        self.parts = lru_cache(None)(self._parts)
        self.piece = Memo(self._packed_piece, MEMO)
        self.word = Memo(lambda w: b"".join(map(self.piece.__getitem__, self.find(w))), MEMO // 8)
        self.spaced = Memo(self._spaced, 2 * MEMO)

    def _spaced(self, word: str) -> bytes:
        """Packed ids of a word behind a space; letters are one piece, shared by all words that begin with it."""
        if word.isalpha():
            return self._packed_piece(" " + word)
        pieces = self.find(" " + word)
        if len(pieces) > 1 and pieces[0][0] == " " and (start := pieces[0][1:]).isalpha():
            return self.spaced[start] + b"".join(map(self.piece.__getitem__, pieces[1:]))
        return b"".join(map(self.piece.__getitem__, pieces))

    def _match(self, s: str) -> int | None:
        """Longest token that ``s`` starts with."""
        n, ids = self.trie.longest_prefix(s), self.ids
        while n:
            if (token := ids.get(s[:n])) is not None:
                return token
            n -= 1
        return None

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        s = self.tokens[token].decode("latin-1")
        parts = list(s)
        while len(parts) > 2:
            merges = [(self.ids.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            _, i = min(merges)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def _touching(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of ``token`` at one end, smallest first, each with the rank of the merge that ends it."""
        chain = [token]
        while halves := self.parts(chain[-1]):
            chain.append(halves[side])
        chain.reverse()
        return list(zip(chain, [*chain[1:], _NEVER]))

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.touching_right(left), self.touching_left(right)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            merge = self.ids.get((self.tokens[x] + self.tokens[y]).decode("latin-1"), _NEVER)
            if merge < x_end and merge <= y_end and merge < _NEVER:
                return False
            if x_end == y_end == _NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def encode_piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        if (whole := self.ids.get(s)) is not None:
            return [whole]
        ids: list[int] = []
        ids_of, sizes, shorter, fits = self.ids.get, self.sizes, self.shorter, self.fits
        prefix, end, longest, at, last = self.trie.longest_prefix, len(s), self.longest_token, 0, -1
        dead = bytearray(end + 1)
        token = self._match(s[:longest])
        while at < end:
            while token is not None and (dead[at + sizes[token]] or last >= 0 and not fits[last << 32 | token]):
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                token = shorter[token]
                last = ids[-1] if ids else -1
            else:
                ids.append(token)
                at += sizes[token]
                last = token
                rest = s[at:at + longest]
                n = prefix(rest)
                while n and (token := ids_of(rest[:n])) is None:
                    n -= 1
        return ids

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode().decode("latin-1"))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Packed ids.  The pattern always breaks before a lone space between other characters, so
        words are memoised whole; texts with longer runs of white space are split as they stand."""
        if _DOUBLE.search(text):
            return b"".join(map(self.piece.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return self.word[first] + b"".join(map(self.spaced.__getitem__, rest))


_codecs: dict = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """This process's codec for a vocabulary, built once."""
    key = (ranks, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def decoder(ranks: bytes) -> Decoder:
    if ranks not in _codecs:
        _codecs[ranks] = Decoder(ranks)
    return _codecs[ranks]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``__row`` (the document) with ``ids``, packed; ``path``: rank file read on the driver."""
    rows = packed(docs)
    ranks = _shared(docs, path)

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        c = codec(ranks.value, pattern)
        return pa.array([c.encode(t) for t in text.to_pylist()], pa.binary())

    return rows.withColumn("ids", run(document_text()))


def decode(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes that the packed ids stand for, whatever the pattern."""
    ranks = _shared(rows, path)

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        c = decoder(ranks.value)
        return pa.array([c.decode(i) for i in ids.to_pylist()], pa.binary())

    return rows.withColumn("decoded", run(F.col(column)))
