"""Mixture-controlled packing.

Documents are tokenised where they lie and each source's documents form a queue, in the order of
the tasks that tokenised them.  Windows of ``WINDOW`` tokens are filled by deficit round-robin: in
every window a queue's credit grows by its share of the window, whole tokens of credit are
served, and the tokens that whole credits leave free go to the queues with the largest remaining
deficits (ties to the first queue); what a queue is short or ahead is carried to the next window.
The credits after k windows have a closed form, so any task can cut its documents without
knowing the others': deficits carry across windows and partitions alike, every window holds the
target proportions to within one token, and only the last window can be short.

The target is each source's share of all tokens, the only mixture that lasts until every queue is
empty.  Sources that are due less than ``LEAST`` tokens of a window share one queue, so at most
``WINDOW / LEAST`` queues exist.  The last sequence is padded to the window unless its fill is a power of two.

Defined results: null text is empty and has the end id only; null and empty sources are one source;
rows that share an id are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import string
import unicodedata
from struct import pack as pack_numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from tillroll.llm.common import Memo, by_bytes, document_text, field, held, packed, release, sliced, staged

WINDOW = 4096
#: least whole tokens of a window that a queue of its own must be due
LEAST = 4
END = 2
#: documents whose ids are held at once
SLICE = 512
WORDS, PIECES = 50_000, 300_000
#: bytes of text (or one document) whose words are held at once
TEXT = 1 << 19
_STOPS = re.escape(string.punctuation.replace("'", ""))
#: one word a line: its letters where only stops follow, the stops at its end, any other word as a whole, its end
_pieces = re.compile(rf"[^\W\d_]++(?=[{_STOPS}]*+\n)|[{_STOPS}]++(?=\n)|[^\n]+|\n").findall
_BREAK = 2**32 - 1
PROBES = ("Word", "word.", "Élan,", "straße?!", "çà", "日本", "и", "extraordinarily...")
_STEP = 256
#: the letters that byte-level models write bytes with: printable bytes themselves, the rest from 256 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class WordEncoder:
    """Ids of texts, word by word (split at white space), for tokenizers that drop white space and
    so encode words one by one.  The different words of many texts are encoded together.

    Where the definition allows (checked on ``PROBES``), words in normal form are lower-cased and cut by one
    pattern; letters go to the tokenizer's model alone, apart from the stops after them, and are memoised.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.pieces, self.words = Memo(self._piece, PIECES), Memo(self._whole, WORDS)
        self.direct = True
        self.direct = all(self.encode(w) == self._whole(w) for w in PROBES)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, low: str) -> bytes:
        if low == "\n":
            return _packed([_BREAK])
        if not low.isalpha():
            return self._whole(low)
        seen = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _packed([t.id for t in self.model.tokenize(seen)])

    def _odd(self, text: str) -> bool:
        """Whether only the tokenizer as a whole can tell: it lower-cases letter by letter."""
        return not self.direct or "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each of ``words`` (without white space) starts and ends."""
        line = pa.LargeListArray.from_arrays(pa.array([0, len(words)]), words)
        text, odd = pc.binary_join(line, "\n")[0].as_py() + "\n" if len(words) else "", {}
        if self._odd(text):
            rows = words.to_pylist()
            odd = {i: self.words[w] for i, w in enumerate(rows) if self._odd(w)}
            text = "\n".join(["" if i in odd else w for i, w in enumerate(rows)] + [""])
        ids = np.frombuffer(b"".join(map(self.pieces.__getitem__, _pieces(text.lower()))), "<u4")
        ends = np.flatnonzero(ids == _BREAK)
        starts = np.concatenate([[0], ends + 1])[:len(ends)]
        if odd:
            sizes = np.array([len(x) // 4 for x in odd.values()])
            at = np.fromiter(odd, np.int64)
            ends[at] = len(ids) + np.cumsum(sizes)
            starts[at] = ends[at] - sizes
            ids = np.concatenate([ids, np.frombuffer(b"".join(odd.values()), "<u4")])
        return ids, starts, ends

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids end."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, starts, ends = self._distinct(coded.dictionary)
        words = coded.indices.to_numpy()
        sizes = (ends - starts)[words]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat((starts[words] - upto[:-1]).astype(np.int32), sizes)
        places += np.arange(upto[-1], dtype=np.int32)
        return ids[places], upto[np.cumsum(pc.list_value_length(split).to_numpy())]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def _packed(ids: list[int]) -> bytes:
    return pack_numbers(f"<{len(ids)}I", *ids)


def encoder(definition: str) -> WordEncoder:
    """This process's encoder for a tokenizer definition, kept until other work starts in it."""
    return held(f"words {hash(definition)}", lambda: WordEncoder(definition))


class Mixture:
    """Tokens that each queue has served after k windows; ``sizes``: tokens per queue."""

    def __init__(self, sizes: list[int], window: int = WINDOW):
        self.sizes, self.window, self.total = sizes, window, sum(sizes)
        self.windows = -(-self.total // window)
        self.small = window * (self.windows + _STEP) * max(sizes, default=1) < 2**62
        self.blocks: dict[int, tuple] = {}

    def served(self, k: np.ndarray) -> np.ndarray:
        """(len(k), queues): exact integer credits, left-over tokens to the largest deficits."""
        kind = np.int64 if self.small else object
        k = np.minimum(k, self.windows).astype(kind)
        sizes = np.array(self.sizes, kind)
        credit = self.window * k[:, None] * sizes[None, :]
        whole, deficit = credit // self.total, credit % self.total
        free = self.window * k - whole.sum(axis=1)
        order = np.argsort(-deficit, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        out = whole + (place < free[:, None])
        out[k == self.windows] = sizes
        return out

    def block(self, n: int) -> tuple[list, list]:
        """Of windows n * _STEP on: tokens served before each, and where each queue starts in it."""
        if n not in self.blocks:
            if len(self.blocks) > 64:
                self.blocks.clear()
            q = self.served(np.arange(n * _STEP, (n + 1) * _STEP + 1))
            share = q[1:] - q[:-1]
            self.blocks[n] = (q.T.tolist(), (share.cumsum(axis=1) - share).T.tolist())
        return self.blocks[n]

    def cut(self, queue: int, start: int, length: int):
        """Pieces (position in the document, length, window, offset) of tokens start.. of a queue."""
        at, end = start, start + length
        k = at * self.total // (self.window * self.sizes[queue])
        while at < end:
            n, i = divmod(min(max(k, 0), self.windows - 1), _STEP)
            served, offsets = self.block(n)
            if served[queue][i] > at:
                k -= 1
            elif served[queue][i + 1] <= at:
                k += 1
            else:
                size = min(end, served[queue][i + 1]) - at
                yield at - start, size, k, offsets[queue][i] + at - served[queue][i]
                at += size
                k += 1

    def fill(self, k: int) -> int:
        return min(self.window, self.total - k * self.window)


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Written table (pid, doc_id, source, start, n, ids): ids packed as unsigned 16- or 32-bit
    integers, ``start`` the tokens of that source before the document in its task."""
    spark = docs.sparkSession
    rows = packed(docs).select(F.spark_partition_id().alias("pid"), field("doc_id").cast("long").alias("doc_id"),
                               F.coalesce(field("source").cast("string"), F.lit("")).alias("source"),
                               document_text().alias("text"))
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    kind = id_type(path)

    def run(batches):
        own = encoder(definition.value)
        ahead: dict[str, int] = {}
        for batch in by_bytes(batches, 3, TEXT):
            ids, ends = own.encode_all(batch.column(3))
            ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)
            starts, sizes = [], np.diff(ends, prepend=0).tolist()
            for source, n in zip(batch.column(2).to_pylist(), sizes):
                starts.append(ahead.get(source, 0))
                ahead[source] = starts[-1] + n
            data = ids.astype(kind)
            offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])],
                ["pid", "doc_id", "source", "start", "n", "ids"])

    return staged(rows.mapInArrow(run, "pid int, doc_id long, source string, start long, n long, ids binary"), "tokens")


def id_type(path: str) -> str:
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def queues_of(totals: list[tuple[str, int]], rest: int, window: int = WINDOW) -> tuple[list[str], list[int]]:
    """Named queues and all sizes (the shared queue last): every queue but an only one is due at
    least ``LEAST`` tokens of each window, so that its credits never shrink by rounding."""
    named = sorted(totals, key=lambda t: (-t[1], t[0]))
    total = rest + sum(n for _, n in named)
    while named and (named[-1][1] * window < LEAST * total or 0 < rest and rest * window < LEAST * total):
        rest += named.pop()[1]
    return [s for s, _ in named], [n for _, n in named] + ([rest] if rest else [])


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids (packed unsigned 32-bit), doc_tokens, sequence_id,
    offset, padded_length (of the sequence)."""
    spark = docs.sparkSession
    tokens, kind = tokenised(docs, path, end), id_type(path)
    sums = staged(tokens.groupBy("pid", "source").agg(F.sum("n").alias("n")), "queue-parts")
    total = sums.agg(F.sum("n")).first()[0] or 0
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n")).where(F.col("n") * window >= LEAST * total)
    large = [(r["source"], r["n"]) for r in by_source.collect()]  # at most window / LEAST rows
    named, sizes = queues_of(large, total - sum(n for _, n in large), window)
    mixture = Mixture(sizes, window)
    places = spark.createDataFrame(list(enumerate(named)), "queue int, source string")
    parts = (sums.join(F.broadcast(places), "source", "left")
             .withColumn("queue", F.coalesce("queue", F.lit(len(named)))))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = parts.withColumn("inside", before(Window.partitionBy("pid", "queue").orderBy("source")))
    tasks = parts.groupBy("pid", "queue").agg(F.sum("n").alias("n"))
    ahead = tasks.select("pid", "queue", before(Window.partitionBy("queue").orderBy("pid")).alias("ahead"))
    bases = staged(inside.join(ahead, ["pid", "queue"])
                   .select("pid", "source", "queue", (F.col("inside") + F.col("ahead")).alias("base")), "queue-bases")

    def run(batches):
        release()
        for batch in sliced(batches, SLICE):
            row, starts, sizes_, windows, offsets, ids, padded = [], [], [], [], [], [], []
            queue, first, n, data = (batch.column(i).to_pylist() for i in range(4))
            for r in range(batch.num_rows):
                own = np.frombuffer(data[r], kind).astype("<u4")
                for at, size, k, offset in mixture.cut(queue[r], first[r], n[r]):
                    row.append(r), starts.append(at), sizes_.append(size), windows.append(k), offsets.append(offset)
                    ids.append(own[at:at + size].tobytes())
                    fill = mixture.fill(k)
                    padded.append(fill if fill & (fill - 1) == 0 else window)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(at), batch.column(5).take(at), pa.array(starts, pa.int64()),
                 pa.array(sizes_, pa.int64()), pa.array(ids, pa.binary()), batch.column(2).take(at),
                 pa.array(windows, pa.int64()), pa.array(offsets, pa.int64()), pa.array(padded, pa.int64())],
                ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"])

    placed = tokens.join(bases, ["pid", "source"]).select(
        "queue", (F.col("base") + F.col("start")).alias("first"), "n", "ids", "doc_id", "source")
    return placed.mapInArrow(run, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long, padded_length long")
