"""Vector codes: product quantisation in integers, searched under a Walsh-Hadamard transform.

Components become integers ``floor(SCALE * x)``; vectors are cut into ``PARTS`` equal parts, and
each part position has a codebook of at most ``ENTRIES`` entries, seeded with that part of the
smallest ids and refined by ``ROUNDS`` rounds of assigning and averaging (floors go down).

The nearest entry of a part is found without floating point.  Parts and entries are zero-padded to
a power of two P and put through the unnormalised Walsh-Hadamard transform, under which squared
distances are exactly P times the original ones.  Squared differences are added up in sequency
order, ``STEP`` coefficients at a time; an entry leaves when its partial sum exceeds the whole
distance of a candidate, so no entry that could win or tie is lost.  Ties go to the lower index.

Every round is one map over the written integer table: tasks return a count and sums per entry,
which Spark adds up; codebooks are the only thing that meets the driver or goes to all tasks,
``PARTS * ENTRIES`` entries whatever the input.

Defined results: rows whose vector is null or holds null or non-finite components are dropped;
shorter vectors, and lengths that ``PARTS`` doesn't divide, are padded with zeros at the end; null
ids come last; rows of equal id are ordered by their integers, so repeats seed several entries;
with fewer rows than ``ENTRIES`` the codebooks have fewer entries; integers beyond 64 bits are
held at the end of that range, and an error beyond it is null; an empty table gives an empty
result; of other columns those named in ``keep`` ride along, whatever they are called.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import ROW, field, packed, staged

SCALE, PARTS, ENTRIES, ROUNDS, STEP = 1024, 4, 256, 4, 4
#: pairs go on one by one when at most one in FEW is left
FEW = 8
_ROWS = 256
_WORD = 16
_END = 2**63 - 1


@cache
def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes, 0 to size - 1: row r
    has Gray-decoded bit-reversed r of them."""
    changes = np.zeros(size, np.int64)
    for bit in range(size.bit_length() - 1):  # from the lowest bit of r, the highest of the reverse
        changes = 2 * changes + ((np.arange(size) >> bit) & 1 ^ (changes & 1))
    return np.argsort(changes)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two), in sequency order, in integers."""
    shape, size = x.shape, x.shape[-1]
    half = 1
    while half < size:
        x = x.reshape(-1, size // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(shape)[..., sequency_order(size)]


def nearest(x: np.ndarray, entries: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index of and scaled squared distance to the nearest transformed entry of each transformed row.

    All pairs are added up ``step`` coefficients at a time; each time the least partial sum of a row
    names a candidate, whose whole distance bounds the row.  Once few pairs are within the bounds,
    only those go on.
    """
    part, room = np.zeros((len(x), len(entries)), x.dtype), np.empty((len(x), len(entries)), x.dtype)
    bound, at = None, 0
    while bound is None or at < x.shape[1] and alive.sum() * FEW > alive.size:
        for j in range(at, min(at + step, x.shape[1])):
            np.subtract(x[:, j, None], entries[None, :, j], out=room)
            part += np.multiply(room, room, out=room)
        at += step
        whole = ((x - entries[part.argmin(axis=1)]) ** 2).sum(axis=1)
        bound = whole if bound is None else np.minimum(bound, whole)
        alive = part <= bound[:, None]
    rows, cols = np.nonzero(alive)
    dist = part[rows, cols]
    for at in range(at, x.shape[1], step):
        dist = dist + ((x[rows, at:at + step] - entries[cols, at:at + step]) ** 2).sum(axis=1)
        stay = dist <= bound[rows]
        rows, cols, dist = rows[stay], cols[stay], dist[stay]
    best = np.minimum.reduceat(dist, np.searchsorted(rows, np.arange(len(x))))
    hits = np.flatnonzero(dist == best[rows])  # entries of a row are in ascending order
    return cols[hits[np.searchsorted(rows[hits], np.arange(len(x)))]], best


class Codebooks:
    """``entries``: (parts, entries, part width) integers; ``wide``: distances may pass 62 bits."""

    def __init__(self, entries: np.ndarray, wide: bool):
        self.parts, self.count, self.width = entries.shape
        self.size = 1 << max(self.width - 1, 0).bit_length()
        self.wide = wide
        self.entries = entries.astype(object if wide else np.int64)
        self.spectra = transform(self._padded(self.entries))

    def _padded(self, x: np.ndarray) -> np.ndarray:
        room = np.zeros((*x.shape[:-1], self.size), x.dtype)
        room[..., :x.shape[-1]] = x
        return room

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and squared distances summed over parts of (rows, parts, width)."""
        codes = np.empty(x.shape[:2], np.uint8)
        errors = np.zeros(len(x), x.dtype)
        for at in range(0, len(x), _ROWS):
            for p in range(self.parts):
                codes[at:at + _ROWS, p], far = nearest(transform(self._padded(x[at:at + _ROWS, p])), self.spectra[p])
                errors[at:at + _ROWS] += far // self.size
        return codes, errors

    def text(self) -> str:
        """All integers by part, entry and position, comma-joined."""
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def integers(vectors: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Written table (row, id order as given, ``ints``) of the rows that stay."""
    rows = packed(vectors).select(F.struct(*[field(c).alias(c) for c in keep]).alias(ROW),
                                  field(column).cast("array<double>").alias("v"))
    schema = rows.select(ROW, F.col("v").cast("array<long>").alias("ints")).schema

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            batch = batch.filter(lists.is_valid())
            lists = batch.column(1)
            edges = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)  # null components come as NaN
            fine = np.isfinite(values)
            bad = np.concatenate([[0], np.cumsum(~fine)])
            with np.errstate(over="ignore"):
                x = np.floor(np.where(fine, values, 0) * SCALE)
            ints = np.where(np.abs(x) < 2.0**63, np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64),
                            np.where(x < 0, -_END, _END))
            whole = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ints, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole], [ROW, "ints"]).filter(
                pa.array(bad[edges[1:]] == bad[edges[:-1]]))

    return staged(rows.mapInArrow(run, schema), "vector-integers")


def _matrix(lists: pa.Array, parts: int, width: int, wide: bool) -> np.ndarray:
    """(rows, parts, width) of lists, padded with zeros."""
    edges = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[edges[0]:edges[-1]]
    sizes = np.diff(edges)
    room = np.zeros((len(sizes), parts * width), np.int64)
    room[np.arange(parts * width) < sizes[:, None]] = values
    return room.reshape(-1, parts, width).astype(object if wide else np.int64)


def _averaged(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign every part, replace each entry by the floor of its parts' mean."""
    parts, count, width, wide = books.parts, books.count, books.width, books.wide
    words = -(-width // _WORD)
    names = [f"{limb}{i}" for limb in ("high", "low") for i in range(_WORD)]
    known = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = known.value
        n = np.zeros((parts, count), np.int64)
        sums = np.zeros((parts, count, words * _WORD), object if wide else np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts, width, wide)
            if not len(x):
                continue
            codes, _ = own.assign(x)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, starts = np.unique(codes[order, p], return_index=True)
                n[p] += np.bincount(codes[:, p], minlength=count)
                sums[p, used, :width] += np.add.reduceat(x[order, p], starts, axis=0)
        p, e, w = (i.reshape(-1) for i in np.indices((parts, count, words)))
        used = n[p, e] > 0
        p, e, w = p[used], e[used], w[used]
        s = sums.reshape(parts, count, words, _WORD)[p, e, w]
        cells = [pa.array(limb[:, i].tolist(), pa.int64()) for limb in (s >> 32, s & (2**32 - 1)) for i in range(_WORD)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()) for a in (p, e, w)] + [pa.array(n[p, e], pa.int64()), *cells],
            ["part", "entry", "word", "n", *names])

    schema = "part int, entry int, word int, n long, " + ", ".join(f"{c} long" for c in names)
    added = (rows.select("ints").mapInArrow(run, schema).groupBy("part", "entry", "word")
             .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]))
    entries = books.entries.copy()
    for r in added.collect():  # at most PARTS * ENTRIES rows for every 16 components of a part
        at = r["word"] * _WORD
        for i in range(min(_WORD, width - at)):
            entries[r["part"], r["entry"], at + i] = ((r[f"high{i}"] << 32) + r[f"low{i}"]) // r["n"]
    known.unpersist()
    return Codebooks(entries, wide)


def fit(rows: DataFrame, id_column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of an ``integers`` table whose rows carry ``id_column``."""
    most = F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints")))
    width, most = rows.agg(F.max(F.size("ints")), F.max(most)).first()
    width = -(-(width or 0) // parts) or 1
    size = 1 << (width - 1).bit_length()
    wide = 4 * size**2 * (most or 0)**2 >= 2**62
    first = rows.orderBy(field(id_column).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    seeds = pa.array([r["ints"] for r in first], pa.list_(pa.int64()))
    books = Codebooks(_matrix(seeds, parts, width, wide).transpose(1, 0, 2), wide)
    for _ in range(rounds if first else 0):
        books = _averaged(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` of an ``integers`` table -> row, ``code`` (binary, one byte a part), ``error``."""
    known = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own = known.value
        for batch in batches:
            codes, errors = own.assign(_matrix(batch.column(1), own.parts, own.width, own.wide))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([e if e <= _END else None for e in errors.tolist()], pa.int64())], [ROW, "code", "error"])

    schema = rows.select(ROW, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).schema
    for f in schema.fields[1:]:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``vector``: the entries' components, back on the scale of the input."""
    flat = [[[c / SCALE for c in entry] for entry in part] for part in books.entries.tolist()]

    @F.arrow_udf("array<double>")
    def look_up(codes: pa.Array) -> pa.Array:
        return pa.array([[x for p, c in enumerate(code) for x in flat[p][c]] for code in codes.to_pylist()],
                        pa.list_(pa.float64()))

    return coded.withColumn("vector", look_up("code"))


def compress(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id",
             keep: list[str] | None = None) -> tuple[DataFrame, Codebooks]:
    """Written (row, code, error) of every vector that stays, and the codebooks; rows keep the
    columns ``keep`` (all by default)."""
    keep = list(vectors.columns if keep is None else keep)
    rows = integers(vectors, column, keep + [id_column] * (id_column not in keep))
    books = fit(rows, id_column)
    return staged(encode(rows, books), "vector-codes"), books
