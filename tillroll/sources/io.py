"""Sources and sinks: S2–S8, S11–S13.

Every path comes from the caller or from :func:`scratch_path`, which lives under the
cluster's shared ``spark.checkpoint.dir`` (set only when absent, e.g. in tests) — never a
machine-local temporary folder.  Writes go to a fresh path per call, or to one whose rows the
caller has done with; nothing overwrites a path that the same plan is reading.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.exprs import plain_number
from tillroll.session import checkpoint_dir


#: values are written as they are, blanks around them included
AS_IS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: a gzipped text file, which a reader can't split, and the rows it holds at most
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
FILE_ROWS = 500_000


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tillroll/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write made inside go when it is done; left to itself Spark keeps them until the
    driver's garbage is collected, which a driver with little to do seldom is."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: what several steps share is computed
    once, and a lost executor costs a re-read.  A caller that is done with what it staged before names that
    ``path``, which is then replaced."""
    path = path or scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ── S2 / S3 ────────────────────────────────────────────────────────────────────
def read_feed_csv(spark: SparkSession, path: str, comment: str | None = None, header_row: int = 0) -> DataFrame:
    """S2/S3 — CSV, every column a string (no inference pass), header names stripped, all-empty rows
    dropped.  The header is the line numbered ``header_row`` (from 0) of every file; lines above it
    are titles and go.  Lines that start with ``comment`` are no lines at all."""
    if header_row:
        df = _read_below(spark, path, comment, header_row)
    else:
        r = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
        if comment:
            r = r.option("comment", comment)
        df = r.csv(path)
    return df.toDF(*[c.strip() for c in df.columns]).na.drop(how="all")


def _read_below(spark: SparkSession, path: str, comment: str | None, header_row: int) -> DataFrame:
    """Rows below the header line, whatever the files' splits: lines are numbered in the first split of
    each file, which holds the header, by their distance from the file's first line; all
    lines of later splits are rows.  The number of each file's first line is written once and broadcast (one
    row a file), so lines are parsed where they are read, whatever share of them one file holds."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"))
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    first = staged(lines.where("start = 0").groupBy("file").agg(F.min("id").alias("base")), "first-lines")
    line = F.when(F.col("start") == 0, F.col("id") - F.col("base"))
    numbered = lines.join(F.broadcast(first), "file").select("file", "value", line.alias("line"))
    head = numbered.where(F.col("line") == header_row).orderBy("file").select("value").first()
    names = _header_names(head["value"]) if head else []
    rows = numbered.where(F.col("line").isNull() | (F.col("line") > header_row))
    if not names:
        return spark.createDataFrame([], T.StructType())
    parsed = rows.where("value <> ''").select(F.from_csv("value", _ddl(names)).alias("r"))
    return parsed.select("r.*").toDF(*names)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"c{i} string" for i in range(len(names)))


def _header_names(line: str) -> list[str]:
    """Cells of a header line; blank ones are numbered, repeated ones told apart by a suffix."""
    seen: dict[str, int] = {}
    out = []
    for i, cell in enumerate(next(csv.reader([line]))):
        name = cell if cell.strip() else f"Unnamed: {i}"
        n = seen.setdefault(name, 0)
        seen[name] += 1
        out.append(f"{name}.{n}" if n else name)
    return out


def write_sheets(df: DataFrame, path: str, titles: list[str], sheets: int, gzipped: bool = False) -> None:
    """CSV files with ``titles`` above the header, a folder a sheet; rows are dealt to sheets by their hash and
    written by the tasks that make them, without a shuffle: the first row of a task brings the lines above the rows of
    each sheet.  One more row, which is not written, does so for a frame without rows."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="").writerow(df.columns)
    above = [F.struct(F.lit(s).alias("sheet"), F.lit(i).alias("line"), F.lit(t).alias("value"))
             for s in range(sheets) for i, t in enumerate([*titles, buffer.getvalue()])]
    rows = df.select(F.pmod(F.xxhash64(*cells), F.lit(sheets)).cast("int").alias("sheet"), F.lit(len(titles) + 1).alias("line"),
                     F.to_csv(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), AS_IS).alias("value"))
    none = df.sparkSession.range(1).selectExpr("0 AS sheet", "0 AS line", "CAST(NULL AS string) AS value")
    placed = rows.unionByName(none).select(F.struct("sheet", "line", "value").alias("row"), F.monotonically_increasing_id().alias("id"))
    first = F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the lower 33 bits number the rows of a task
    lines = placed.select(F.inline(F.when(first, F.array(*above, "row")).otherwise(F.array("row")))).where("value IS NOT NULL")
    with shuffles_freed(df.sparkSession):
        (lines.sortWithinPartitions("sheet", "line").select("sheet", "value")
         .write.mode("overwrite").options(**(GZIP if gzipped else {})).partitionBy("sheet").text(path))


# ── S4 ─────────────────────────────────────────────────────────────────────────
def numeric_columns(df: DataFrame) -> DataFrame:
    """S4 report — per column, whether every non-null value parses as a number.

    One aggregate over the data (a failure count per column); the result is one row of
    #columns counts, unpivoted to (column, numeric)."""
    fails = df.agg(*[
        F.count_if(F.col(f"`{c}`").isNotNull() & plain_number(F.col(f"`{c}`")).isNull()).alias(f"c{i}")
        for i, c in enumerate(df.columns)
    ])
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"c{i}") == 0).alias("numeric")) for i, c in enumerate(df.columns)
    ]))
    return fails.select(stack.alias("s")).select("s.column", "s.numeric")


def apply_numeric_typing(df: DataFrame) -> DataFrame:
    """S4 — all-or-nothing typing: a column becomes double only when all its values parse.

    The decision needs the one-row failure counts (bounded by #columns) on the driver."""
    flags = {r["column"]: r["numeric"] for r in numeric_columns(df).collect()}
    return df.select(*[
        (plain_number(F.col(f"`{c}`")) if flags[c] else F.col(f"`{c}`")).alias(c) for c in df.columns
    ])


# ── S5 / S6 / S7 / S8 ──────────────────────────────────────────────────────────
def load_table(df: DataFrame, path: str) -> DataFrame:
    """S5 — idempotent load: overwrite, then read back (row count = what was written)."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_partitioned(sales_df: DataFrame, path: str, by: str = "year_month",
                      sort_cols: tuple[str, ...] = ("ZONE", "PRODUCT")) -> None:
    """S6 — access path: partition directories by month, rows clustered by outlet and item
    inside each file so Parquet min/max statistics prune row groups.

    Rows are dealt by range over month, ``sort_cols`` and a hash of the row, so tasks get equal
    shares however many rows a month, an outlet or an item holds."""
    out = sales_df.withColumn(by, F.date_format("INVOICE_DATE", "yyyy-MM"))
    (out.repartitionByRange(by, *sort_cols, F.xxhash64(*sales_df.columns)).sortWithinPartitions(by, *sort_cols)
     .write.mode("overwrite").partitionBy(by).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """S7 — CSV sink with a header, gzipped (as plain text it takes several times the tables the rows come from)."""
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").options(header=True, maxRecordsPerFile=FILE_ROWS, **GZIP, **AS_IS).csv(path)


def write_valid_csv(df: DataFrame, valid: Column, path: str) -> dict[str, int]:
    """E6 + S7 — write the rows that are ``valid``; the counts of rows before, after and dropped are
    observed during that one pass."""
    seen = Observation("rows")
    observed = (df.withColumn("_keep", valid)
                .observe(seen, F.count(F.lit(1)).alias("before"), F.count_if("_keep").alias("after")))
    write_csv(observed.filter("_keep").drop("_keep"), path)
    got = seen.get
    return {"rows_before": got["before"], "rows_after": got["after"], "dropped": got["before"] - got["after"]}


def write_json(df: DataFrame, path: str) -> None:
    """S8 — JSON-lines results sink."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """S8 — read back with an explicit schema (no inference)."""
    return spark.read.schema(schema).json(path)


# ── S11 / S12 ──────────────────────────────────────────────────────────────────
def append_trace(payload: DataFrame, path: str) -> None:
    """S11 — append audit rows as JSON lines with a UTC timestamp."""
    payload.withColumn("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.mode("append").json(path)


def log_notification(rows: DataFrame, path: str, batch: int) -> None:
    """S12 — append alert-history rows (root cause cut to 200 chars) under the append's number."""
    rows.select(
        F.lit(batch).cast("bigint").alias("batch"),
        F.current_timestamp().alias("logged_at"),
        "timestamp", "anomaly_count", "outlets_flagged",
        F.left(F.coalesce("root_cause", F.lit("")), F.lit(200)).alias("root_cause_summary"),
        "email_status", "recipient",
    ).write.mode("append").parquet(path)


def notification_history(spark: SparkSession, path: str, last_n: int = 5) -> DataFrame:
    """S12 — the last ``last_n`` records in append order, by timestamp text inside an append (top-k,
    then re-sorted ascending)."""
    order = ["batch", "timestamp", "outlets_flagged", "root_cause_summary"]
    return spark.read.parquet(path).orderBy(*[F.col(c).desc() for c in order]).limit(last_n).orderBy(*order)


# ── S13 ────────────────────────────────────────────────────────────────────────
def catalog_report(spark: SparkSession, prefix: str = "") -> DataFrame:
    """S13 — registered tables / views (named ``prefix``…) with row count and ``name type`` column list.

    Metadata comes from the catalog; the counts are one lazy union, so they run side by side."""
    out = spark.createDataFrame([], "table string, rows bigint, n_columns int, columns string")
    for t in spark.catalog.listTables():
        if not t.name.startswith(prefix):
            continue
        cols = spark.catalog.listColumns(t.name)
        out = out.unionByName(spark.table(t.name).agg(
            F.lit(t.name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).alias("n_columns"),
            F.lit(", ".join(f"{c.name} {c.dataType}" for c in cols)).alias("columns")))
    return out
