"""S1 — scan the driver tables and expose the canonical sales fact.

The sales fact is one row per invoice line.  On the TPC-H-shaped driver tables it is
``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part ⋈ supplier`` with renamed,
typed columns (money as exact decimals so sums do not depend on task order).

Scale notes
-----------
* Every read uses an explicit schema: no inference pass over 100 TB of footers.
* ``sales(..., columns=[...])`` joins only the dimensions that provide the requested
  columns.  The dimension joins are foreign-key joins (every line has its order, part,
  supplier; every order its customer), so leaving an unused one out does not change the
  row set — it only removes a full shuffle of the fact.  Catalyst cannot drop an inner
  join by itself because it does not know the key constraints.
* ``nation`` and ``region`` have a fixed size (25 / 5 rows) and are broadcast; they are
  joined onto ``customer`` / ``supplier`` first so the fact never shuffles for them.
  ``customer``, ``part`` and ``supplier`` grow with the data, so their strategy is left
  to the planner (size statistics + AQE runtime re-planning): broadcast while small,
  sort-merge beyond ``spark.sql.autoBroadcastJoinThreshold``.
* Tables of more than ``LARGE`` rows are joined to the lines in tasks of ``TASK_LINES`` lines: left to itself,
  AQE merges the partitions until 64 MB of them, as compressed, lie in one task, gigabytes once unpacked and sorted.
  Orders come last where only their key counts (baskets), so that bills are summed in the tasks that join them.
* Filters on ``INVOICE_DATE`` / ``ZONE`` are written on the final columns; Catalyst
  pushes them through the joins into the ``orders`` / ``region`` scans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

# Canonical fact columns, grouped by the dimension that provides them.
LINE_COLUMNS = (
    "INVOICE_NO", "LINE_NO", "INVOICE_DATE", "CHANNEL", "QTY_PACKS", "GROSS_AMT", "NET_AMT",
    "SCHEME_AMT", "GRP_SCHEME_AMT",
)
GEO_COLUMNS = ("ZONE", "STATE", "CUSTOMER", "CUSTOMER_CODE", "CUSTOMER_CATEGORY")
PRODUCT_COLUMNS = ("PRODUCT", "PRODUCT_CLASS", "CODE", "PRODUCT_MRP", "BASIC_RATE", "TOTAL_VOLUME_BILLED_LTR")
STOCKIEST_COLUMNS = ("STOCKIEST", "STOCKIEST_CODE")
ALL_COLUMNS = LINE_COLUMNS + GEO_COLUMNS + PRODUCT_COLUMNS + STOCKIEST_COLUMNS

MONEY = T.DecimalType(12, 2)

LARGE = 2_000_000  # rows of a table beyond which its join to the lines is dealt into tasks of TASK_LINES
TASK_LINES = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation ⋈ region is 25 rows by definition of the schema: a bounded broadcast.
    nr = read_table(spark, sf_dir, "nation").join(
        F.broadcast(read_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return read_table(spark, sf_dir, "customer").join(
        F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_custkey"),
        F.col("r_name").alias("ZONE"),
        F.col("n_name").alias("STATE"),
        F.col("c_name").alias("CUSTOMER"),
        F.col("c_custkey").alias("CUSTOMER_CODE"),
        F.col("c_mktsegment").alias("CUSTOMER_CATEGORY"),
    )


def _join_lines(lines: DataFrame, line_key: str, n_lines: int, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``lines`` ⋈ ``table``; a table of more than ``LARGE`` rows in tasks whose number grows with the lines."""
    if n_rows > LARGE:
        tasks = max(1, -(-n_lines // TASK_LINES))
        lines, table = lines.repartition(tasks, line_key), table.repartition(tasks, key)
    return lines.join(table, F.col(line_key) == F.col(key))


def sales(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Canonical invoice-line fact (lazy).  ``columns`` limits the dimension joins."""
    want = tuple(columns) if columns is not None else ALL_COLUMNS
    unknown = set(want) - set(ALL_COLUMNS)
    if unknown:
        raise ValueError(f"unknown sales columns: {sorted(unknown)}")

    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.col("o_custkey"),
        F.col("o_orderdate").cast("date").alias("INVOICE_DATE"),
        F.col("o_orderpriority").alias("CHANNEL"),
    )
    # Geography is attached to *orders* before the line join: when customer is too big to
    # broadcast, only orders (≈ ¼ of the lines) is shuffled by customer key, and the line
    # table is shuffled once, by order key.
    if set(want) & set(GEO_COLUMNS):
        od = od.join(_geo(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    gross = F.col("l_extendedprice").cast(MONEY)
    # row counts are read from the file footers
    rows = {name: read_table(spark, sf_dir, name).count() for name in ["lineitem", "orders"]
            + ["part"] * bool(set(want) & set(PRODUCT_COLUMNS)) + ["supplier"] * bool(set(want) & set(STOCKIEST_COLUMNS))}
    # where nothing but the key is asked of orders, they are joined last: the lines of an invoice then lie in one
    # task of TASK_LINES, and sums by invoice need no other shuffle, whose tasks would grow with the lines
    last = not set(want) & {"INVOICE_DATE", "CHANNEL", *GEO_COLUMNS}
    fact = li if last else _join_lines(li, "l_orderkey", rows["lineitem"], od, "o_orderkey", rows["orders"])
    fact = fact.select(
        "*",
        F.col("l_orderkey").alias("INVOICE_NO"),
        F.col("l_linenumber").alias("LINE_NO"),
        F.col("l_quantity").cast(T.DecimalType(10, 2)).alias("QTY_PACKS"),
        gross.alias("GROSS_AMT"),
        (gross * (F.lit(1).cast(T.DecimalType(4, 2)) - F.col("l_discount").cast(T.DecimalType(4, 2)))).alias("NET_AMT"),
        (gross * F.col("l_discount").cast(T.DecimalType(4, 2))).alias("SCHEME_AMT"),
        (gross * F.col("l_tax").cast(T.DecimalType(4, 2))).alias("GRP_SCHEME_AMT"),
    )
    if set(want) & set(PRODUCT_COLUMNS):
        part = read_table(spark, sf_dir, "part").select(
            "p_partkey",
            F.col("p_name").alias("PRODUCT"),
            F.col("p_type").alias("PRODUCT_CLASS"),
            F.col("p_brand").alias("CODE"),
            F.col("p_retailprice").cast(T.DecimalType(10, 2)).alias("PRODUCT_MRP"),
            F.col("p_retailprice").cast(T.DecimalType(10, 2)).alias("BASIC_RATE"),
            F.col("p_size"),
        )
        fact = _join_lines(fact, "l_partkey", rows["lineitem"], part, "p_partkey", rows["part"]).withColumn(
            "TOTAL_VOLUME_BILLED_LTR", F.col("QTY_PACKS") * F.col("p_size").cast(T.DecimalType(10, 0))
        )
    if set(want) & set(STOCKIEST_COLUMNS):
        sup = read_table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.col("s_name").alias("STOCKIEST"), F.col("s_suppkey").alias("STOCKIEST_CODE")
        )
        fact = _join_lines(fact, "l_suppkey", rows["lineitem"], sup, "s_suppkey", rows["supplier"])
    if last:
        fact = _join_lines(fact, "INVOICE_NO", rows["lineitem"], od, "o_orderkey", rows["orders"])
    return fact.select(*want)


def stored_sales(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The canonical fact read back from a store written by ``io.write_partitioned``
    (month partitions, rows clustered by zone and product).

    At scale the seven-table join is paid once when the store is written; every operator
    accepts this frame in place of :func:`sales`.  ``year_month`` is kept so date filters
    (``kpi.filter_dates`` / ``filter_month``) also prune whole month directories.
    """
    want = list(columns) if columns is not None else list(ALL_COLUMNS)
    df = spark.read.parquet(path)
    return df.select(*want, "year_month")


# The same fact as one SQL string.  It runs unchanged in Spark SQL and in DuckDB, and is
# the CTE every oracle query starts from (tables are the driver's parquet views).
SALES_SQL = """
SELECT r.r_name AS ZONE, n.n_name AS STATE, c.c_name AS CUSTOMER, c.c_custkey AS CUSTOMER_CODE,
       c.c_mktsegment AS CUSTOMER_CATEGORY, s.s_name AS STOCKIEST, s.s_suppkey AS STOCKIEST_CODE,
       p.p_name AS PRODUCT, p.p_type AS PRODUCT_CLASS, p.p_brand AS CODE,
       CAST(p.p_retailprice AS DECIMAL(10,2)) AS PRODUCT_MRP,
       CAST(p.p_retailprice AS DECIMAL(10,2)) AS BASIC_RATE,
       l.l_orderkey AS INVOICE_NO, l.l_linenumber AS LINE_NO,
       CAST(o.o_orderdate AS DATE) AS INVOICE_DATE, o.o_orderpriority AS CHANNEL,
       CAST(l.l_quantity AS DECIMAL(10,2)) AS QTY_PACKS,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) AS GROSS_AMT,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))) AS NET_AMT,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS SCHEME_AMT,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS GRP_SCHEME_AMT,
       CAST(l.l_quantity AS DECIMAL(10,2)) * CAST(p.p_size AS DECIMAL(10,0)) AS TOTAL_VOLUME_BILLED_LTR
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
""".strip()
