"""Raw sales feeds (all-string, spreadsheet-style headers), derived from the driver tables.

The reference cleans four spreadsheet exports.  Spreadsheet decoding is not rebuilt
(feeds enter as CSV/Parquet); these builders produce the same *shape* of input from the
sales lines so the cleaning operators run on data that grows with the tables:

* item-level tax-charge feed and hourly item feed: one row per invoice line;
* daily outlet summary and delivery-aggregator feed: one row per (date, zone[, channel]).

Dirt is injected by fixed arithmetic rules on the line key ``k = 7·order + line`` (every
row is kept): padded header names, blank outlet (k % 101 = 0), unparseable date
(k % 97 = 0), unparseable amount (k % 89 = 0), all-empty row (k % 211 = 0), and dates
written in three formats.  ``*_SQL`` twins build the same frames in DuckDB.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import sales

_LINE_COLS = ["INVOICE_NO", "LINE_NO", "INVOICE_DATE", "ZONE", "STATE", "PRODUCT", "CODE", "CHANNEL",
              "PRODUCT_CLASS", "BASIC_RATE", "QTY_PACKS", "NET_AMT", "GROSS_AMT", "SCHEME_AMT", "GRP_SCHEME_AMT"]


def _key() -> Column:
    return F.col("INVOICE_NO") * 7 + F.col("LINE_NO")


def _date_text(d: Column, k: Column) -> Column:
    fmt = (
        F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 3 == 1, F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )
    return F.when(k % 97 == 0, F.lit("not a date")).otherwise(fmt)


def _money_text(x: Column, k: Column) -> Column:
    return F.when(k % 89 == 0, F.lit("n/a")).otherwise(F.round(x, 2).cast("decimal(18,2)").cast("string"))


def _plain_money(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(18,2)").cast("string")


def _clock(k: Column) -> Column:
    """hh:mm of a day's trade, 06:00 to 22:59."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two((k % 17) + 6), F.lit(":"), two(k % 60))


def _outlet_text(z: Column, k: Column) -> Column:
    return F.when(k % 101 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), z, F.lit(" ")))


def _blank_row(df: DataFrame, k: Column) -> DataFrame:
    """Rows with k % 211 = 0 become all-empty (every column null)."""
    return df.select(*[F.when(k % 211 != 0, F.col(c)).alias(c) for c in df.columns])


def tax_charge_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir, _LINE_COLS)
    k = _key()
    out = s.select(
        _outlet_text(F.col("ZONE"), k).alias("  Location Name "),
        F.col("PRODUCT").alias("Product Name "),
        F.col("CODE").alias("Brand Name"),
        F.col("CHANNEL").alias("Channel Type"),
        F.col("INVOICE_NO").cast("string").alias("Bill No"),
        F.col("PRODUCT_CLASS").alias("Product Group"),
        F.col("BASIC_RATE").cast("string").alias("BaiscRate"),
        F.col("STATE").alias("City"),
        _date_text(F.col("INVOICE_DATE"), k).alias("Date"),
        F.col("QTY_PACKS").cast("string").alias("Sales Qty"),
        _money_text(F.col("NET_AMT"), k).alias("Net Amt"),
        F.concat(F.lit("Special "), (k % 4).cast("string")).alias("Product Special Category"),
        _plain_money(F.col("GRP_SCHEME_AMT") * F.lit(Decimal("0.5"))).alias("CGST Amt"),
        _plain_money(F.col("GRP_SCHEME_AMT") * F.lit(Decimal("0.5"))).alias("SGST Amt"),
        _plain_money(F.col("GRP_SCHEME_AMT")).alias("Total GST Amt"),
        _clock(k).alias("KOT Print Time"),
        F.concat(F.lit("Taker "), (k % 25).cast("string")).alias("Order Taker"),
        k.alias("_k"),
    )
    return _blank_row(out, F.col("_k")).drop("_k")


def hourly_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir, _LINE_COLS)
    k = _key()
    out = s.select(
        _outlet_text(F.col("ZONE"), k).alias("Location"),
        F.col("PRODUCT").alias("Product Name"),
        _money_text(F.col("NET_AMT"), k).alias("Net Amt"),
        _date_text(F.col("INVOICE_DATE"), k).alias("Date"),
        F.col("QTY_PACKS").cast("string").alias("Qty"),
        F.concat(F.lpad(((k % 17) + 6).cast("string"), 2, "0"), F.lit(":00")).alias("Hours"),
        F.col("CHANNEL").alias("Type"),
        F.date_format("INVOICE_DATE", "EEEE").alias("Day Of Week"),
        F.col("CODE").alias("Brand Name"),
        F.concat(F.lit("W"), (k % 9).cast("string")).alias("WOK ID"),
        _plain_money(F.col("GROSS_AMT")).alias("Basic Amt"),
        _plain_money(F.col("SCHEME_AMT")).alias("Void Amt"),
        (k % 997).cast("string").alias("ProductID"),
        F.dayofweek("INVOICE_DATE").cast("string").alias("DayNo"),
        k.alias("_k"),
    )
    return _blank_row(out, F.col("_k")).drop("_k")


def _channel_bucket(c: Column) -> Column:
    return F.when(c == "1-URGENT", "dine_in").when(c == "2-HIGH", "carry_out").otherwise("delivery")


def dsr_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir, ["INVOICE_DATE", "ZONE", "STATE", "INVOICE_NO", "NET_AMT", "GROSS_AMT", "SCHEME_AMT"])
    g = s.groupBy("INVOICE_DATE", "ZONE").agg(
        F.min("STATE").alias("state"), F.sum("NET_AMT").alias("net"), F.sum("GROSS_AMT").alias("gross"),
        F.sum("SCHEME_AMT").alias("disc"), F.count_distinct("INVOICE_NO").alias("orders"),
    )
    return g.select(
        F.col("ZONE").alias("Restaurant Name"),
        F.date_format("INVOICE_DATE", "yyyy-MM-dd").alias("Date"),
        F.round("net", 2).cast("decimal(18,2)").cast("string").alias("Total Net Sale"),
        F.col("orders").cast("string").alias("Total Order Count"),
        F.round("gross", 2).cast("decimal(18,2)").cast("string").alias("Total Gross Sale"),
        F.round("disc", 2).cast("decimal(18,2)").cast("string").alias("Total Discount"),
        F.col("state").alias("State"),
    )


def aggregator_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir, ["INVOICE_DATE", "ZONE", "CHANNEL", "INVOICE_NO", "NET_AMT", "GROSS_AMT"])
    g = s.filter(_channel_bucket(F.col("CHANNEL")) == "delivery").groupBy(
        "INVOICE_DATE", "ZONE", F.col("CHANNEL").alias("agg")
    ).agg(F.sum("NET_AMT").alias("net"), F.sum("GROSS_AMT").alias("bill"), F.count_distinct("INVOICE_NO").alias("orders"))
    return g.select(
        F.col("ZONE").alias("Restaurant Name"),
        F.col("agg").alias("Aggregator Name"),
        F.date_format("INVOICE_DATE", "yyyy-MM-dd").alias("Date"),
        F.round("net", 2).cast("decimal(18,2)").cast("string").alias("Net Sales"),
        F.col("orders").cast("string").alias("Order Count"),
        F.round("bill", 2).cast("decimal(18,2)").cast("string").alias("Bill Amt"),
    )


FEEDS = {
    "tax_charge": tax_charge_feed,
    "hourly": hourly_feed,
    "dsr": dsr_feed,
    "aggregator": aggregator_feed,
}


# ── DuckDB twins ─────────────────────────────────────────────────────────────
def _sql_date(d: str, k: str) -> str:
    return (f"CASE WHEN {k} % 97 = 0 THEN 'not a date' WHEN {k} % 3 = 0 THEN strftime({d}, '%Y-%m-%d') "
            f"WHEN {k} % 3 = 1 THEN strftime({d}, '%m/%d/%Y') ELSE strftime({d}, '%Y-%m-%d %H:%M:%S') END")


def _sql_money(x: str, k: str) -> str:
    return f"CASE WHEN {k} % 89 = 0 THEN 'n/a' ELSE CAST(CAST(ROUND({x}, 2) AS DECIMAL(18,2)) AS VARCHAR) END"


def _sql_plain(x: str) -> str:
    return f"CAST(CAST(ROUND({x}, 2) AS DECIMAL(18,2)) AS VARCHAR)"


def _sql_outlet(z: str, k: str) -> str:
    return f"CASE WHEN {k} % 101 = 0 THEN '   ' ELSE ' ' || {z} || ' ' END"


def _blank_sql(cols: list[tuple[str, str]], src: str) -> str:
    sel = ", ".join(f"CASE WHEN _k % 211 <> 0 THEN {e} END AS \"{n}\"" for n, e in cols)
    return f"SELECT {sel} FROM (SELECT *, INVOICE_NO * 7 + LINE_NO AS _k FROM {src})"


def feed_sql(name: str) -> str:
    """SELECT producing the raw feed ``name`` from the ``sales`` CTE."""
    k = "_k"
    if name == "tax_charge":
        return _blank_sql([
            ("  Location Name ", _sql_outlet("ZONE", k)), ("Product Name ", "PRODUCT"), ("Brand Name", "CODE"),
            ("Channel Type", "CHANNEL"), ("Bill No", "CAST(INVOICE_NO AS VARCHAR)"), ("Product Group", "PRODUCT_CLASS"),
            ("BaiscRate", "CAST(BASIC_RATE AS VARCHAR)"), ("City", "STATE"), ("Date", _sql_date("INVOICE_DATE", k)),
            ("Sales Qty", "CAST(QTY_PACKS AS VARCHAR)"), ("Net Amt", _sql_money("NET_AMT", k)),
            ("Product Special Category", f"'Special ' || ({k} % 4)"),
            ("CGST Amt", _sql_plain("GRP_SCHEME_AMT * CAST(0.5 AS DECIMAL(2,1))")),
            ("SGST Amt", _sql_plain("GRP_SCHEME_AMT * CAST(0.5 AS DECIMAL(2,1))")), ("Total GST Amt", _sql_plain("GRP_SCHEME_AMT")),
            ("KOT Print Time", f"lpad(CAST({k} % 17 + 6 AS VARCHAR), 2, '0') || ':' || lpad(CAST({k} % 60 AS VARCHAR), 2, '0')"),
            ("Order Taker", f"'Taker ' || ({k} % 25)"),
        ], "sales")
    if name == "hourly":
        return _blank_sql([
            ("Location", _sql_outlet("ZONE", k)), ("Product Name", "PRODUCT"), ("Net Amt", _sql_money("NET_AMT", k)),
            ("Date", _sql_date("INVOICE_DATE", k)), ("Qty", "CAST(QTY_PACKS AS VARCHAR)"),
            ("Hours", f"lpad(CAST({k} % 17 + 6 AS VARCHAR), 2, '0') || ':00'"), ("Type", "CHANNEL"),
            ("Day Of Week", "strftime(INVOICE_DATE, '%A')"), ("Brand Name", "CODE"), ("WOK ID", f"'W' || ({k} % 9)"),
            ("Basic Amt", _sql_plain("GROSS_AMT")), ("Void Amt", _sql_plain("SCHEME_AMT")),
            ("ProductID", f"CAST({k} % 997 AS VARCHAR)"), ("DayNo", "CAST(dayofweek(INVOICE_DATE) + 1 AS VARCHAR)"),
        ], "sales")
    if name == "dsr":
        return """SELECT ZONE AS "Restaurant Name", strftime(INVOICE_DATE, '%Y-%m-%d') AS "Date",
       CAST(CAST(ROUND(SUM(NET_AMT), 2) AS DECIMAL(18,2)) AS VARCHAR) AS "Total Net Sale",
       CAST(COUNT(DISTINCT INVOICE_NO) AS VARCHAR) AS "Total Order Count",
       CAST(CAST(ROUND(SUM(GROSS_AMT), 2) AS DECIMAL(18,2)) AS VARCHAR) AS "Total Gross Sale",
       CAST(CAST(ROUND(SUM(SCHEME_AMT), 2) AS DECIMAL(18,2)) AS VARCHAR) AS "Total Discount",
       MIN(STATE) AS "State"
FROM sales GROUP BY INVOICE_DATE, ZONE"""
    if name == "aggregator":
        return """SELECT ZONE AS "Restaurant Name", CHANNEL AS "Aggregator Name", strftime(INVOICE_DATE, '%Y-%m-%d') AS "Date",
       CAST(CAST(ROUND(SUM(NET_AMT), 2) AS DECIMAL(18,2)) AS VARCHAR) AS "Net Sales",
       CAST(COUNT(DISTINCT INVOICE_NO) AS VARCHAR) AS "Order Count",
       CAST(CAST(ROUND(SUM(GROSS_AMT), 2) AS DECIMAL(18,2)) AS VARCHAR) AS "Bill Amt"
FROM sales WHERE CHANNEL NOT IN ('1-URGENT', '2-HIGH') GROUP BY INVOICE_DATE, ZONE, CHANNEL"""
    raise KeyError(name)


# Raw header names per feed (what a reader sees before S2 strips them).
RAW_HEADERS = {
    "tax_charge": ["  Location Name ", "Product Name ", "Brand Name", "Channel Type", "Bill No", "Product Group",
                   "BaiscRate", "City", "Date", "Sales Qty", "Net Amt", "Product Special Category", "CGST Amt", "SGST Amt",
                   "Total GST Amt", "KOT Print Time", "Order Taker"],
    "hourly": ["Location", "Product Name", "Net Amt", "Date", "Qty", "Hours", "Type", "Day Of Week", "Brand Name", "WOK ID",
               "Basic Amt", "Void Amt", "ProductID", "DayNo"],
    "dsr": ["Restaurant Name", "Date", "Total Net Sale", "Total Order Count", "Total Gross Sale", "Total Discount", "State"],
    "aggregator": ["Restaurant Name", "Aggregator Name", "Date", "Net Sales", "Order Count", "Bill Amt"],
}
