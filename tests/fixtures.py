"""Paths of the given tables, and tiny canonical-sales frames."""

from decimal import Decimal

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

SALES_SCHEMA = (
    "ZONE string, INVOICE_DATE date, INVOICE_NO bigint, NET_AMT decimal(18,4), PRODUCT string, "
    "QTY_PACKS decimal(10,2), TOTAL_VOLUME_BILLED_LTR decimal(20,2), BASIC_RATE decimal(10,2), PRODUCT_CLASS string"
)


def sales_df(spark, rows):
    """rows: (zone, 'YYYY-MM-DD', invoice_no, net_amt[, product, qty])"""
    import datetime as dt

    out = []
    for r in rows:
        zone, d, inv, amt = r[:4]
        prod = r[4] if len(r) > 4 else None
        qty = r[5] if len(r) > 5 else 1
        out.append((zone, dt.date.fromisoformat(d), inv, Decimal(str(amt)), prod, Decimal(str(qty)), Decimal("0"),
                    Decimal("10.00"), "cls"))
    return spark.createDataFrame(out, SALES_SCHEMA)


def series(spark, values, zone="O1", start="2026-01-01"):
    import datetime as dt

    d0 = dt.date.fromisoformat(start)
    return sales_df(spark, [(zone, (d0 + dt.timedelta(days=i)).isoformat(), i + 1, v) for i, v in enumerate(values)])
