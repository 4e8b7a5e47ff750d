"""Rolling z-score classification against a direct Python implementation of the rule."""

import statistics
from decimal import Decimal, ROUND_HALF_UP

from fixtures import sales_df
from tillroll.operators import anomaly

SERIES = {
    "East": [("2026-01-01", 100), ("2026-01-02", 100), ("2026-01-03", 100), ("2026-01-05", 100),   # constant window, gap
             ("2026-01-06", 0), ("2026-01-07", 104), ("2026-01-08", 96), ("2026-01-09", -20),     # zero, negative
             ("2026-01-10", 101), ("2026-01-11", 99), ("2026-01-12", 40), ("2026-01-13", 180)],
    "West": [("2026-01-01", 50)],                                                                   # one-day zone
    None: [("2026-01-01", 999), ("2026-01-02", 1), ("2026-01-03", 999)],                           # null zone skipped
}


def _r(x, d):
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_UP))


def _expected(th=-1.5):
    out = set()
    for zone, rows in SERIES.items():
        if zone is None:
            continue
        revs = [float(v) for _, v in rows]
        for i, (d, rev) in enumerate(rows):
            look = [v for v in revs[max(0, i - 7):i] if v > 0]
            if len(look) < 2 or rev == 0:
                continue
            mu, sd = statistics.mean(look), statistics.stdev(look)
            z = 0.0 if sd == 0 else (rev - mu) / sd
            sev = ("CRITICAL" if z < -2.5 else "WARNING") if z < th else ("PEAK" if z > 2.0 else None)
            if sev:
                out.add((d, zone, _r(z, 2), _r((rev - mu) / mu * 100, 1), sev))
    return out


def test_detect_anomalies_matches_rule(spark):
    rows = [(z, d, i, v) for z, pts in SERIES.items() for i, (d, v) in enumerate(pts)]
    got = {(r["date"], r["outlet_name"], r["z_score"], r["pct_deviation"], r["severity"])
           for r in anomaly.detect_anomalies(sales_df(spark, rows)).collect()}
    assert got == _expected() and got
