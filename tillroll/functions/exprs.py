"""Column-expression helpers shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ── Fixed values that must equal the reference's behaviour ─────────────────────
# Weekday names, Sunday first (SQLite %w numbering: 0 = Sunday).
WEEKDAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def money(c: Column | str, digits: int = 2) -> Column:
    """Round (half-up) and hand back a double; the inputs are exact decimals."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).cast("double")


def day_str(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd")


def weekday_name(d: Column | str) -> Column:
    """Sunday..Saturday name of a date (``dayofweek`` is 1 = Sunday)."""
    col = F.col(d) if isinstance(d, str) else d
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.dayofweek(col))


# ASCII whitespace removed by Python's str.strip() (space, \t, \n, \r, \v, \f).
WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column | str) -> Column:
    """Python-style strip of surrounding ASCII whitespace (character-set trim, no regex)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col, F.lit(WHITESPACE))


def non_empty(c: Column | str) -> Column:
    """F6 — not null and not the empty string."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != F.lit(""))


def equals_ci(c: Column | str, value: str) -> Column:
    """F9 — case-insensitive equality."""
    col = F.col(c) if isinstance(c, str) else c
    return F.upper(col) == F.upper(F.lit(value))


def contains_ci(cols: list[str], text: str) -> Column:
    """F7 — case-insensitive ``%text%`` over several columns, ORed."""
    pat = f"%{text}%"
    out = None
    for c in cols:
        term = F.col(c).ilike(pat)
        out = term if out is None else (out | term)
    return out


def label_before_paren(c: Column | str, width: int = 28) -> Column:
    """``name.split('(')[0].strip()[:width]``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.left(F.trim(F.split_part(col, F.lit("("), F.lit(1))), F.lit(width))


def plain_number(c: Column) -> Column:
    """Double of a decimal literal in text; null for anything else (type suffixes, NaN, words)."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[ \t\n\r\x0B\f]*[0-9.+\-eE]+[ \t\n\r\x0B\f]*\z"), text.try_cast("double"))


def lakhs(x: Column) -> Column:
    """Rupees in lakhs (1e5)."""
    return x / F.lit(1e5)


def crores(x: Column) -> Column:
    """Rupees in crores (1e7)."""
    return x / F.lit(1e7)


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a text."""
    return F.left(F.sha2(text, 256), F.lit(16))


def rnd(x: Column, digits: int) -> Column:
    """Round a double through DECIMAL(38,6), half away from zero, back to double.

    Ratios are computed as ``double(exact decimal sum) / count`` so every engine feeds the
    same IEEE value into the rounding; the decimal step removes last-ulp noise.
    """
    return F.round(x.cast("decimal(38,6)"), digits).cast("double")


def fdiv(num: Column, den: Column) -> Column:
    """num / den in double; null when den is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
