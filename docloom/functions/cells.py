"""Spreadsheet functions: references, number formats, display of values."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import strip

_DATE_IDS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
_MONEY_IDS = {5, 6, 7, 8, 41, 42, 44}
_SYMBOLS = "$€£¥"
_EPOCH = datetime(1899, 12, 30)


def column_letters(col: Column) -> Column:
    """1 -> A, 27 -> AA, 703 -> AAA; '' for less than 1."""
    n = col.cast("long")
    one = lambda v: F.char(F.lit(65) + F.pmod(v, F.lit(26)))
    # bijective base 26: the digits of n - 1, then of (n - 27) div 26 ...
    parts, value = [], n - 1
    for _ in range(7):
        parts.append(F.when(value >= 0, one(value)).otherwise(F.lit("")))
        value = F.floor(value / 26) - 1
    return F.concat(*reversed(parts))


def column_number(letters: Column) -> Column:
    """A -> 1, AA -> 27; other characters are skipped."""
    clean = F.regexp_replace(F.upper(letters), "[^A-Z]", "")
    return F.aggregate(F.filter(F.split(clean, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 64)


def cell_row(ref: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(ref, "^[^0-9]*([0-9]+)$", 1), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))


def range_name(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    a = F.concat(column_letters(c0), r0.cast("string"))
    b = F.concat(column_letters(c1), r1.cast("string"))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(":"), b))


def plain_number(value: float) -> str:
    """Shortest digits that read back as the value, never with an exponent."""
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else ("+Inf" if value > 0 else "-Inf")
    if value == int(value) and abs(value) < 1e15:
        return str(int(value)) if value or math.copysign(1, value) > 0 else "-0"
    text = format(Decimal(repr(value)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _decimals(code: str) -> int:
    _, dot, rest = code.partition(".")
    return len(rest) - len(rest.lstrip("0#")) if dot else 0


def excel_date(serial: float, code: str) -> str:
    days = int(serial)
    frac = max(0.0, serial - days)
    at = _EPOCH + timedelta(days=days) + timedelta(microseconds=int(frac * 86_400_000_000))
    bare = code.lower().replace("\\", "").replace('"', "")
    timed = serial != days or any(c in bare for c in "hs")
    return at.strftime("%Y-%m-%d %H:%M:%S" if timed else "%Y-%m-%d") if at.year >= 1000 else f"{at.year:04d}" + at.strftime("-%m-%d %H:%M:%S" if timed else "-%m-%d")


def format_value(raw: str, format_id: int, code: str) -> str:
    """A numeric cell's text under its number format; other text as it is, trimmed."""
    text = raw.strip()
    if not text or "_" in text:
        return text
    try:
        value = float(text)
    except ValueError:
        return text
    code = code or ""
    bare = code.lower().replace("\\", "").replace('"', "")
    try:
        if format_id in _DATE_IDS or any(c in bare for c in "ymdhis"):
            return excel_date(value, code)
    except (OverflowError, ValueError):
        return plain_number(value)
    if format_id in (9, 10) or "%" in code:
        return f"{value * 100:.{_decimals(code.partition('%')[0])}f}%"
    if format_id in _MONEY_IDS or any(c in code for c in _SYMBOLS):
        symbol = next((s for s in _SYMBOLS if s in code), "$")
        return f"{symbol}{value:.{_decimals(code)}f}"
    return plain_number(value)


@F.pandas_udf(StringType())
def formatted(raw: pd.Series, format_id: pd.Series, code: pd.Series) -> pd.Series:
    """Number formatting, a batch at a time; each distinct input is formatted once."""
    known: dict[tuple, str | None] = {}
    out = []
    for key in zip(raw, format_id, code):
        if key not in known:
            r, i, c = key
            known[key] = None if r is None else format_value(r, -1 if i is None or i != i else int(i), c or "")
        out.append(known[key])
    return pd.Series(out, dtype=object)


def clean_cell(value: Column) -> Column:
    """A value as the text of a Markdown table cell."""
    text = F.regexp_replace(strip(value), "\r\n|\r", "\n")
    return F.replace(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))
