"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "-•–—◦○●▪■□▸►▹▻★☆·∙⁃"
#: What ends a word without a space before it.
PUNCTUATION = (".", "!", "?")
ORDERED = r"^(?:[0-9]+[.)]\s|[a-z][.)]\s|[A-Z][.)]\s|(?:x{0,3}(?:ix|iv|v?i{0,3}))[.)]\s|(?:X{0,3}(?:IX|IV|V?I{0,3}))[.)]\s)"
NOT_NOTES = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "time", "date", "daytime", "printf", "scanf",
    "malloc", "free", "exit", "open", "close", "read", "write", "socket", "connect", "bind", "listen",
)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def is_bullet(text: Column) -> Column:
    """Exactly one bullet character."""
    return text.isin(*BULLETS)


def is_ordered_item(text: Column) -> Column:
    """A number, letter or roman numeral, then '.' or ')' and white space."""
    return text.rlike(ORDERED)


def is_bullet_line(text: Column) -> Column:
    return text.rlike(r"^\s*[-•–]\s")


def list_level(x: Column, least_x: Column) -> Column:
    """Steps of 20 points from the leftmost item, 0 to 6."""
    return F.greatest(F.lit(0), F.least(F.lit(6), F.floor((x - least_x) / 20).cast("int")))


def join_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("- "), F.lit(""))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\n|\r", " ")


def is_table(text: Column) -> Column:
    """Two lines or more that start with a bar and hold another."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: strip(x).rlike(r"^\|.*\|"))) >= 2


def header_key(line: Column) -> Column:
    """A table header's cells, lower-cased and trimmed, without empty ones."""
    return F.array_join(F.filter(F.transform(F.split(line, r"\|"), lambda c: F.lower(strip(c))), lambda c: c != ""), "|")


def compact(markdown: Column) -> Column:
    """One blank line at most, none at the ends, a line end at the end."""
    text = F.regexp_replace(F.replace(markdown, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")
    return F.concat(strip(text), F.lit("\n"))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def heading_prefix(kind: Column) -> Column:
    """'## ' for H2, '' for what isn't a heading."""
    return F.when(kind.rlike("^H[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(kind, 2, F.lit(1)).cast("int")), F.lit(" "))).otherwise(F.lit(""))


def heading_kind(level: Column) -> Column:
    return F.concat(F.lit("H"), F.greatest(F.lit(1), F.least(F.lit(6), level)).cast("string"))


def roman(n: Column) -> Column:
    """Lower-case roman numeral of 1 to 3999, '' for others."""
    values = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    rest, parts = n.cast("int"), []
    for value, sign in values:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when((n >= 1) & (n <= 3999), F.concat(*parts)).otherwise(F.lit(""))


def list_prefix(fmt: Column, n: Column, compat: bool = False) -> Column:
    """What a list item starts with; ``compat`` prints the last digit of decimal numbers only."""
    letter = lambda base: F.char(F.lit(base) + F.pmod(n - 1, F.lit(26)))
    decimal = F.pmod(n, F.lit(10)) if compat else n
    dot = lambda c: F.concat(c, F.lit(". "))
    return (
        F.when(fmt == "none", F.lit(""))
        .when(fmt.isin("decimal", "decimalZero"), dot(decimal.cast("string")))
        .when(fmt == "lowerLetter", dot(letter(97)))
        .when(fmt == "upperLetter", dot(letter(65)))
        .when(fmt == "lowerRoman", dot(roman(n)))
        .when(fmt == "upperRoman", dot(F.upper(roman(n))))
        .otherwise(F.lit("- "))
    )


def line_hash(text: Column) -> Column:
    """31-polynomial hash of the bytes but digits, spaces and 0xA0 bytes, modulo 2^31."""
    digits = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(text))), lambda i: F.octet_length(text) > 0)
    code = lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    kept = F.filter(F.transform(digits, code), lambda c: ~((c >= 48) & (c <= 57)) & (c != 32) & (c != 160))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(1 << 31))
