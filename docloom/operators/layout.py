"""Lines and table rows from positioned text.

What a page's items become depends on choices made item after item (anchored
lines, greedy rows, table regions), which no window expresses; they run in one
Python call per page, on its items in order.  All
else is relational.  Order is total: y, then x, then the item's number.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions.text import BULLETS, NOT_NOTES
from docloom.options import LAYOUT, Layout

LINES = (
    "doc_id string, page_idx int, line_no int, x double, y double, h double, w double, font string, text string, "
    "words array<struct<s:string,type:string,format:string>>, is_table_row boolean, is_table_header boolean, table_columns array<string>"
)


class Item(NamedTuple):
    x: float
    y: float
    w: float
    h: float
    text: str
    font: str
    seq: int


@dataclass
class Region:
    """A table's span of y, its columns, and whether its first row is a header."""

    top: float
    bottom: float
    columns: list[float]
    header: bool


@dataclass
class Group:
    items: list[Item]
    columns: list[float] | None = None
    header: bool = False


def by_y(items: Iterable[Item]) -> list[Item]:
    return sorted(items, key=lambda i: (i.y, i.seq))


def by_x(items: Iterable[Item]) -> list[Item]:
    return sorted(items, key=lambda i: (i.x, i.seq))


def column_of(x: float, columns: Sequence[float], tolerance: float = LAYOUT.bucket) -> int:
    """The last column that x reaches, of those before the first it doesn't."""
    n = 0
    for i, c in enumerate(columns):
        if x < c - tolerance:
            break
        n = i
    return n


def _steps(items: Sequence[Item], size: float) -> dict[int, list[Item]]:
    out: dict[int, list[Item]] = defaultdict(list)
    for i in items:
        if i.text.strip():
            out[int(i.y / size)].append(i)
    return out


def _starts(items: Sequence[Item], spacing: float) -> list[float]:
    """x of items that begin a column: at least ``spacing`` after the last."""
    out: list[float] = []
    for i in by_x(items):
        if not out or i.x - out[-1] >= spacing:
            out.append(i.x)
    return out


# --- spaces between items ----------------------------------------------------

_WORDY = re.compile(r"[A-Za-z0-9]")
_MARKS = set("-–.,:;()[]{}_/")
_LITTLE = (" a", " an", " the", " to", " of", " in", " on", " is", " be", " we", " or")
_SPACED = (*_LITTLE, " and", " for")
_WHOLE = {"a", "an", "to", "of", "in", "on", "is", "be", "we", "or", "as", "at", "by", "if", "so", "no", "up", "my"}


def needs_space(before: str, after: str, gap: float, word_gap: float = 25, o: Layout = LAYOUT) -> bool:
    """Whether two items of a line are words of their own; the first rule that applies decides."""
    if gap < 0:
        return False
    last, first = before[-1:], after[:1]
    upper, lower = "A" <= first <= "Z" and bool(first), "a" <= first <= "z" and bool(first)
    if last and last in ".!?" and (upper or lower):
        return True
    if upper and (last and last in "'’\"”" or before.endswith(("'s", "’s"))):
        return True
    if last and last in "-–" or first and first in "-–.,:;":
        return False
    if last and last in "([{" or first and first in ")]}":
        return False
    a, b = bool(_WORDY.fullmatch(last)), bool(_WORDY.fullmatch(first))
    if a and b:
        return before.strip().lower().endswith(_SPACED) or gap > word_gap
    if a and first in _MARKS and first or b and last in _MARKS and last:
        return gap > o.punctuation_gap
    return gap > o.other_gap


def continues_word(before: str, after: str) -> bool:
    """A short lower-case rest of a word that was broken at the end of a line."""
    if not before or not after or not _WORDY.fullmatch(before[-1]) or not "a" <= after[0] <= "z" or len(after.encode()) > 3:
        return False
    low = before.strip().lower()
    return not low.endswith(_LITTLE) and low not in _WHOLE


def _width(item: Item, size: float) -> float:
    if item.w <= 0:
        return len(item.text.encode()) * size * 0.5
    n = len(item.text.strip().encode())
    return n * size * 0.5 if n and item.w < n * size * 0.3 else item.w


def combine(items: Sequence[Item], size: float = 12, o: Layout = LAYOUT) -> str:
    """The text of items in a row, with spaces where they belong."""
    out = ""
    last: Item | None = None
    for item in items:
        text = item.text
        if text.strip()[:1] in tuple(",.:;)]}") and out.endswith(" "):
            out = out.rstrip(" ")
        if not out.endswith(" ") and not text.startswith(" "):
            if last is None:
                if len(text) == 1 and text in BULLETS:
                    text += " "
            elif abs(item.y - last.y) > o.wrap:
                before = last.text.strip()
                if not before.endswith(("-", "–")) and not continues_word(before, text.strip()):
                    out += " "
            elif needs_space(last.text, text, item.x - last.x - _width(last, size), size * o.alnum_factor, o):
                out += " "
        out += text
        last = item
    return out


# --- lines, rows and regions -------------------------------------------------


def lines_of(items: Iterable[Item], distance: float) -> list[list[Item]]:
    """Items within half a line distance of a line's first item, each line from left to right."""
    out: list[list[Item]] = []
    for item in by_y(items):
        if out and abs(out[-1][0].y - item.y) < distance / 2:
            out[-1].append(item)
        else:
            out.append([item])
    return [by_x(line) for line in out]


def rows_of(items: Iterable[Item], columns: Sequence[float], distance: float, o: Layout = LAYOUT) -> list[list[Item]]:
    """Table rows: an item joins the first row in reach that has its column, or is not yet tall."""
    reach = max(3 * distance, o.row_tolerance)
    rows: list[tuple[list[float], list[Item], set[int]]] = []
    for item in by_y(items):
        col = column_of(item.x, columns)
        for span, own, cols in rows:
            if span[0] - reach <= item.y <= span[1] + reach and (col in cols or span[1] - span[0] < reach * 1.2):
                own.append(item)
                cols.add(col)
                span[:] = [min(span[0], item.y), max(span[1], item.y)]
                break
        else:
            rows.append(([item.y, item.y], [item], {col}))
    return [sorted(own, key=lambda i: (column_of(i.x, columns), round(i.y / (o.same_line * 2)), i.x, i.seq)) for _, own, _ in rows]


def _fragments(items: Iterable[Item]) -> float:
    texts = [t for i in items if (t := i.text.strip())]
    return sum("a" <= t[0] <= "z" or t[0] in "-–.,;:" for t in texts) / len(texts) if texts else 0.0


def _columns_of_text(items: Sequence[Item], columns: Sequence[float]) -> bool:
    """Two columns whose right side starts with fragments: running text, not a table."""
    return len(columns) == 2 and _fragments(i for i in items if i.x >= sum(columns) / 2) > 0.3


def is_tabular(items: Sequence[Item], columns: Sequence[float], distance: float) -> bool:
    if len(columns) < 2:
        return False
    steps = _steps(items, max(distance / 2, 5))
    if not steps:
        return False
    mean = sum(map(len, steps.values())) / len(steps)
    return mean / len(columns) <= 2.5 and not _columns_of_text(items, columns)


def find_header(items: Sequence[Item], distance: float, o: Layout = LAYOUT) -> tuple[float, list[float]] | None:
    """y and columns of the best header row; ties go to the upper one."""
    size = max(distance / 2, 5)
    best: tuple[int, float, list[float]] | None = None
    for step, row in sorted(_steps(items, size).items()):
        if not 2 <= len(row) <= 6:
            continue
        columns = _starts([i for i in row if len(i.text.strip().encode()) <= o.header_octets], o.column_spacing)
        if len(columns) < 2:
            continue
        y = step * size
        below = [i for i in items if i.y > y + o.y_tolerance and i.text.strip()]
        aligned = sum(any(abs(i.x - c) < o.alignment for c in columns) for i in below)
        score = len(columns) * 100 - int(y / 10)
        if aligned >= 2 * len(columns) and (best is None or score > best[0]):
            best = (score, y, columns)
    return best[1:] if best else None


def has_tall_cells(items: Sequence[Item], columns: Sequence[float], distance: float, o: Layout = LAYOUT) -> bool:
    """Two rows or more with two lines in one cell."""
    reach = max(2.5 * distance, o.multi_line_tolerance)
    rows: list[list[Item]] = []
    for item in by_y(i for i in items if i.text.strip()):
        for row in rows:
            if min(i.y for i in row) - reach <= item.y <= max(i.y for i in row) + reach:
                row.append(item)
                break
        else:
            rows.append([item])
    tall = [r for r in rows if max(i.y for i in r) - min(i.y for i in r) > 0.8 * distance]
    return sum(any(sum(abs(i.x - c) < o.ref_gap for i in r) >= 2 for c in columns) for r in tall) >= 2


def reference_region(items: Sequence[Item], distance: float, o: Layout = LAYOUT) -> Region | None:
    """A list of entries like [12] with texts to their right."""
    refs = [i for i in items if (t := i.text.strip()).startswith("[") and t.endswith("]") and 3 <= len(t.encode()) <= 10]
    if len(refs) < o.refs:
        return None
    x = refs[0].x
    if sum(abs(i.x - x) < o.alignment for i in refs) / len(refs) < o.ref_share:
        return None
    top, bottom = min(i.y for i in refs), max(i.y for i in refs)
    inside = [i for i in items if i.text.strip() and top - 2 * distance <= i.y <= bottom + distance]
    right = [i.x for i in inside if i.x > x + o.ref_gap]
    if not right:
        return None
    return Region(min(top, *(i.y for i in inside)), bottom, [x, min(right)], False)


def columns_match(a: Sequence[float], b: Sequence[float], o: Layout = LAYOUT) -> bool:
    return len(a) == len(b) and all(abs(x - y) <= 2 * o.alignment for x, y in zip(a, b))


def mean_columns(found: Sequence[Sequence[float]]) -> list[float]:
    return [sum(c) / len(found) for c in zip(*found)] if found else []


def aligned_regions(items: Sequence[Item], distance: float, footer: float, o: Layout = LAYOUT) -> list[Region]:
    """Three or more rows in turn whose columns match those of the first."""
    size = max(distance / 2, 5)
    rows = []
    for step, row in sorted(_steps([i for i in items if i.y < footer], size).items()):
        columns = _starts(row, o.column_spacing) if len(row) > 1 else []
        if len(columns) > 1:
            rows.append((step * size, row, columns))
    out, a = [], 0
    if len(rows) < 3:
        return out
    while a < len(rows):
        b = a + 1
        while b < len(rows) and columns_match(rows[a][2], rows[b][2], o):
            b += 1
        run, a = rows[a:b], b
        if len(run) < 3 or sum(len(r[1]) for r in run) / len(run) / len(run[0][2]) > 2.5:
            continue
        columns, inside = mean_columns([r[2] for r in run]), [i for r in run for i in r[1]]
        if not _columns_of_text(inside, columns):
            out.append(Region(run[0][0], max(run[-1][0], *(i.y for i in inside)), columns, True))
    return out


def regions_of(items: Sequence[Item], distance: float, footer: float, o: Layout = LAYOUT) -> list[Region]:
    out: list[Region] = []
    found = find_header(items, distance, o)
    if found:
        y, columns = found
        inside = [i for i in items if i.text.strip() and y <= i.y < footer]
        if inside and is_tabular(inside, columns, distance):
            top = min(i.y for i in inside)
            named = " ".join(i.text.strip() for i in inside if abs(i.y - top) < o.y_tolerance)
            known = len(inside) >= 3 and any(k in named for k in o.known_headers)
            if known or len(inside) >= 6 and has_tall_cells(inside, columns, distance, o):
                out.append(Region(y, max(y, *(i.y for i in inside)), columns, True))
    refs = reference_region(items, distance, o)
    if refs and not any(refs.top <= r.bottom and refs.bottom >= r.top for r in out):
        out.append(refs)
    return out or aligned_regions(items, distance, footer, o)


def two_columns(items: Sequence[Item]) -> tuple[list[Item], list[Item]] | None:
    """Left and right items of a page of two text columns."""
    if len(items) < 10:
        return None
    lo, hi = min(i.x for i in items), max(i.x for i in items)
    if hi - lo < 200:
        return None
    middle = lo + (hi - lo) / 2
    left, right = [i for i in items if i.x < middle], [i for i in items if i.x >= middle]
    if min(sum(bool(i.text.strip()) for i in side) for side in (left, right)) < 5:
        return None
    a, b = ({int(i.y * 10) for i in side} for side in (left, right))
    if len(a & b) / len(a | b) > 0.3 or _fragments(right) < 0.3:
        return None
    return left, right


def region_at(y: float, regions: Sequence[Region], o: Layout = LAYOUT) -> int | None:
    """Number of the first region around y."""
    return next((n for n, r in enumerate(regions) if r.top - o.region <= y <= r.bottom + o.region), None)


def repeats_itself(text: str) -> bool:
    if len(text.encode()) < 100:
        return False
    words = text.split()
    if len(words) < 6:
        return False
    for k in range(1, 5):
        if len(words) >= 4 * k and sum(words[i : i + k] == words[:k] for i in range(0, len(words) - k + 1, k)) > 5:
            return True
    return False


def page_groups(items: Sequence[Item], distance: float, footer: float, o: Layout = LAYOUT) -> list[Group]:
    """Lines and table rows of a page, from top to bottom (columns of text one after the other)."""
    own = [i for i in items if i.x >= 0 and not repeats_itself(i.text)]
    if not own:
        return []
    regions = regions_of(own, distance, footer, o)
    if not regions:
        sides = two_columns(own)
        return [Group(line) for side in (sides or (own,)) for line in lines_of(side, distance)]
    out: list[Group] = []
    run: list[Item] = []
    at: Region | None = None
    for item in [*by_y(own), None]:
        n = region_at(item.y, regions, o) if item else None
        region = None if n is None else regions[n]
        if run and (item is None or region is not at):
            if at:
                out += [Group(r, at.columns, k == 0 and at.header) for k, r in enumerate(rows_of(run, at.columns, distance, o))]
            else:
                out += [Group(line) for line in lines_of(run, distance)]
            run = []
        if item:
            run.append(item)
            at = region
    return sorted(out, key=lambda g: g.items[0].y)


_CALL = re.compile(r"(.+)\(([0-9]{1,2})\)", re.S)


def words_of(items: Sequence[Item], text: str, style: str | None) -> list[dict[str, str | None]]:
    out = []
    for i, s in enumerate(text.split()):
        kind = "LINK" if s.startswith(("http:", "https:", "www.")) else None
        s = f"http://{s}" if s.startswith("www.") else s
        if s.isascii() and s.isdigit() and i < len(items) and items[i].y > items[0].y:
            kind = "FOOTNOTE_LINK"
        m = _CALL.fullmatch(s)
        if m and m[1].lower() not in NOT_NOTES:
            s = f"{m[1]}[^{int(m[2])}]"
        out.append({"s": s, "type": kind, "format": style})
    return out


def line_row(group: Group, styles: dict[str, str | None]) -> dict[str, Any] | None:
    items = group.items
    heights = [i.h for i in items if i.h >= 4]
    size = sum(heights) / len(heights) if heights else 12.0
    words = words_of(items, combine(items, size), styles.get(items[0].font))
    if not words:
        return None
    columns: list[str] | None = None
    if group.columns is not None:
        cells: list[list[Item]] = [[] for _ in group.columns]
        for i in items:
            cells[column_of(i.x, group.columns)].append(i)
        columns = [combine(sorted(c, key=lambda i: (round(i.y / (2 * LAYOUT.same_line)), i.x, i.seq))).strip() for c in cells]
    return {
        "x": items[0].x, "y": items[0].y, "h": max((i.h for i in items if i.text.strip()), default=0.0), "w": sum(i.w for i in items),
        "font": items[0].font, "text": " ".join(w["s"] or "" for w in words), "words": words,
        "is_table_row": group.columns is not None, "is_table_header": group.header, "table_columns": columns,
    }


# --- Spark -------------------------------------------------------------------


def _item(r: dict[str, Any]) -> Item:
    return Item(*(float(r.get(c) or 0.0) for c in ("x", "y", "width", "height")), r.get("text") or "", r.get("font") or "", int(r["seq"]))


def by_group(rows: DataFrame, keys: Sequence[str], make: Callable[[list[dict[str, Any]]], Iterable[dict[str, Any]]], schema: str) -> DataFrame:
    """Rows that ``make`` gives for the rows of each group; a batch holds many groups, so a small one costs no call of its own."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        key: tuple | None = None
        for batch in batches:
            out: list[dict[str, Any]] = []
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key and held:
                    out += make(held)
                    held = []
                key = now
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(list(make(held)), arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def lines(items: DataFrame, stats: DataFrame, pages: DataFrame, o: Layout = LAYOUT) -> DataFrame:
    """Lines of (doc_id, page_idx, seq, x, y, width, height, text, font) items: the schema ``LINES``.

    ``stats`` gives each document's line distance and styles of fonts, ``pages``
    the heights.  A page is laid out by itself, so a document of very many pages
    is spread over the workers.
    """
    known = stats.select("doc_id", "distance", "styles")
    rows = items.join(known, "doc_id").join(pages.select("doc_id", "page_idx", F.col("height").alias("page_h")), ["doc_id", "page_idx"], "left")

    def make(own: list[dict[str, Any]]) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        first = own[0]
        styles = dict(first["styles"] or ())
        footer = first["page_h"] * o.footer_share if first["page_h"] else o.footer_y
        for group in page_groups([_item(r) for r in own], float(first["distance"]), footer, o):
            row = line_row(group, styles)
            if row:
                out.append({"doc_id": first["doc_id"], "page_idx": first["page_idx"], "line_no": len(out)} | row)
        return out

    return by_group(rows, ["doc_id", "page_idx"], make, LINES)


def line_numbers(items: DataFrame, distance: float) -> DataFrame:
    """(doc_id, seq, line_no) of (doc_id, seq, x, y): anchored lines, numbered from 0."""

    def make(own: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [{"doc_id": own[0]["doc_id"], "seq": i.seq, "line_no": n} for n, line in enumerate(lines_of(map(_item, own), distance)) for i in line]

    return by_group(items.select("doc_id", "seq", "x", "y"), ["doc_id"], make, "doc_id bigint, seq int, line_no int")


def table_rows(items: DataFrame, columns: Sequence[float], distance: float) -> DataFrame:
    """(doc_id, seq, row_no) of (doc_id, seq, x, y): greedy table rows, numbered from 0."""

    def make(own: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [{"doc_id": own[0]["doc_id"], "seq": i.seq, "row_no": n} for n, row in enumerate(rows_of(map(_item, own), columns, distance)) for i in row]

    return by_group(items.select("doc_id", "seq", "x", "y"), ["doc_id"], make, "doc_id bigint, seq int, row_no int")


def columns_at(items: DataFrame, columns: Sequence[float]) -> DataFrame:
    """``items`` (x, …) with col, the number of the column that x is in."""

    @F.pandas_udf("int")
    def col(x: pd.Series) -> pd.Series:
        return pd.Series([column_of(v, columns) for v in x], dtype="int32")

    return items.withColumn("col", col("x"))


def regions_at(items: DataFrame, spans: Sequence[tuple[float, float]]) -> DataFrame:
    """``items`` (y, …) with region, the number of the first (top, bottom) around y."""
    regions = [Region(a, b, [], False) for a, b in spans]

    @F.pandas_udf("int")
    def region(y: pd.Series) -> pd.Series:
        return pd.Series([region_at(v, regions) for v in y], dtype="Int32")

    return items.withColumn("region", region("y"))


def repetitive(text: Column) -> Column:
    """Whether a text repeats a phrase over and over."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repeats_itself(t or ""))

    return found(text)


def words(text: Column) -> Column:
    """The words of a line of one item, with links and calls of notes."""

    @F.pandas_udf("array<struct<s:string,type:string,format:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words_of([Item(0, 0, 0, 0, t or "", "", 0)], t or "", None))

    return found(text)


def pages_of_two_columns(items: DataFrame) -> DataFrame:
    """(doc_id, two_columns): whether the items (doc_id, seq, x, y, text) are two columns of text."""

    def make(own: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return [{"doc_id": own[0]["doc_id"], "two_columns": two_columns([_item(r) for r in own]) is not None}]

    return by_group(items.select("doc_id", "seq", "x", "y", "text"), ["doc_id"], make, "doc_id bigint, two_columns boolean")
