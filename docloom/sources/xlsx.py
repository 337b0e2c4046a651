"""Workbooks: one row per file with its sheets, cells, merges and tables as arrays.

The kernel only reads the package; strings, number formats and positions are
resolved by ``docloom.operators.sheets``.  A file that can't be read becomes a
row with ``error`` and empty arrays.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame

from docloom.sources import batches
from docloom.sources.ooxml import Package, PackageError, resolve

SCHEMA = (
    "doc_id string, error string, sheets array<struct<sheet_no:int,sheet_name:string,rows:int,cols:int,reach:int>>, "
    "cells array<struct<sheet_no:int,row:int,col:int,kind:string,raw:string,style:int,formula:string,inline:string>>, "
    "strings array<string>, styles array<int>, formats map<int,string>, "
    "merges array<struct<sheet_no:int,r0:int,c0:int,r1:int,c1:int>>, "
    "tables array<struct<sheet_no:int,name:string,r0:int,c0:int,r1:int,c1:int,header_rows:int>>, "
    "hidden array<struct<sheet_no:int,axis:string,first:int,last:int>>"
)
_REF = re.compile(r"([^0-9]*)([0-9].*)", re.S)
_OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def column_index(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        if "A" <= ch <= "Z":
            n = n * 26 + ord(ch) - 64
    return n


def cell_ref(ref: str) -> tuple[int, int]:
    m = _REF.fullmatch(ref or "")
    if not m:
        return 0, 0
    return (int(m[2]) if m[2].isascii() and m[2].isdigit() else 0), column_index(m[1])


def range_ref(ref: str) -> tuple[int, int, int, int]:
    a, _, b = ref.partition(":")
    r0, c0 = cell_ref(a)
    r1, c1 = cell_ref(b.split(":")[0]) if b else (r0, c0)
    return r0, c0, r1, c1


def _rich(element: Any) -> str:
    """Runs win over plain text."""
    runs = element.findall("r")
    if runs:
        return "".join("".join(t.text or "" for t in r.findall("t")[-1:]) for r in runs)
    return "".join(t.text or "" for t in element.findall("t"))


def _int(text: str | None, default: int = 0) -> int:
    try:
        return int((text or "").strip())
    except ValueError:
        return default


def _true(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "t")


def parse(data: bytes) -> dict[str, Any]:
    if data[:8] == _OLE:
        raise PackageError("encrypted XLSX files are not supported")
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise PackageError("xl/workbook.xml is missing")
    if package.read("xl/_rels/workbook.xml.rels") is None:
        raise PackageError("xl/_rels/workbook.xml.rels is missing")
    relations = package.relations("xl/workbook.xml")
    out: dict[str, Any] = {x: [] for x in ("sheets", "cells", "strings", "styles", "merges", "tables", "hidden")}
    shared = package.xml("xl/sharedStrings.xml")
    out["strings"] = [_rich(si) for si in shared.findall("si")] if shared is not None else []
    styles = package.xml("xl/styles.xml")
    out["formats"] = {}
    if styles is not None:
        out["formats"] = {_int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.findall("numFmts/numFmt")}
        out["styles"] = [_int(x.get("numFmtId")) for x in styles.findall("cellXfs/xf")]
    for sheet in book.findall("sheets/sheet"):
        target = relations.get(sheet.get("id", ""), ("", "", ""))[1]
        part = resolve("xl/workbook.xml", target) if target else ""
        root = package.xml(part) if part else None
        if root is None:
            continue
        n = len(out["sheets"])
        cells, tables = len(out["cells"]), len(out["tables"])
        out["sheets"].append({"sheet_no": n, "sheet_name": sheet.get("name", "")})
        _sheet(package, part, root, n, out)
        edge = [max((c[x] for c in out["cells"][cells:]), default=0) for x in ("row", "col")]
        # what ends beyond the last row of cells and tables ends there
        out["sheets"][-1] |= {"rows": edge[0], "cols": edge[1], "reach": max(edge[0], *(t["r1"] for t in out["tables"][tables:]), 0)}
    return out


def _sheet(package: Package, part: str, root: Any, n: int, out: dict[str, Any]) -> None:
    for c in root.findall("cols/col"):
        if _true(c.get("hidden")):
            out["hidden"].append({"sheet_no": n, "axis": "col", "first": _int(c.get("min")), "last": _int(c.get("max"))})
    for row in root.findall("sheetData/row"):
        number = _int(row.get("r"))
        if _true(row.get("hidden")) and number > 0:
            out["hidden"].append({"sheet_no": n, "axis": "row", "first": number, "last": number})
        for c in row.findall("c"):
            r, col = cell_ref(c.get("r", ""))
            r = r or number
            if r <= 0 or col <= 0:
                continue
            f, v, inline = c.find("f"), c.find("v"), c.find("is")
            out["cells"].append({
                "sheet_no": n, "row": r, "col": col, "kind": c.get("t", ""), "raw": (v.text or "") if v is not None else "",
                "style": _int(c.get("s")), "formula": (f.text or "").strip() if f is not None else "", "inline": _rich(inline) if inline is not None else "",
            })
    for m in root.findall("mergeCells/mergeCell"):
        r0, c0, r1, c1 = range_ref(m.get("ref", ""))
        if min(r0, c0, r1, c1) > 0:
            out["merges"].append({"sheet_no": n, "r0": r0, "c0": c0, "r1": r1, "c1": c1})
    parts = root.findall("tableParts/tablePart")
    relations = package.relations(part) if parts else {}
    for t in parts:
        target = relations.get(t.get("id", ""), ("", "", ""))[1]
        table = package.xml(resolve(part, target)) if target else None
        if table is None:
            continue
        r0, c0, r1, c1 = range_ref(table.get("ref", ""))
        if min(r0, c0, r1, c1) > 0:
            name = table.get("name") or table.get("displayName") or ""
            out["tables"].append({"sheet_no": n, "name": name, "r0": r0, "c0": c0, "r1": r1, "c1": c1, "header_rows": _int(table.get("headerRowCount"), 1)})


def _parsed(data: bytes) -> dict[str, Any]:
    found = parse(data)
    return found | {"formats": list(found["formats"].items())}


def _failed(e: Exception) -> dict[str, Any]:
    return {x: [] for x in ("sheets", "cells", "strings", "styles", "formats", "merges", "tables", "hidden")} | {"error": f"{e or type(e).__name__}"}


def decode(files: DataFrame) -> DataFrame:
    """Workbooks of ``files`` (doc_id, content)."""
    return batches.decode(files, _parsed, _failed, SCHEMA)
