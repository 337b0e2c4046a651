"""Text documents: one row per file with its paragraphs, styles, notes and images as arrays.

``paras`` holds paragraphs and table rows in document order; ``words`` are the
runs as they stand.  A file that can't be read becomes a row with ``error``.
"""

from __future__ import annotations

import functools
import re
import zipfile
from typing import Any

from pyspark.sql import DataFrame

from docloom.sources import batches
from docloom.sources.ooxml import Package, PackageError, parsed

_WORDS = "array<struct<s:string,type:string,format:string>>"
SCHEMA = (
    f"doc_id string, error string, paras array<struct<seq:int,kind:string,style_id:string,num_id:int,ilvl:int,words:{_WORDS},cells:array<string>,is_first_row:boolean,table_no:int>>, "
    "styles array<struct<style_id:string,name:string,outline_lvl:int>>, levels array<struct<num_id:int,ilvl:int,num_fmt:string>>, "
    "rels array<struct<rel_id:string,type:string,target:string,mode:string>>, "
    "notes array<struct<note_kind:string,note_id:string,text:string>>, note_refs array<struct<note_kind:string,ref_seq:int,note_id:string>>, "
    "sides array<struct<side:string,part:string,text:string>>, images array<struct<image_id:string,ord:int,source_name:string,alt:string,data:binary>>"
)
COLUMNS = ["doc_id", "error", "paras", "styles", "levels", "rels", "notes", "note_refs", "sides", "images"]
_LEADING = re.compile(r"\s*([+-]?[0-9]+)")
_OFF = {"0", "false", "off"}


def _number(text: str | None) -> int:
    m = _LEADING.match(text or "")
    return int(m[1]) if m else 0


def _on(e: Any) -> bool:
    return e is not None and (e.get("val") or "").lower() not in _OFF


@functools.lru_cache(64)
def _levels(data: bytes) -> list[dict[str, Any]]:
    try:
        root = parsed("word/numbering.xml", data)
    except PackageError:
        return []
    abstract: dict[int, dict[int, str]] = {}
    for a in root.findall("abstractNum"):
        own: dict[int, str] = {}
        for lvl in a.findall("lvl"):
            fmt = lvl.find("numFmt")
            own.setdefault(_number(lvl.get("ilvl")), fmt.get("val", "bullet") if fmt is not None else "bullet")
        abstract.setdefault(_number(a.get("abstractNumId")), own)
    out: dict[tuple[int, int], str] = {}
    for n in root.findall("num"):
        to = n.find("abstractNumId")
        for i, fmt in abstract.get(_number(to.get("val")) if to is not None else -1, {}).items():
            out.setdefault((_number(n.get("numId")), i), fmt)
    return [{"num_id": n, "ilvl": i, "num_fmt": f} for (n, i), f in out.items()]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.package = Package(data)
        self.rels = self.package.relations("word/document.xml")
        self.images: list[dict[str, Any]] = []
        self.refs: list[tuple[str, str]] = []

    def document(self) -> dict[str, Any]:
        root = self.package.xml("word/document.xml")
        if root is None:
            raise PackageError("word/document.xml is missing")
        paras: list[dict[str, Any]] = []
        tables = 0
        body = root.find("body")
        for e in body if body is not None else ():
            if e.tag == "p":
                paras.append(self.paragraph(e))
            elif e.tag == "tbl":
                tables += 1
                for i, row in enumerate(e.findall("tr")):
                    cells = [" ".join(t for x in c.iter("t") if (t := x.text or "")).strip() for c in row.findall("tc")]
                    paras.append({"kind": "tr", "style_id": None, "num_id": None, "ilvl": None, "words": [], "cells": cells, "is_first_row": i == 0, "table_no": tables})
        return {
            "paras": [{"seq": i} | p for i, p in enumerate(paras)], "styles": self.styles(), "levels": self.levels(), "notes": self.notes(),
            "rels": [{"rel_id": i, "type": t, "target": to, "mode": m} for i, (t, to, m) in self.rels.items()],
            "note_refs": [{"note_kind": k, "ref_seq": i, "note_id": n} for i, (k, n) in enumerate(self.refs)], "sides": self.sides(), "images": self.images,
        }

    def paragraph(self, p: Any) -> dict[str, Any]:
        props = p.find("pPr")
        style = props.find("pStyle") if props is not None else None
        num = props.find("numPr") if props is not None else None
        num_id, ilvl = (num.find("numId"), num.find("ilvl")) if num is not None else (None, None)
        words: list[dict[str, str | None]] = []
        for e in p:
            self.runs(e, None, words)
        return {
            "kind": "p", "style_id": style.get("val") if style is not None else None, "num_id": _number(num_id.get("val")) if num_id is not None else None,
            "ilvl": _number(ilvl.get("val")) if ilvl is not None else 0, "words": words, "cells": [], "is_first_row": False, "table_no": None,
        }

    def runs(self, e: Any, link: str | None, words: list[dict[str, str | None]]) -> None:
        if e.tag == "hyperlink":
            target = self.rels.get(e.get("id", ""), ("", "", ""))[1]
            for x in e:
                self.runs(x, target or None, words)
        elif e.tag == "r":
            self.run(e, link, words)
        elif e.tag not in ("pPr", "del"):
            for x in e:
                self.runs(x, link, words)

    def run(self, r: Any, link: str | None, words: list[dict[str, str | None]]) -> None:
        props = r.find("rPr")
        flag = lambda *names: props is not None and any(_on(props.find(n)) for n in names)
        bold, slant = flag("b", "bCs"), flag("i", "iCs")
        style = "BOLD_OBLIQUE" if bold and slant else "BOLD" if bold else "OBLIQUE" if slant else None
        for e in r:
            if e.tag == "t" and e.text:
                words.append({"s": f"[{e.text}]({link})", "type": "HREF", "format": None} if link else {"s": e.text, "type": None, "format": style})
            elif e.tag == "tab":
                words.append({"s": "\t", "type": None, "format": None})
            elif e.tag in ("br", "cr") and e.get("type") != "page":
                words.append({"s": " ", "type": None, "format": style})
            elif e.tag in ("footnoteReference", "endnoteReference"):
                note = e.get("id", "")
                if note not in ("0", "-1", ""):
                    self.refs.append((e.tag[: -len("Reference")], note))
                    words.append({"s": note, "type": "FOOTNOTE_LINK", "format": None})
            elif e.tag in ("drawing", "pict", "AlternateContent"):
                self.drawing(e, words)

    def drawing(self, e: Any, words: list[dict[str, str | None]]) -> None:
        blip = next(e.iter("blip"), None)
        kind, target, _ = self.rels.get(blip.get("embed", "") if blip is not None else "", ("", "", ""))
        if not kind.endswith("/image") or not target:
            return
        name = target if target.startswith("word/") else f"word/{target}"
        data = self.package.read(name) or self.package.read(target.lstrip("/"))
        if data is None:
            return
        about = next(e.iter("docPr"), None)
        alt = (about.get("descr") or about.get("name") or "") if about is not None else ""
        n = len(self.images) + 1
        self.images.append({"image_id": f"image_{n:03d}", "ord": n, "source_name": name, "alt": alt, "data": data})
        words.append({"s": f"image_{n:03d}", "type": "IMAGE", "format": None})

    def styles(self) -> list[dict[str, Any]]:
        root = self.package.optional("word/styles.xml")
        out: dict[str, dict[str, Any]] = {}
        for s in root.iter("style") if root is not None else ():
            name, outline = s.find("name"), s.find("pPr/outlineLvl")
            found = {"style_id": s.get("styleId", ""), "name": name.get("val") if name is not None else None, "outline_lvl": _number(outline.get("val")) if outline is not None else None}
            out.setdefault(found["style_id"], found)
        return list(out.values())

    def levels(self) -> list[dict[str, Any]]:
        try:
            data = self.package.read("word/numbering.xml")
        except (zipfile.BadZipFile, OSError):
            return []
        # documents of one template have the same part
        return [] if data is None else _levels(data) if len(data) < 1 << 16 else _levels.__wrapped__(data)

    def notes(self) -> list[dict[str, Any]]:
        out = []
        for kind in ("footnote", "endnote"):
            root = self.package.optional(f"word/{kind}s.xml")
            seen = set()
            for n in root.findall(kind) if root is not None else ():
                if not n.get("type") and n.get("id") not in seen:
                    seen.add(n.get("id"))
                    out.append({"note_kind": kind, "note_id": n.get("id", ""), "text": _paragraphs(n.findall("p"))})
        return out

    def sides(self) -> list[dict[str, Any]]:
        out = []
        for side in ("header", "footer"):
            for name in sorted(n for n in self.package.names if n.startswith(f"word/{side}") and n.endswith(".xml")):
                root = self.package.optional(name)
                if root is None:
                    continue
                parts = [_paragraphs([p]) for p in root.findall("p")]
                for row in root.findall("tbl/tr"):
                    parts.append(" | ".join(t for c in row.findall("tc") if (t := _paragraphs(c.findall("p")))))
                text = " ".join(p for p in parts if p)
                if text:
                    out.append({"side": side, "part": name[len("word/") : -len(".xml")], "text": text})
        return out


def _paragraphs(paras: list[Any]) -> str:
    """Texts of paragraphs joined by spaces: direct runs first, then those of links."""
    out = []
    for p in paras:
        text = "".join(t.text or "" for path in ("r/t", "hyperlink/r/t") for t in p.findall(path)).strip()
        if text:
            out.append(text)
    return " ".join(out)


def parse(data: bytes) -> dict[str, Any]:
    return _Reader(data).document()


def _failed(e: Exception) -> dict[str, Any]:
    return {c: [] for c in COLUMNS[2:]} | {"error": f"{e or type(e).__name__}"}


def decode(files: DataFrame) -> DataFrame:
    """Text documents of ``files`` (doc_id, content)."""
    return batches.decode(files, parse, _failed, SCHEMA)
