"""PDF files: one row per file with pages, positioned text, fonts and images as arrays."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from docloom.sources import batches
from docloom.sources.pdf.content import Interpreter
from docloom.sources.pdf.crypto import Locked
from docloom.sources.pdf.filters import decode as _filtered
from docloom.sources.pdf.objects import Document, Stream

SCHEMA = (
    "doc_id string, error string, status string, n_pages int, pages array<struct<page_idx:int,width:double,height:double,error:string>>, "
    "items array<struct<page_idx:int,seq:int,x:double,y:double,width:double,height:double,text:string,font:string>>, "
    "fonts array<struct<font_id:string,base_font:string,encoding:string>>, "
    "images array<struct<page_idx:int,ord:int,source_name:string,format:string,width:int,height:int,bits:int,space:string,data:binary>>"
)


def _box(doc: Document, page: dict[str, Any]) -> tuple[float, float]:
    box = doc.get(page.get("MediaBox"))
    values = [doc.get(v) for v in box] if isinstance(box, list) else []
    if len(values) == 4 and all(isinstance(v, int | float) for v in values):
        return abs(values[2] - values[0]), abs(values[3] - values[1])
    return 612.0, 792.0


def _content(doc: Document, page: dict[str, Any]) -> bytes:
    found = doc.get(page.get("Contents"))
    streams = found if isinstance(found, list) else [found]
    return b"\n".join(doc.decoded(s) for s in map(doc.get, streams) if isinstance(s, Stream))


def _space(doc: Document, v: Any) -> str:
    v = doc.get(v)
    if isinstance(v, list) and v:
        kind = str(doc.get(v[0]))
        if kind == "ICCBased" and len(v) > 1:
            n = doc.get(doc.dict(v[1]).get("N"))
            return {1: "DeviceGray", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
        return {"CalGray": "DeviceGray", "CalRGB": "DeviceRGB", "Separation": "DeviceGray"}.get(kind, kind)
    return str(v or "DeviceRGB")


def _images(doc: Document, page: dict[str, Any], number: int) -> list[dict[str, Any]]:
    objects = doc.dict(doc.dict(page.get("Resources")).get("XObject"))
    out = []
    for name in sorted(objects):
        s = doc.get(objects[name])
        if not isinstance(s, Stream) or doc.get(s.entries.get("Subtype")) != "Image":
            continue
        e = s.entries
        names, params = doc.filters_of(s)
        raw = doc.crypt.decrypt(s.raw, s.number, s.generation) if doc.crypt else s.raw
        fmt = "jpeg" if {"DCTDecode", "DCT"} & {*names} else "jp2" if "JPXDecode" in names else "png" if not names or names[-1] in ("FlateDecode", "Fl", "LZWDecode", "LZW") else "bin"
        whole = lambda k, d=0: int(v) if isinstance(v := doc.get(e.get(k)), int | float) else d
        out.append({"page_idx": number, "ord": len(out), "source_name": name, "format": fmt, "width": whole("Width"), "height": whole("Height"), "bits": whole("BitsPerComponent", 8), "space": _space(doc, e.get("ColorSpace")), "data": _filtered(raw, names, params)})
    return out


def parse(data: bytes, images: bool = True, text: bool = True) -> dict[str, Any]:
    """What a PDF holds; without ``text`` its pages are found but not read, images neither."""
    doc = Document(data)
    pages, items, pictures, fonts = [], [], [], {}
    for n, page in enumerate(doc.pages()):
        width, height = _box(doc, page)
        error = None
        if not text:
            pages.append({"page_idx": n, "width": float(width), "height": float(height), "error": None})
            continue
        try:
            reader = Interpreter(doc, height)
            reader.fonts = dict(fonts)
            reader.run(_content(doc, page), doc.dict(page.get("Resources")))
            fonts |= reader.fonts
            items += [{"page_idx": n, "seq": i} | item for i, item in enumerate(reader.items)]
            error = "; ".join(sorted(reader.problems)) or None
            if images:
                pictures += _images(doc, page, n)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, OverflowError) as e:
            error = f"{type(e).__name__}: {e}"
        pages.append({"page_idx": n, "width": float(width), "height": float(height), "error": error})
    return {"status": "ok", "error": "; ".join(sorted(doc.problems)) or None, "n_pages": len(pages), "pages": pages, "items": items, "fonts": [{"font_id": k, "base_font": f.base, "encoding": f.encoding} for k, f in fonts.items()], "images": pictures}


def _failed(e: Exception) -> dict[str, Any]:
    nothing = {"n_pages": 0, "pages": [], "items": [], "fonts": [], "images": []}
    if isinstance(e, Locked):
        return {"status": "encrypted", "error": str(e)} | nothing
    return {"status": "failed", "error": f"{e or type(e).__name__}"} | nothing


def decode(files: DataFrame, images: bool = True, text: bool = True) -> DataFrame:
    """PDFs of ``files`` (doc_id, content); without ``images`` none are read, without ``text`` the pages alone are found."""
    return batches.decode(files, lambda data: parse(data, images, text), _failed, SCHEMA)
