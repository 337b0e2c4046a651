"""Writers of small workbooks, text documents and PDFs, for tests and round-trip queries.

Output is deterministic: the same input gives the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Sequence
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from docloom.sources.pdf import crypto, filters

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def relations(found: Iterable[tuple[str, str, str]], mode: dict[str, str] | None = None) -> str:
    """Relationship part of (id, type, target) triples."""
    mode = mode or {}
    items = "".join(
        f'<Relationship Id={quoteattr(i)} Type={quoteattr(t if "/" in t else f"{_REL}/{t}")} Target={quoteattr(to)}'
        + (f" TargetMode={quoteattr(mode[i])}" if i in mode else "") + "/>"
        for i, t, to in found
    )
    return f'{_HEAD}<Relationships xmlns="{_PKG}">{items}</Relationships>'


# --- workbooks ---------------------------------------------------------------


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(sheets: Sequence[dict[str, Any]], formats: Sequence[tuple[int, str]] = ()) -> bytes:
    """A workbook.

    A sheet is a dict of ``name`` and ``cells``: (row, col, value) or
    (row, col, value, options) where options may hold ``style`` (index into
    ``formats``, from 1), ``formula`` and ``kind``; further ``merges``
    ('A1:B2'), ``tables`` ((name, 'A1:B3')), ``hidden_rows`` and ``hidden_cols``.
    """
    strings: dict[str, int] = {}
    parts: dict[str, str | bytes] = {}
    book, book_rels = "", []
    for n, sheet in enumerate(sheets, 1):
        rows: dict[int, list[str]] = {}
        for cell in sorted(sheet.get("cells", ()), key=lambda c: (c[0], c[1])):
            r, c, value, *more = cell
            o = more[0] if more else {}
            ref, kind = f"{letters(c)}{r}", o.get("kind")
            style = f' s="{o["style"]}"' if "style" in o else ""
            formula = f"<f>{escape(o['formula'])}</f>" if "formula" in o else ""
            if kind:
                body = f'<c r="{ref}" t="{kind}"{style}>{formula}<v>{escape(str(value))}</v></c>'
            elif value is None:
                body = f'<c r="{ref}"{style}>{formula}</c>'
            elif isinstance(value, str):
                index = strings.setdefault(value, len(strings))
                body = f'<c r="{ref}" t="s"{style}>{formula}<v>{index}</v></c>'
            else:
                body = f'<c r="{ref}"{style}>{formula}<v>{value!r}</v></c>'
            rows.setdefault(r, []).append(body)
        gone = set(sheet.get("hidden_rows", ()))
        data = "".join(f'<row r="{r}"{" hidden=\"1\"" if r in gone else ""}>{"".join(rows.get(r, ()))}</row>' for r in sorted({*rows, *gone}))
        cols = "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in sheet.get("hidden_cols", ()))
        merges = "".join(f'<mergeCell ref="{m}"/>' for m in sheet.get("merges", ()))
        tables = sheet.get("tables", ())
        links = "".join(f'<tablePart r:id="rId{i}"/>' for i in range(1, len(tables) + 1))
        parts[f"xl/worksheets/sheet{n}.xml"] = (
            f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_REL}">'
            + (f"<cols>{cols}</cols>" if cols else "") + f"<sheetData>{data}</sheetData>"
            + (f"<mergeCells>{merges}</mergeCells>" if merges else "") + (f"<tableParts>{links}</tableParts>" if links else "") + "</worksheet>"
        )
        found = []
        for i, (name, ref) in enumerate(tables, 1):
            path = f"xl/tables/table{n}_{i}.xml"
            parts[path] = f'{_HEAD}<table id="{i}" name={quoteattr(name)} displayName={quoteattr(name)} ref="{ref}" headerRowCount="1"/>'
            found.append((f"rId{i}", "table", f"../tables/table{n}_{i}.xml"))
        if found:
            parts[f"xl/worksheets/_rels/sheet{n}.xml.rels"] = relations(found)
        book += f'<sheet name={quoteattr(sheet["name"])} sheetId="{n}" r:id="rId{n}"/>'
        book_rels.append((f"rId{n}", "worksheet", f"worksheets/sheet{n}.xml"))
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook xmlns:r="{_REL}"><sheets>{book}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = relations(book_rels)
    parts["xl/sharedStrings.xml"] = f"{_HEAD}<sst>{''.join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)}</sst>"
    custom = "".join(f"<numFmt numFmtId={quoteattr(str(i))} formatCode={quoteattr(c)}/>" for i, c in formats if c)
    xfs = "".join(f'<xf numFmtId="{i}"/>' for i in [0, *(i for i, _ in formats)])
    parts["xl/styles.xml"] = f"{_HEAD}<styleSheet><numFmts>{custom}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>"
    return package(parts)


# --- text documents ----------------------------------------------------------


def run(text: str, bold: bool = False, italic: bool = False) -> str:
    props = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "")
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


def note_ref(number: int, kind: str = "footnote") -> str:
    return f'<w:r><w:{kind}Reference w:id="{number}"/></w:r>'


def link(rel: str, text: str) -> str:
    return f'<w:hyperlink r:id="{rel}">{run(text)}</w:hyperlink>'


def drawing(rel: str, alt: str = "") -> str:
    return f'<w:r><w:drawing><wp:inline><wp:docPr id="1" name="image" descr={quoteattr(alt)}/><a:blip r:embed="{rel}"/></wp:inline></w:drawing></w:r>'


def para(*runs: str, style: str = "", num: tuple[int, int] | None = None) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}{"".join(runs)}</w:p>'


def grid(rows: Sequence[Sequence[str]]) -> str:
    body = "".join("<w:tr>" + "".join(f"<w:tc>{para(run(c))}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    return f"<w:tbl>{body}</w:tbl>"


def docx(
    body: str, styles: Sequence[tuple[str, str, int | None]] = (), numbering: Sequence[tuple[int, Sequence[str]]] = (), footnotes: dict[int, str] | None = None,
    endnotes: dict[int, str] | None = None, links: dict[str, str] | None = None, images: dict[str, bytes] | None = None, headers: Sequence[str] = (), footers: Sequence[str] = (),
) -> bytes:
    """A document of ``body`` XML with its side parts.

    ``styles``: (id, name, outline level); ``numbering``: (numId, number format of each level).
    """
    space = f'xmlns:w="{_W}" xmlns:r="{_REL}" xmlns:wp="urn:wp" xmlns:a="urn:a"'
    parts: dict[str, str | bytes] = {"word/document.xml": f"{_HEAD}<w:document {space}><w:body>{body}</w:body></w:document>"}
    if styles:
        items = "".join(
            f'<w:style w:styleId={quoteattr(i)}><w:name w:val={quoteattr(n)}/>' + (f'<w:pPr><w:outlineLvl w:val="{o}"/></w:pPr>' if o is not None else "") + "</w:style>"
            for i, n, o in styles
        )
        parts["word/styles.xml"] = f"{_HEAD}<w:styles {space}>{items}</w:styles>"
    if numbering:
        abstract = "".join(
            f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{f}"/></w:lvl>' for k, f in enumerate(levels)) + "</w:abstractNum>"
            for i, levels in numbering
        )
        nums = "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i, _ in numbering)
        parts["word/numbering.xml"] = f"{_HEAD}<w:numbering {space}>{abstract}{nums}</w:numbering>"
    for kind, notes in (("footnote", footnotes), ("endnote", endnotes)):
        if notes:
            items = "".join(f'<w:{kind} w:id="{i}">{para(run(t))}</w:{kind}>' for i, t in notes.items())
            parts[f"word/{kind}s.xml"] = f"{_HEAD}<w:{kind}s {space}>{items}</w:{kind}s>"
    found = [(i, "hyperlink", to) for i, to in (links or {}).items()]
    for i, data in (images or {}).items():
        parts[f"word/media/{i}.bin"] = data
        found.append((i, "image", f"media/{i}.bin"))
    for kind, texts in (("header", headers), ("footer", footers)):
        for i, text in enumerate(texts, 1):
            parts[f"word/{kind}{i}.xml"] = f"{_HEAD}<w:hdr {space}>{para(run(text))}</w:hdr>"
    parts["word/_rels/document.xml.rels"] = relations(found, {i: "External" for i in links or {}})
    return package(parts)


# --- PDF ---------------------------------------------------------------------


def _literal(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def _coded(data: bytes, coding: str) -> tuple[bytes, bytes]:
    """``data`` under a filter, and what the stream's dictionary says of it."""
    if coding == "flate":
        return zlib.compress(data), b" /Filter /FlateDecode"
    if coding == "lzw":
        return filters.lzw_encode(data), b" /Filter /LZWDecode"
    if coding == "ascii85":
        return base64.a85encode(zlib.compress(data)) + b"~>", b" /Filter [/ASCII85Decode /FlateDecode]"
    if coding == "hex":
        return data.hex().encode() + b">", b" /Filter /ASCIIHexDecode"
    if coding == "predictor":
        data += b" " * (-len(data) % 16)
        rows = [bytes(16), *(data[i : i + 16] for i in range(0, len(data), 16))]
        up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(b, a)) for a, b in zip(rows, rows[1:]))
        return zlib.compress(up), b" /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>"
    return data, b""


def _to_unicode(codes: dict[str, int]) -> bytes:
    said = b"\n".join(b"<%04x> <%s>" % (n, c.encode("utf-16-be").hex().encode()) for c, n in codes.items())
    return b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange <0000> <ffff> endcodespacerange\n%d beginbfchar\n%s\nendbfchar\nendcmap end" % (len(codes), said)


def pdf(
    pages: Sequence[Sequence[tuple[float, float, str, float, str]]], images: dict[int, tuple[int, int, bytes]] | None = None, compress: bool = True, coding: str = "",
    unicode: bool = False, arrays: bool = False, bundled: bool = False, locked: bool = False,
) -> bytes:
    """A PDF of pages of (x, y, text, size, font): y from the top, font F1 (regular) or F2 (bold).

    ``images`` maps a page's index to the (width, height, RGB bytes) of one image on it.
    ``coding`` names the filter of all streams; ``unicode`` writes two-byte codes
    with a map to Unicode, ``arrays`` texts in kerned halves, ``bundled`` an
    object stream and a cross-reference stream, ``locked`` RC4 under the empty password.
    """
    images = images or {}
    coding = coding or ("flate" if compress else "")
    objects: list[bytes | tuple[bytes, bytes]] = []
    codes: dict[str, int] = {}

    def add(body: bytes | tuple[bytes, bytes]) -> int:
        objects.append(body)
        return len(objects)

    def stream(entries: bytes, data: bytes) -> tuple[bytes, bytes]:
        data, said = _coded(data, coding)
        return entries + said, data

    def shown(text: str) -> bytes:
        if not unicode:
            return _literal(text)
        for c in dict.fromkeys(text):
            codes.setdefault(c, len(codes) + 1)
        if len(codes) > 0xFFFF:
            return b"<" + b"".join(b"%04x" % codes[c] for c in text) + b">"
        return b"<%s>" % struct.pack(f">{len(text)}H", *map(codes.__getitem__, text)).hex().encode()

    def told(text: str) -> bytes:
        half = len(text) // 2
        return b"[%s -20 %s] TJ" % (shown(text[:half]), shown(text[half:])) if arrays else shown(text) + b" Tj"

    catalog, tree = add(b""), add(b"")
    names = (b"Helvetica", b"Helvetica-Bold")
    fonts = [add(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 126 /Widths [%s] >>" % (name, b" ".join([b"500"] * 95))) for name in names]
    kids = []
    for n, items in enumerate(pages):
        ops = [b"BT"]
        for x, y, text, size, font in items:
            ops.append(b"/%s %g Tf 1 0 0 1 %g %g Tm %s" % (font.encode(), size, x, 792 - y, told(text)))
        ops.append(b"ET")
        resources = b"/Font << /F1 %d 0 R /F2 %d 0 R >>" % tuple(fonts)
        if n in images:
            w, h, data = images[n]
            image = add(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8" % (w, h), data))
            resources += b" /XObject << /Im1 %d 0 R >>" % image
            ops.append(b"q %d 0 0 %d 0 0 cm /Im1 Do Q" % (w, h))
        content = add(stream(b"", b"\n".join(ops)))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << %s >> /Contents %d 0 R >>" % (tree, resources, content)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    if unicode:
        below = add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>")
        table = add(stream(b"", _to_unicode(codes)))
        for at, name in zip(fonts, names):
            objects[at - 1] = b"<< /Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (name, below, table)
    trailer, seal = b"", None
    if locked:
        owner = bytes(32)
        key = hashlib.md5(crypto.PAD + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + b"\0").digest()[:5]
        hexed = lambda b: b"<" + b.hex().encode() + b">"
        trailer = b" /ID [<00> <00>] /Encrypt << /Filter /Standard /V 1 /R 2 /Length 40 /P -4 /O %s /U %s >>" % (hexed(owner), hexed(crypto.rc4(key, crypto.PAD)))
        seal = lambda data, n: crypto.rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], data)
    out = bytearray(b"%PDF-1.5\n")
    at: dict[int, int] = {}
    plain = {n: body for n, body in enumerate(objects, 1) if isinstance(body, bytes)}

    def put(n: int, body: bytes | tuple[bytes, bytes]) -> None:
        nonlocal out
        if not isinstance(body, bytes):
            entries, data = body
            data = seal(data, n) if seal else data
            body = b"<< %s /Length %d >>\nstream\n%s\nendstream" % (entries, len(data), data)
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)

    for n, body in enumerate(objects, 1):
        if not (bundled and n in plain):
            put(n, body)
    size = len(objects) + 1
    if bundled:
        starts, packed = [], b""
        for n, body in plain.items():
            starts.append(b"%d %d" % (n, len(packed)))
            packed += body + b" "
        head = b" ".join(starts) + b" "
        put(size, stream(b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)), head + packed))
        index = {n: i for i, n in enumerate(plain)}
        rows = [(0, 0, 65535), *((2, size, index[n]) if n in plain else (1, at[n], 0) for n in range(1, size)), (1, at[size], 0), (1, len(out), 0)]
        entries = b"".join(struct.pack(">BIH", *r) for r in rows)
        table = len(out)
        put(size + 1, stream(b"/Type /XRef /Size %d /W [1 4 2] /Root %d 0 R%s" % (size + 2, catalog, trailer), entries))
        out += b"startxref\n%d\n%%%%EOF\n" % table
        return bytes(out)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n] for n in range(1, size))
    out += b"trailer\n<< /Size %d /Root %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, catalog, trailer, table)
    return bytes(out)
