"""Sources, operators and plans on small documents made by the writers."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom import api, synth
from docloom.functions import cells as C
from docloom.functions import tables
from docloom.functions import text as T
from docloom.operators import images, layout, paragraphs, render, sheets
from docloom.operators.layout import Item
from docloom.options import Options, PdfOptions, SheetOptions, WordOptions
from docloom.plans import docx as docx_plan
from docloom.plans import pdf as pdf_plan
from docloom.sources import docx, files, pdf, xlsx
from docloom.sources.pdf import crypto, filters, fonts
from docloom.sources.pdf.objects import Document, Lexer, Ref
from docloom.storage import released, stored
from docloom.streaming import convert_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def rows(spark, **found):
    return spark.createDataFrame([(k, v) for k, v in found.items()], "doc_id string, content binary")


# --- workbooks ---------------------------------------------------------------

BOOK = dict(
    name="Sheet1",
    cells=[
        (1, 1, "Item"), (1, 2, "Value"), (1, 3, "Amount"), (2, 1, "Label"), (2, 2, 2, {"formula": "SUM(A2:A3)"}), (2, 3, 0.25, {"style": 1}),
        (3, 2, "#DIV/0!", {"kind": "e"}), (3, 3, 12.5, {"style": 2}), (4, 3, 0.25, {"style": 1}),
    ],
    merges=["A2:A3"], hidden_rows=[3], hidden_cols=[2],
)
FORMATS = [(165, "0.00%"), (166, "$#,##0.00")]


def test_workbook_markdown(spark):
    whole = synth.xlsx([BOOK | {"tables": [("T1", "A1:C4")]}], FORMATS)
    plain = synth.xlsx([{"name": "Sheet1", "cells": [(1, 1, "Name"), (1, 2, "Age"), (2, 1, "A|b\nc"), (2, 2, 42)]}, {"name": "Empty", "cells": []}])
    books = stored(xlsx.decode(rows(spark, a=whole, b=plain, c=b"junk", d=bytes.fromhex("D0CF11E0A1B11AE1") + b"12345678")), "books")
    errors = {r.doc_id: r.error for r in books.collect()}
    assert errors["a"] is None and "ZIP" in errors["c"] and "encrypted XLSX" in errors["d"]
    got = {r.doc_id: r.markdown for r in sheets.markdown(books).collect()}
    assert set(got) == {"a", "b"}
    assert "### Table: Sheet1!A1:C4 (T1)\n| Row | A | B [hidden] | C |\n| --- | --- | --- | --- |\n" in got["a"]
    assert "| 2 | Label | 2 (=SUM(A2:A3)) | 25.00% |\n| 3 [hidden] | [merged] | #DIV/0! | $12.50 |\n| 4 |  |  | 25.00% |\n" in got["a"]
    assert got["b"] == "## Sheet1\n\n### Range: Sheet1!A1:B2\n| Row | A | B |\n| --- | --- | --- |\n| 1 | Name | Age |\n| 2 | A\\|b<br>c | 42 |\n\n\n## Empty\n\n"
    bare = {r.doc_id: r.markdown for r in sheets.markdown(books, SheetOptions(hidden=False, formulas=False, sheet_names=False, compact=True)).collect()}
    assert "hidden" not in bare["a"] and "SUM" not in bare["a"] and "#DIV" not in bare["a"] and bare["b"].startswith("### Range") and bare["b"].endswith("|\n")


def test_blocks_of_a_sheet(spark):
    book = synth.xlsx([{"name": "S", "cells": [(1, 1, "a"), (2, 2, "b"), (5, 3, "c"), (9, 1, "t"), (9, 7, "beside")], "tables": [("T", "A9:B10")], "merges": ["C5:E5"]}])
    books = xlsx.decode(rows(spark, a=book))
    got = {(r.kind, r.r0, r.c0, r.r1, r.c1) for r in sheets.blocks(sheets.grid(books)).collect()}
    assert got == {("range", 1, 1, 2, 2), ("range", 5, 3, 5, 5), ("table", 9, 1, 10, 2)}


def test_a_claim_of_a_whole_sheet_costs_its_own_rows(spark):
    book = synth.xlsx([{"name": "S", "cells": [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")], "merges": ["A1:XFD1048576"], "hidden_cols": [2]}])
    books = xlsx.decode(rows(spark, a=book))
    assert sheets.grid(books).where("row > 0").count() == 3
    text = sheets.markdown(books, SheetOptions(hidden=False)).first().markdown
    assert text.startswith("## S\n\n### Range: S!A1:XFD1\n") and "\n### Range: S!A3:XFD3\n" in text


@pytest.mark.parametrize(("raw", "fmt", "code", "shown"), [
    ("0.25", 10, "", "25%"), ("0.255", 165, "0.0%", "25.5%"), ("12.5", 7, "", "$12"), ("1234.5", 170, "€#,##0.00", "€1234.50"), ("45000", 14, "", "2023-03-15"),
    ("45000.5", 22, "", "2023-03-15 12:00:00"), ("45000", 171, "hh:mm", "2023-03-15 00:00:00"), ("1E21", 0, "", "1000000000000000000000"), ("0.1", 49, "", "0.1"),
    ("12345678.25", 0, "General", "12345678.25"), ("abc", 14, "", "abc"), (" 7 ", 0, "", "7"), ("-0.5", 1, "", "-0.5"), ("1e-7", 0, "", "0.0000001"),
])
def test_number_formats(raw, fmt, code, shown):
    code = "" if code == "General" else code
    assert C.format_value(raw, fmt, code) == shown


def test_references(spark):
    got = spark.range(1, 800).select("id", C.column_letters(F.col("id")).alias("s"), C.column_number(C.column_letters(F.col("id"))).alias("n")).collect()
    assert all(r.s == synth.letters(r.id) and r.n == r.id for r in got)
    assert xlsx.cell_ref("AB12") == (12, 28) and xlsx.range_ref("A1:C4") == (1, 1, 4, 3) and xlsx.range_ref("B2") == (2, 2, 2, 2) and xlsx.cell_ref("") == (0, 0)


# --- text --------------------------------------------------------------------


@pytest.mark.parametrize(("line", "ordered"), [
    ("1. a", True), ("12) a", True), ("a. x", True), ("B) x", True), ("iv. x", True), ("XIX) x", True), (". a", True), ("1.a", False), ("ab. x", False),
    ("1 a", False), ("", False), ("1.", False), ("xxxx. a", False), ("- a", False), ("10.5 a", False),
])
def test_ordered_items(spark, line, ordered):
    assert one(spark, T.is_ordered_item(F.lit(line))) is ordered


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.list_prefix(lit("decimal"), lit(12))) == "12. " and one(spark, T.list_prefix(lit("decimal"), lit(10), True)) == "0. "
    assert [one(spark, T.list_prefix(lit(f), lit(28))) for f in ("lowerLetter", "upperLetter", "lowerRoman", "upperRoman", "bullet", "none")] == ["b. ", "B. ", "xxviii. ", "XXVIII. ", "- ", ""]
    assert one(spark, T.roman(lit(1994))) == "mcmxciv" and one(spark, T.roman(lit(0))) == ""
    assert one(spark, T.compact(lit("\r\n a\n\n\n\nb \n"))) == "a\n\nb\n"
    assert one(spark, T.line_hash(lit("A1 B C"))) == one(spark, T.line_hash(lit("ABC"))) != one(spark, T.line_hash(lit("ABCÂ")))
    assert one(spark, T.line_hash(lit("ABC"))) == 64578 and one(spark, T.line_hash(lit("1 2"))) == 0
    assert [w.s for w in one(spark, layout.words(lit("word(3) printf(3) a(123)")))] == ["word[^3]", "printf(3)", "a(123)"]
    assert one(spark, layout.repetitive(lit("spam and eggs " * 10))) and not one(spark, layout.repetitive(lit("short short short")))
    assert [one(spark, T.list_level(lit(x), lit(10.0))) for x in (5.0, 29.9, 30.0, 500.0)] == [0, 0, 1, 6]
    assert one(spark, T.is_table(lit("| a |\n| b |"))) and not one(spark, T.is_table(lit("| a |\nb")))
    assert one(spark, T.header_key(lit("| A | b  ||"))) == "a|b"
    assert one(spark, render.joined_tables(lit("| a |\n| --- |\n| 1 |\n\n\n| 2 |\nx\n\n| b |\n"))) == "| a |\n| --- |\n| 1 |\n| 2 |\nx\n\n| b |\n"


# --- text documents ----------------------------------------------------------


def test_word_document(spark):
    body = (
        synth.para(synth.run("My Heading"), style="H1") + synth.para(synth.run("Bold", bold=True), synth.run(" more", bold=True), synth.run("it", italic=True))
        + "".join(synth.para(synth.run(f"item {i}"), num=(1, 0)) for i in range(12)) + synth.para(synth.run("sub"), num=(1, 1))
        + synth.grid([["A", "B"], ["1", "2"]]) + synth.grid([["C"], ["3"]])
        + synth.para(synth.run("See"), synth.note_ref(2), synth.note_ref(0), synth.link("rId9", "site"), synth.drawing("rId8", "pic")) + synth.para(synth.run("  "))
    )
    data = synth.docx(body, [("H1", "Heading 1", 0)], [(1, ["decimal", "lowerRoman"])], {2: "a note"}, links={"rId9": "http://x.y"}, images={"rId8": b"\x89PNG\r\n\x1a\n123"}, headers=["Head"], footers=["Foot"])
    docs = stored(docx.decode(rows(spark, a=data, b=b"junk", c=synth.package({"x": "y"}))), "docs")
    assert {r.doc_id: r.error is None for r in docs.collect()} == {"a": True, "b": False, "c": False}
    text = docx_plan.markdown(docs).first().markdown
    assert text.startswith("# My Heading\n\n**Bold more** _it_\n\n1. item 0\n") and "12. item 11\n  i. sub\n" in text
    assert "| A | B |\n| --- | --- |\n| 1 | 2 |\n\n| C |\n| --- |\n| 3 |\n\nSee[^2] [site](http://x.y) ![image_001]" in text
    assert text.endswith("## Footnotes\n\n[^2]: a note\n\n")
    sides = docx_plan.markdown(docs, WordOptions(headers_footers=True)).first().markdown
    assert sides.startswith("## Document Headers\n\n**header1**: Head\n\n---\n\n# My") and "## Document Footers\n\n**footer1**: Foot" in sides
    old = docx_plan.markdown(docs, WordOptions(compat=True)).first().markdown
    assert "0. item 9\n" in old and "| 2 |\n| C |\n| 3 |" in old
    plain = docx_plan.markdown(docs, WordOptions(preserve_formatting=False)).first().markdown
    assert "**" not in plain
    image = paragraphs.images(docs).first()
    assert (image.image_id, image.alt, image.source_name) == ("image_001", "pic", "word/media/rId8.bin")


def test_heading_levels_by_style(spark):
    cases = [("x", "Heading 3", None, 3), ("x", "Title", None, 1), ("x", "subtitle", 4, 2), ("Heading5", "other", None, 5), ("x", "other", 1, 2), ("x", "other", 8, None), ("x", None, None, None), ("x", "heading 9", 0, 1)]
    for style, name, outline, level in cases:
        assert one(spark, paragraphs.heading_level(F.lit(style), F.lit(name).cast("string"), F.lit(outline).cast("int"))) == level


# --- layout ------------------------------------------------------------------


@pytest.mark.parametrize(("a", "b", "gap", "space"), [
    ("word", "next", -1, False), ("end.", "Next", 0, True), ("end!", "x", 0, True), ("it’", "A", 1, True), ("Bob's", "Car", 1, True), ("pre-", "fix", 50, False), ("a", "–", 50, False),
    ("a", ",", 50, False), ("(", "a", 50, False), ("a", ")", 50, False), ("go to", "bed", 0, True), ("ab", "cd", 25, False), ("ab", "cd", 26, True),
    ("a", "(", 30, False), ("a", "(", 31, True), ("é", "a", 10, False), ("é", "a", 11, True),
])
def test_spaces(a, b, gap, space):
    assert layout.needs_space(a, b, gap) is space


def item(x, y, text, seq=0, w=10.0, h=12.0):
    return Item(float(x), float(y), float(w), float(h), text, "F1", seq)


def test_combine_and_columns():
    assert layout.combine([item(0, 0, "hello", w=30), item(100, 0, "world")]) == "hello world"
    assert layout.combine([item(0, 0, "some"), item(0, 20, "words")]) == "some words" and layout.combine([item(0, 0, "exam"), item(0, 20, "ple")]) == "example"
    assert layout.combine([item(0, 0, "•"), item(10, 0, "point")]) == "• point"
    assert [layout.column_of(x, [50, 150, 300]) for x in (0, 35, 134, 135, 290, 999)] == [0, 0, 0, 1, 2, 2] and layout.column_of(5, []) == 0
    assert layout.columns_match([50, 150], [80, 120]) and not layout.columns_match([50, 150], [91, 150]) and not layout.columns_match([1], [1, 2])
    assert layout.mean_columns([[50, 150], [52, 154]]) == [51, 152] and layout.mean_columns([]) == []


def test_regions_and_rows():
    refs = [item(50, 100 + 20 * i, f"[{i}]", i) for i in range(4)] + [item(100, 100 + 20 * i, f"entry {i}", 9 + i) for i in range(4)]
    region = layout.reference_region(refs, 12)
    assert region and region.columns == [50, 100] and not region.header
    assert layout.reference_region(refs[:2], 12) is None
    table = [item(x, 100 + 40 * r, f"{r}{c}", 10 * r + c) for r in range(4) for c, x in enumerate((50, 200, 350))]
    found = layout.aligned_regions(table, 12, 700)
    assert len(found) == 1 and found[0].columns == [50, 200, 350] and found[0].header
    groups = layout.page_groups(table, 12, 700)
    assert [g.header for g in groups] == [True, False, False, False] and layout.line_row(groups[0], {})["table_columns"] == ["00", "01", "02"]
    assert layout.aligned_regions(table, 12, 150) == []
    left = [item(50, 100 + 10 * i, "Left line", i) for i in range(8)]
    right = [item(350, 105 + 10 * i, "right side", 50 + i) for i in range(8)]
    assert [len(s) for s in layout.two_columns(left + right)] == [8, 8] and layout.two_columns(left) is None
    assert layout.page_groups([], 12, 700) == [] and layout.page_groups([item(-5, 1, "off")], 12, 700) == []


def test_lines_render():
    word = lambda s, kind=None, fmt=None: {"s": s, "type": kind, "format": fmt}
    line = lambda words, **o: {"words": words, "type": None, "list_level": 0, "is_table_row": False, "is_table_header": False, "table_columns": None} | o
    assert render.lines_text([line([word("a", fmt="BOLD"), word("b", fmt="BOLD")]), line([word("c", fmt="BOLD"), word("d")])]) == "**a b\nc** d\n"
    assert render.lines_text([line([word("see"), word("1", "FOOTNOTE_LINK"), word("."), word("http://x", "LINK")])]) == "see[^1]. [http://x](http://x)\n"
    assert render.lines_text([line([word("x")], type="LIST", list_level=2)]) == "    x\n"
    table = [line([], is_table_row=True, is_table_header=i == 0, table_columns=c) for i, c in enumerate((["A", " b "], ["", " "], ["1", "2"]))]
    assert render.lines_text(table) == "| A | b |\n| --- | --- |\n| 1 | 2 |\n"
    assert render.block_text([line([word("T", fmt="BOLD")])], "H2") == "## T\n"


# --- PDF ---------------------------------------------------------------------


def _page(*lines, size=12):
    return [(72, y, t, size, "F1") for y, t in lines]


def test_pdf_markdown(spark):
    pages = [
        [*_page((40, "Running Head")), (72, 100, "The Title", 30, "F2"), *_page((160, "Some text that is long"), (172, "enough for two lines."), (200, "• first"), (220, "2. second"), (700, "Page 1"))],
        *[_page((40, "Running Head"), (160, f"body of page {w}"), (190, "and more"), (700, f"Page {n}")) for n, w in ((2, "two"), (3, "three"), (4, "four"))],
        _page((40, "Running Head")),
    ]
    book = synth.pdf(pages, {1: (10, 10, b"abc" * 100)})
    scan = synth.pdf([[], []], {0: (600, 700, b"\1\2\3" * 420_000), 1: (600, 10, b"")})
    docs = stored(pdf.decode(rows(spark, a=book, b=scan, c=b"nope", d=synth.pdf([[]]))), "prints")
    got = {r.doc_id: r.markdown for r in pdf_plan.markdown(docs).collect()}
    assert set(got) == {"a", "b", "d"}
    assert "# The Title" in got["a"] and "Running" not in got["a"] and "Page 2" not in got["a"] and "body of page two" in got["a"]
    assert "- first" in got["a"] and "2. second" in got["a"] and got["a"].endswith("## Images\n\n![image_001]\n\n")
    assert got["b"] == "![page_001]\n\n\n![page_002]\n\n" and "Conversion Failed" in got["d"]
    kept = {r.doc_id: r.markdown for r in pdf_plan.markdown(docs, PdfOptions(strip_headers_footers=False, strip_page_numbers=True, detect_headings=False, images=False, preserve_formatting=False)).collect()}
    assert "Running Head" in kept["a"] and "Page 2" not in kept["a"] and "# The" not in kept["a"] and "## Images" not in kept["a"]


def test_lexer():
    lexer = Lexer(b"% note\n<< /A#20b [1 -2.5 (a\\(b\\)\\101\\\n(c)) <4a4> true null 3 0 R] /N /X >> BT")
    d = lexer.value()
    assert list(d) == ["A b", "N"] and d["A b"][:5] == [1, -2.5, b"a(b)A(c)", b"J@", True] and lexer.value() == "BT"
    assert Lexer(b"[[[[").value() == [[[[]]]] and Lexer(b"(open").value() == b"open" and Lexer(b">> ]").value() == ">>"


def test_objects_from_streams_and_broken_tables():
    book = synth.pdf([_page((100, "hello there"))])
    for damaged in (book, book.replace(b"startxref", b"startxxxx"), book[: book.rindex(b"xref\n0")] + b"trailer << /Root 1 0 R >>"):
        assert [i["text"] for i in pdf.parse(damaged)["items"]] == ["hello there"]
    body = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [] /Count 0 >>"
    head = b"1 0 2 34 "
    packed = zlib.compress(head + body)
    out = bytearray(b"%PDF-1.5\n")
    at = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    table = len(out)
    entries = b"".join(struct.pack(">BHB", *e) for e in ((0, 0, 0), (2, 3, 0), (2, 3, 1), (1, at, 0), (1, table, 0)))
    up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(entries[i : i + 4], entries[i - 4 : i] if i else bytes(4))) for i in range(0, 20, 4))
    coded = zlib.compress(up)
    out += b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(coded), coded, table)
    doc = Document(bytes(out))
    assert doc.get(Ref(2))["Count"] == 0 and list(doc.pages()) == []


def _locked(book: bytes, entries: bytes, seal) -> bytes:
    """``book`` with its content stream sealed and an encryption dictionary."""
    doc = Document(book)
    at = next(n for n in doc.offsets if hasattr(doc.get(Ref(n)), "raw"))
    raw = doc.get(Ref(at)).raw
    sealed = seal(raw, at)
    book = book.replace(b"/Length %d >>\nstream\n%s" % (len(raw), raw), b"/Length %d >>\nstream\n%s" % (len(sealed), sealed))
    return book.replace(b"trailer\n<<", b"trailer\n<< /ID [<00> <00>] /Encrypt << /Filter /Standard %s >>" % entries).replace(b"startxref", b"startxxxx")


def test_encryption():
    book = synth.pdf([_page((100, "secret text"))], compress=False)
    owner, perm = bytes(32), (-4) & 0xFFFFFFFF
    hexed = lambda b: b"<" + b.hex().encode() + b">"
    # RC4, revision 2
    key = hashlib.md5(crypto.PAD + owner + perm.to_bytes(4, "little") + b"\0").digest()[:5]
    own = lambda n, more=b"": hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0" + more).digest()
    d = b"/V 1 /R 2 /Length 40 /P -4 /O %s /U %s" % (hexed(owner), hexed(crypto.rc4(key, crypto.PAD)))
    assert pdf.parse(_locked(book, d, lambda raw, n: crypto.rc4(own(n)[:10], raw)))["items"][0]["text"] == "secret text"
    with pytest.raises(crypto.Locked):
        pdf.parse(_locked(book, d.replace(b"/P -4", b"/P -8"), lambda raw, n: raw))
    # AES-256, revision 6
    file_key, salts = bytes(range(32)), b"saltsalt" + b"keysaltk"
    user = crypto.hash_r6(b"", salts[:8]) + salts
    wrapped = crypto.aes_cbc_encrypt(crypto.hash_r6(b"", salts[8:]), bytes(16), file_key)
    d = b"/V 5 /R 6 /Length 256 /P -4 /O %s /U %s /UE %s /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF" % (hexed(bytes(48)), hexed(user), hexed(wrapped))
    pad = lambda raw: raw + bytes([16 - len(raw) % 16]) * (16 - len(raw) % 16)
    seal = lambda raw, n: bytes(16) + crypto.aes_cbc_encrypt(file_key, bytes(16), pad(raw))
    assert pdf.parse(_locked(book, d, seal))["items"][0]["text"] == "secret text"


def test_known_ciphers():
    assert crypto.aes_cbc_encrypt(bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(16), bytes.fromhex("6bc1bee22e409f96e93d7e117393172a")).hex() == "3ad77bb40d7a3660a89ecaf32466ef97"
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4), st.integers(1, 40))
def test_filters_round_trip(data, colors, columns):
    import base64

    assert filters.lzw(filters.lzw_encode(data)) == data and filters.lzw(filters.lzw_encode(data, 0), 0) == data
    assert filters.decode(base64.a85encode(zlib.compress(data)) + b"~>", ["ASCII85Decode", "FlateDecode"], []) == data
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    size = colors * columns
    whole = data[: len(data) // size * size]
    for kind in range(5):
        coded, above = bytearray(), bytes(size)
        for i in range(0, len(whole), size):
            row = whole[i : i + size]
            left = lambda k, r=row: r[k - colors] if k >= colors else 0
            corner = lambda k, a=above: a[k - colors] if k >= colors else 0
            guess = [lambda k: 0, left, lambda k, a=above: a[k], lambda k, a=above: (left(k) + a[k]) // 2, lambda k, a=above: filters._paeth(left(k), a[k], corner(k))][kind]
            coded += bytes([kind, *((row[k] - guess(k)) & 255 for k in range(size))])
            above = row
        assert filters.unpredict(bytes(coded), 15, colors, 8, columns) == whole


def test_fonts_and_cmaps():
    cmap = fonts.CMap.parse(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<00660069> <D83DDE00>] endbfrange")
    assert cmap.decode(bytes.fromhex("000100020004000500060099")) == "Aacfi\U0001f600"
    font = fonts.Font("F", "Helvetica", "WinAnsiEncoding", widths={65: 700.0}, names={1: "ä"})
    assert font.text(b"A\x80\x01\x81") == "A€ä" and font.width(b"AB") == 1200
    assert fonts.Font("F", encoding="MacRomanEncoding").text(b"\x8a") == "ä" and font.text(b"\xfe\xff\x00A") == "A"


def test_content_operators():
    body = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 TL 1 0 0 1 30 40 Tm (one) Tj T* [(tw) -400 (o)] TJ 0.5 g /P scn ET Q BI /W 1 ID \x00(x) Tj EI BT /F1 8 Tf 5 700 Td (last) ' ET"
    book = synth.pdf([[]], compress=False).replace(b"BT\nET", body)
    found = pdf.parse(book.replace(b"startxref", b"startxxxx"))["items"]
    assert [i["text"] for i in found] == ["one", "tw o", "last"]
    assert (found[0]["x"], found[0]["y"], found[0]["height"]) == (70, 792 - 100, 20) and found[1]["y"] == 792 - 90 and found[2]["height"] == 8


def test_what_is_left_out_is_said():
    def book(forms, levels):
        body = [b"<< /Type /Catalog /Pages 2 0 R >>"] + [b"<< /Type /Pages /Kids [%d 0 R] /Count 1 >>" % (i + 3) for i in range(levels)]
        page = len(body) + 1
        body.append(b"<< /Type /Page /MediaBox [0 0 612 792] /Resources << /XObject << /X %d 0 R >> >> /Contents %d 0 R >>" % (page + 2, page + 1))
        stream = lambda d, x: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (d, len(x), x)
        body.append(stream(b"", b"BT (top) Tj ET /X Do"))
        body += [stream(b"/Subtype /Form /Resources << /XObject << /X %d 0 R >> >>" % (page + 3 + i), b"BT (form) Tj ET /X Do") for i in range(forms)]
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, x) for n, x in enumerate(body, 1)) + b"trailer << /Root 1 0 R >>"

    found = pdf.parse(book(5, 1))
    assert [i["text"] for i in found["items"]] == ["top"] + ["form"] * 5 and found["pages"][0]["error"] is None and found["error"] is None
    found = pdf.parse(book(30, 1))
    assert len(found["items"]) == 21 and "forms nested" in found["pages"][0]["error"]
    found = pdf.parse(book(0, 120))
    assert found["pages"] == [] and "pages nested" in found["error"]


def test_images(spark):
    data = images.to_png(bytes(range(12)), 2, 2)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(data[data.index(b"IDAT") + 4 : -16]) == b"\0" + bytes(range(6)) + b"\0" + bytes(range(6, 12))
    assert zlib.decompress((p := images.to_png(bytes(4), 1, 1, space="DeviceCMYK"))[p.index(b"IDAT") + 4 : -16]) == b"\0\xff\xff\xff"
    kinds = [b"\xff\xd8\xff\xe0----", b"GIF89a--", b"BM------", b"II*\0----", b"short", b"\xd7\xcd\xc6\x9a----"]
    got = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, d binary").select("i", images.sniff(F.col("d")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == ["jpeg", "gif", "bmp", "tiff", "bin", "wmf"]
    assert one(spark, images.suffix(F.lit("JPEG"))) == ".jpg" and one(spark, images.suffix(F.lit("odd"))) == ".bin"
    links = F.array(F.struct(F.lit(1).alias("ord"), F.lit("image_001").alias("id"), F.lit("pic").alias("alt"), F.lit("a/b.png").alias("link")))
    assert one(spark, images.references(F.lit("x ![image_001]"), links)) == "x ![pic](a/b.png)"


# --- files, API, streaming ---------------------------------------------------


def _folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(synth.pdf([_page((100, "words of a"), (300, "more"))]))
    (tmp_path / "in/B.PDF").write_bytes(b"broken")
    (tmp_path / "in/sub/a.docx").write_bytes(synth.docx(synth.para(synth.run("words of c"))))
    (tmp_path / "in/sub/x.txt").write_text("no")
    os.symlink(tmp_path / "in", tmp_path / "in/sub/loop")
    return str(tmp_path / "in")


def test_convert_folder(spark, tmp_path):
    folder = _folder(tmp_path)
    with pytest.raises(IsADirectoryError):
        api.convert(spark, folder)
    with pytest.raises(FileNotFoundError):
        api.convert(spark, folder + "/none.pdf")
    assert [os.path.basename(p) for p, _ in files.walk(folder)] == ["B.PDF", "a.pdf", "a.docx", "x.txt"]
    options = Options(recursive=True, output_directory=str(tmp_path / "out"))
    done = api.convert(spark, folder, options)
    assert {(r.status, r.files) for r in done.summary().collect()} == {("converted", 2), ("failed", 1)}
    done.write().collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["a.docx.md", "a.pdf.md"] and "words of a" in (tmp_path / "out/a.pdf.md").read_text()
    with pytest.raises(ValueError, match="unsupported file type"):
        api.convert(spark, folder + "/sub/x.txt")


def _tree(folder):
    return {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(folder) for n in names if n.endswith((".md", ".png", ".jpg"))}


def test_existing_files_are_left_alone(spark, tmp_path):
    word = lambda t: synth.docx(synth.para(synth.run(t)))
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in (("a", "one"), ("b", "two"), ("sub/a", "three")):
        (tmp_path / f"in/{name}.docx").write_bytes(word(text))
    (tmp_path / "in/a.docx.md").write_text("KEEP ME")
    folder, options = str(tmp_path / "in"), Options(recursive=True)
    done = api.convert(spark, folder, options)
    # decided before anything is decoded
    assert done.markdown.count() == 2
    assert {os.path.relpath(r.doc_id.removeprefix("file:"), folder): (r.status, os.path.basename(r.output_path)) for r in done.write().collect()} == {"a.docx": ("skipped", "a.docx.md"), "b.docx": ("converted", "b.docx.md"), "sub/a.docx": ("converted", "a.docx.md")}
    made = _tree(folder)
    assert made["a.docx.md"] == b"KEEP ME" and b"three" in made["sub/a.docx.md"] and b"two" in made["b.docx.md"]
    again = api.convert(spark, folder, options)
    assert {(r.status, r.files) for r in again.summary().collect()} == {("skipped", 3)} and again.write().count() == 3 and _tree(folder) == made
    # tables made without a look at what is there are held against it when they are written
    found = files.read(spark, folder, options)
    assert {r.status for r in api.convert_files(found).write(options).collect()} == {"skipped"} and _tree(folder) == made
    more = api.convert(spark, folder, Options(recursive=True, skip_existing=False))
    assert {os.path.basename(r.output_path) for r in more.write().collect()} == {"a.docx-1.md", "b.docx-1.md"}
    grown = _tree(folder)
    assert {k: grown[k] for k in made} == made and b"one" in grown["a.docx-1.md"] and len(grown) == 6
    # files that meet at a name in one folder get numbers, and keep them in a second run
    flat = Options(recursive=True, output_directory=str(tmp_path / "flat"))
    for _ in range(2):
        api.convert(spark, folder, flat).write().collect()
        assert sorted(os.listdir(tmp_path / "flat")) == ["a.docx-1.md", "a.docx.md", "b.docx.md"]


def test_images_are_written_and_linked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    jpeg = b"\xff\xd8\xff\xe0 some data"
    body = synth.para(synth.run("See "), synth.drawing("rId8", "a pic"), synth.drawing("rId9"))
    (tmp_path / "in/w.docx").write_bytes(synth.docx(body, images={"rId8": jpeg, "rId9": b"\x89PNG\r\n\x1a\n123"}))
    (tmp_path / "in/s.pdf").write_bytes(synth.pdf([[], _page((100, "text " * 30))], {0: (600, 700, b"\1\2\3" * 420_000), 1: (10, 10, b"abc" * 100)}))
    options = Options(recursive=True, output_directory=str(tmp_path / "out"))
    api.convert(spark, str(tmp_path / "in"), options).write().collect()
    made = _tree(str(tmp_path / "out"))
    assert set(made) == {"w.docx.md", "s.pdf.md", "w.docx_images/image_001.jpg", "w.docx_images/image_002.png", "s.pdf_images/page_001.png", "s.pdf_images/image_001.png"}
    assert made["w.docx_images/image_001.jpg"] == jpeg and made["s.pdf_images/page_001.png"].startswith(b"\x89PNG")
    assert b"![a pic](w.docx_images/image_001.jpg)" in made["w.docx.md"] and b"![image](w.docx_images/image_002.png)" in made["w.docx.md"]
    assert b"![image](s.pdf_images/page_001.png)" in made["s.pdf.md"] and b"![image](s.pdf_images/image_001.png)" in made["s.pdf.md"]


def test_bytes_callbacks_and_tables_for_sql(spark):
    word = synth.docx(synth.para(synth.run("plain"), synth.drawing("rId8", "p")), images={"rId8": b"\x89PNG\r\n\x1a\n123"})
    text, found = api.convert_bytes(spark, word, ".docx")
    assert text.startswith("plain") and [(i["image_id"], i["format"]) for i in found] == [("image_001", "png")]
    with pytest.raises(ValueError, match="ZIP"):
        api.convert_bytes(spark, b"junk", "xlsx")
    book, prints = synth.xlsx([{"name": "S", "cells": [(1, 1, "k"), (2, 3, 4)]}]), synth.pdf([_page((100, "first")), _page((100, "second"))])
    table = spark.createDataFrame([("a", ".docx", word), ("b", ".xlsx", book), ("c", ".pdf", prints), ("d", ".pdf", b"no")], "doc_id string, ext string, content binary").withColumn("length", F.length("content"))
    said = []
    note = lambda name: lambda *a: said.append((name, *a))
    api.convert_files(table).notify(api.Callbacks(file_complete=note("file"), page_parsed=note("page"), sheet_parsed=note("sheet")))
    assert {s[1] for s in said if s[0] == "file"} == set("abcd") and [s[-1] for s in said if s[0] == "file" and s[1] == "d"] != [None]
    assert [s[1:] for s in said if s[0] == "page"] == [("c", 1, 2), ("c", 2, 2)] and [s[1:] for s in said if s[0] == "sheet"] == [("b", "S", 2, 3)]
    tables.register(spark)
    table.createOrReplaceTempView("held_files")
    q = lambda name, doc: [tuple(r) for r in spark.sql(f"SELECT t.* FROM held_files, LATERAL {name}(content) t WHERE doc_id = '{doc}'").collect()]
    assert [r[2] for r in sorted(q("docloom_paragraphs", "a"))] == ["plain"] and sorted((r[1], r[2], r[3]) for r in q("docloom_cells", "b")) == [(1, 1, "k"), (2, 3, "4")]
    assert sorted((r[0], r[-1]) for r in q("docloom_text_items", "c")) == [(0, "first"), (1, "second")] and q("docloom_text_items", "d") == []


def test_command_line(spark, tmp_path):
    from docloom.__main__ import main

    (tmp_path / "a.docx").write_bytes(synth.docx(synth.para(synth.run("said"))))
    (tmp_path / "b.docx").write_bytes(b"junk")
    assert main([str(tmp_path / "a.docx")], spark) == 0 and "said" in (tmp_path / "a.docx.md").read_text()
    assert main(["-r", str(tmp_path)], spark) == 1 and main([str(tmp_path / "none.pdf")], spark) == 1 and main([], spark) == 1
    assert main(["--output", str(tmp_path / "x.md"), str(tmp_path / "a.docx")], spark) == 0 and "said" in (tmp_path / "x.md").read_text()
    (tmp_path / "c.txt").write_text("x")
    assert main(["-o", str(tmp_path / "c.md"), str(tmp_path / "c.txt")], spark) == 1


def test_targets(spark):
    found = spark.createDataFrame([("/x/a.pdf",), ("/y/a.pdf",), ("/x/b.pdf",)], "doc_id string")
    there = spark.createDataFrame([("o/a.pdf.md",), ("o/a.pdf-1.md",)], "path string")
    get = lambda e, **o: {r.doc_id: (r.output_path, r.status) for r in files.targets(found, e, Options(output_directory="o", **o)).collect()}
    assert get(there.limit(0)) == {"/x/a.pdf": ("o/a.pdf.md", "new"), "/y/a.pdf": ("o/a.pdf-1.md", "new"), "/x/b.pdf": ("o/b.pdf.md", "new")}
    # the first two were written before, as their numbers show
    assert get(there) == {"/x/a.pdf": ("o/a.pdf.md", "skipped"), "/y/a.pdf": ("o/a.pdf-1.md", "skipped"), "/x/b.pdf": ("o/b.pdf.md", "new")}
    assert get(there, skip_existing=False) == {"/x/a.pdf": ("o/a.pdf-2.md", "new"), "/y/a.pdf": ("o/a.pdf-3.md", "new"), "/x/b.pdf": ("o/b.pdf.md", "new")}
    assert files.normalized(["PDF", ".Docx"]) == [".pdf", ".docx"]


def test_targets_pass_over_taken_numbers(spark):
    """Files of one name among many taken numbers with gaps, one of them too large for an int: as by hand, and without a list of numbers for each file."""
    names = sorted(f"/{k}/a.pdf" for k in range(300))
    taken = {0, *range(3, 90, 2), 200, 201, 202, 10**11}
    there = spark.createDataFrame([(f"o/a.pdf{f'-{n}' if n else ''}.md",) for n in taken], "path string")
    for skip in (True, False):
        made = files.targets(spark.createDataFrame([(n,) for n in names], "doc_id string"), there, Options(output_directory="o", skip_existing=skip))
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "collect_set" not in plan
        free = [n for n in range(600) if skip or n not in taken]
        assert {r.doc_id: (r.output_path, r.status) for r in made.collect()} == {d: (f"o/a.pdf{f'-{n}' if n else ''}.md", "skipped" if skip and n in taken else "new") for d, n in zip(names, free)}


def test_decoded_files_leave_in_bounded_batches(spark):
    """A batch ends by array elements or bytes, whatever the number of files; broken files are rows among the others."""
    from docloom.sources import batches, docx, pdf, xlsx

    big = batches.ELEMENTS // 4
    cut = list(batches.cut((n, b, {"i": i}) for i, (n, b) in enumerate([(big, 1)] * 10 + [(3 * batches.ELEMENTS, 1), (1, 1), (0, batches.BYTES)] + [(0, 0)] * 5)))
    assert [len(c) for c in cut] == [4, 4, 3, 2, 5] and [r["i"] for c in cut for r in c] == list(range(18))
    book = synth.xlsx([{"name": "S", "cells": [(r, 1, r) for r in range(1, 3001)]}], [(164, "0.0")])
    for reader, good, field, n in ((xlsx, book, "cells", 3000), (docx, synth.docx(synth.para(synth.run("x")) * 3000), "paras", 3000), (pdf, synth.pdf([[(72, 10, "x", 12, "F1")] * 3000]), "items", 3000)):
        files = spark.createDataFrame([(str(i), good if i % 5 else b"junk" if i else None) for i in range(15)], "doc_id string, content binary").coalesce(1)
        found = {r.doc_id: (r.n, r.error) for r in reader.decode(files).selectExpr("doc_id", f"size({field}) as n", "error").collect()}
        assert len(found) == 15 and all(found[str(i)] == (n, None) if i % 5 else found[str(i)][0] == 0 and found[str(i)][1] for i in range(15))


def test_plain_packages_are_read_without_zipfile():
    """Parts of a plain package come from its directory; with a comment, or damaged, ``zipfile`` has the say. Documents of one template share their levels."""
    import io
    import zipfile

    from docloom.sources import docx, ooxml

    data = synth.docx(synth.para(synth.run("x"), num=(1, 0)), numbering=[(1, ["decimal"])])
    plain = ooxml.Package(data)
    assert plain.zip is None and plain.names == zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert all(plain.read(n) == zipfile.ZipFile(io.BytesIO(data)).read(n) for n in plain.names) and plain.read("no") is None and plain.zip is None
    first, second = docx.parse(data), docx.parse(data)
    assert first == second and first["levels"] is second["levels"] and first["levels"] == [{"num_id": 1, "ilvl": 0, "num_fmt": "decimal"}]
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"said"
    assert ooxml.Package(out.getvalue()).zip is not None and docx.parse(out.getvalue()) == first
    at = data.index(b"PK\1\2") - 40
    with pytest.raises(Exception):
        docx.parse(data[:60] + bytes(20) + data[80:at] + data[at:])
    with pytest.raises(ooxml.PackageError):
        ooxml.Package(data[:-30])


def test_pdf_pages_are_counted_without_reading_them():
    from docloom.sources import pdf

    data = synth.pdf([[(72, 60 + k, "wide words", 12, "F1") for k in range(30)]] * 3, unicode=True)
    whole, counted = pdf.parse(data), pdf.parse(data, False, False)
    assert counted["n_pages"] == whole["n_pages"] == 3 and counted["status"] == "ok" and counted["pages"] == whole["pages"]
    assert len(whole["items"]) == 90 and counted["items"] == []


def test_pdf_values_by_one_match_are_those_read_step_by_step():
    """Numbers, names, words and hex strings in all the company they may keep."""
    from docloom.sources.pdf.objects import END, Lexer, Name, Word

    data = b"1 -2.5 .5 +7 4. 12ab /A /B#20C/D <4142><4>(a) Tj'[1 2]/E<< /F 1>>true nullx null%c\n<41 42>"
    lexer, found = Lexer(data), []
    while (v := lexer.value()) is not END:
        found.append(v)
    assert found == [1, -2.5, 0.5, 7, 4.0, "12ab", "A", "B C", "D", b"AB", b"@", b"a", "Tj'", [1, 2], "E", {"F": 1}, True, "nullx", None, b"AB"]
    assert [type(found[i]) for i in (0, 1, 5, 6, 7, 12)] == [int, float, Word, Name, Name, Word]


def test_items_are_spread_before_they_are_counted(spark):
    """A small file of very many documents is one split: its items are dealt out by document below the statistics too, not for the layout alone."""
    from docloom.plans import queries as Q

    plan = Q.QUERIES["layout_spaces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [doc_id") > 1


def test_stream_converts_each_file_once(spark, tmp_path):
    folder, out = _folder(tmp_path), str(tmp_path / "out")
    os.remove(tmp_path / "in/sub/loop")
    for _ in range(2):
        convert_stream(spark, folder, out, str(tmp_path / "check"), Options(recursive=True)).awaitTermination()
    log = spark.read.parquet(out + "/log")
    assert log.count() == 3 and {r.status for r in log.collect()} == {"converted", "failed"}
    assert spark.read.parquet(out + "/markdown").count() == 2 and spark.read.parquet(out + "/images").count() == 0
    left = lambda: set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")))
    before = left()
    with released(spark):
        kept = stored(spark.range(3), "kept")
        assert kept.count() == 3 and len(left()) == len(before) + 1
    assert left() == before


def test_rest_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "docloom"), tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') and n[2:3].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
