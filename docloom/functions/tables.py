"""Decoders as table functions, for SQL over a column of files.

``SELECT f.path, t.* FROM files f, LATERAL docloom_cells(f.content) t``; a file
that can't be read gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Cells:
    def eval(self, content: bytes) -> Iterator[tuple]:
        from docloom.sources import xlsx

        try:
            book = xlsx.parse(bytes(content or b""))
        except Exception:  # a broken file, whatever is wrong with it, has no rows
            return
        for c in book["cells"]:
            shared = c["kind"] == "s" and c["raw"].strip().isdigit() and int(c["raw"]) < len(book["strings"])
            yield book["sheets"][c["sheet_no"]]["sheet_name"], c["row"], c["col"], book["strings"][int(c["raw"])] if shared else c["raw"] or c["inline"], c["formula"]


class Paragraphs:
    def eval(self, content: bytes) -> Iterator[tuple]:
        from docloom.sources import docx

        try:
            found = docx.parse(bytes(content or b""))
        except Exception:
            return
        for p in found["paras"]:
            yield p["seq"], p["style_id"], " | ".join(p["cells"]) if p["kind"] == "tr" else "".join(w["s"] for w in p["words"] if w["type"] != "IMAGE")


class TextItems:
    def eval(self, content: bytes) -> Iterator[tuple]:
        from docloom.sources import pdf

        try:
            found = pdf.parse(bytes(content or b""))
        except Exception:
            return
        for i in found["items"]:
            yield i["page_idx"], i["seq"], float(i["x"]), float(i["y"]), float(i["width"]), float(i["height"]), i["font"], i["text"]


def register(spark: SparkSession) -> None:
    """Makes ``docloom_cells``, ``docloom_paragraphs`` and ``docloom_text_items`` known to SQL."""
    spark.udtf.register("docloom_cells", udtf(Cells, returnType="sheet string, row int, col int, value string, formula string"))
    spark.udtf.register("docloom_paragraphs", udtf(Paragraphs, returnType="seq int, style string, text string"))
    spark.udtf.register("docloom_text_items", udtf(TextItems, returnType="page_idx int, seq int, x double, y double, width double, height double, font string, text string"))
