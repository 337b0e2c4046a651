"""Text documents to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks, paragraphs, render
from docloom.options import WordOptions


def _sides(side: str, title: str) -> Column:
    own = F.array_sort(F.filter("sides", lambda s: s["side"] == side), lambda a, b: F.when(a["part"] < b["part"], -1).when(a["part"] > b["part"], 1).otherwise(0))
    text = F.array_join(F.transform(own, lambda s: F.concat(F.lit("**"), s["part"], F.lit("**: "), s["text"], F.lit("\n\n"))), "")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(f"## {title}\n\n"), text))


def markdown(docs: DataFrame, options: WordOptions | None = None) -> DataFrame:
    """(doc_id, markdown) of every readable document of decoded ``docs``."""
    o = options or WordOptions()
    numbered = blocks.number_docx_blocks(paragraphs.lines(docs, o), o.compat)
    body = render.docx_markdown(render.blocks(numbered, ["doc_id"], "seq"))
    each = F.concat(F.lit("[^"), "note_id", F.lit("]: "), "text", F.lit("\n\n"))
    noted = paragraphs.notes(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", each.alias("x")))).alias("n"))
    noted = noted.select("doc_id", F.concat(F.lit("\n\n## Footnotes\n\n"), F.array_join(F.transform("n", lambda x: x["x"]), "")).alias("notes"))
    rows = docs.where("error is null").select("doc_id", "sides").join(body, "doc_id", "left").join(noted, "doc_id", "left")
    parts = [F.coalesce("body", F.lit(""))]
    if o.headers_footers:
        head, foot = _sides("header", "Document Headers"), _sides("footer", "Document Footers")
        parts = [F.when(head == "", head).otherwise(F.concat(head, F.lit("---\n\n"))), *parts, F.when(foot == "", foot).otherwise(F.concat(F.lit("\n\n---\n\n"), foot))]
    text = F.concat(*parts, F.coalesce("notes", F.lit("")))
    return rows.select("doc_id", (T.compact(text) if o.compact else text).alias("markdown"))
