"""What a document's lines hold besides text: notes, links, formats; by page, and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_idx, note_links, has_links, formatted_words) of lines (doc_id, page_idx, line_no, words)."""
    kind = lambda t: F.filter("words", lambda w: w["type"] == t)
    notes = F.transform(kind("FOOTNOTE_LINK"), lambda w: w["s"].cast("int"))
    by_line = F.array_sort(F.collect_list(F.struct("line_no", notes.alias("n"))))
    return lines.groupBy("doc_id", "page_idx").agg(
        F.flatten(F.transform(by_line, lambda x: x["n"])).alias("note_links"), F.max(F.size(kind("LINK")) > 0).alias("has_links"),
        F.sum(F.size(F.filter("words", lambda w: w["format"].isNotNull()))).alias("formatted_words"),
    )


def merged(pages: DataFrame) -> DataFrame:
    """One row per document: lists one after the other by page, flags or-ed, counts added."""
    listed = F.array_sort(F.collect_list(F.struct("page_idx", "note_links")))
    return pages.groupBy("doc_id").agg(F.flatten(F.transform(listed, lambda x: x["note_links"])).alias("note_links"), F.max("has_links").alias("has_links"), F.sum("formatted_words").alias("formatted_words"))
