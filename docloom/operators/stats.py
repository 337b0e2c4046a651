"""What is usual in a document: heights, fonts and line distances of its items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Of equally frequent values the lowest counts.
_MODE = "mode() WITHIN GROUP (ORDER BY {})"


def modal_height(items: DataFrame) -> DataFrame:
    """(doc_id, mode_h): the most frequent whole height but 0."""
    return items.withColumn("hh", F.col("height").cast("int")).groupBy("doc_id").agg(F.expr(_MODE.format("nullif(hh, 0)")).alias("mode_h"))


def modal_font(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id").agg(F.expr(_MODE.format("font")).alias("mode_font"))


def tallest(items: DataFrame) -> DataFrame:
    """(doc_id, max_h, max_font): the largest whole height and the font that reaches it first."""
    h = F.col("height").cast("int")
    return items.groupBy("doc_id").agg(F.max(h).alias("max_h"), F.min_by("font", F.struct(-h, "page_idx", "seq")).alias("max_font"))


def usual(items: DataFrame) -> DataFrame:
    """(doc_id, mode_h, mode_font, max_h, max_font): all of the above by one pass."""
    h = F.col("height").cast("int")
    return items.withColumn("hh", h).groupBy("doc_id").agg(
        F.expr(_MODE.format("nullif(hh, 0)")).alias("mode_h"), F.expr(_MODE.format("font")).alias("mode_font"), F.max(h).alias("max_h"), F.min_by("font", F.struct(-h, "page_idx", "seq")).alias("max_font")
    )


def line_distance(items: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """(doc_id, distance): the most frequent positive step from an item of usual height to the next, 12 by default."""
    modes = modal_height(items) if modes is None else modes
    page = Window.partitionBy("doc_id", "page_idx").orderBy("seq")
    usual = (F.col("height").cast("int") == F.col("mode_h")) & (F.trim("text") != "")
    seen = items.join(modes, "doc_id").withColumn("usual", F.coalesce(usual, F.lit(False)))
    step = F.when(F.col("usual") & F.lag("usual").over(page), (F.lag("y").over(page) - F.col("y")).cast("int"))
    found = seen.withColumn("step", step).withColumn("step", F.when(F.col("step") > 0, F.col("step")))
    return found.groupBy("doc_id").agg(F.coalesce(F.expr(_MODE.format("step")), F.lit(12)).alias("distance"))


def font_styles(fonts: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, styles): bold and oblique fonts by name; the tallest font is bold, the usual one plain."""
    name = F.lower(F.coalesce("base_font", F.lit("")))
    bold, slant = name.contains("bold"), name.contains("oblique") | name.contains("italic")
    style = (
        F.when(F.col("font_id") == F.col("mode_font"), F.lit(None).cast("string"))
        .when(bold & slant, F.lit("BOLD_OBLIQUE")).when(bold, F.lit("BOLD")).when(slant, F.lit("OBLIQUE"))
        .when(F.col("font_id") == F.col("max_font"), F.lit("BOLD"))
    )
    named = fonts.join(stats.select("doc_id", "mode_font", "max_font"), "doc_id").withColumn("style", style).dropDuplicates(["doc_id", "font_id"])
    return named.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("font_id", "style"))).alias("styles"))


def document_stats(items: DataFrame, fonts: DataFrame) -> DataFrame:
    """One row per document: mode_h, mode_font, max_h, max_font, distance, styles."""
    found = usual(items)
    found = found.join(line_distance(items, found.select("doc_id", "mode_h")), "doc_id")
    return found.join(font_styles(fonts, found), "doc_id", "left")
