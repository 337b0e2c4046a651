"""Lines of decoded text documents: runs merged, headings and list items typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.options import WordOptions


def merge_runs(words: Column) -> Column:
    """Neighbouring plain words of one format become one word."""
    none = F.array().cast("array<struct<s:string,type:string,format:string>>")

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & last["type"].isNull() & w["type"].isNull() & last["format"].eqNullSafe(w["format"])
        longer = F.struct(F.concat(last["s"], w["s"]).alias("s"), w["type"].alias("type"), w["format"].alias("format"))
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(w)))

    return F.when(F.size(words) == 0, none).otherwise(F.aggregate(F.slice(words, 2, F.size(words)), F.slice(words, 1, 1), step))


def clean_words(words: Column) -> Column:
    """Without blank words (a lone tab stays); runs of spaces become one."""
    kept = F.filter(words, lambda w: (T.strip(w["s"]) != "") | (w["s"] == "\t"))
    return F.transform(kept, lambda w: F.struct(T.single_spaces(w["s"]).alias("s"), w["type"].alias("type"), w["format"].alias("format")))


def heading_level(style_id: Column, name: Column, outline: Column) -> Column:
    """1 to 6 by a style's name, its id or its outline level; null for others."""
    low = F.lower(name)
    digit = lambda text, start: F.substring(text, start, 1)
    level = F.coalesce(
        F.when(low.startswith("heading ") & digit(low, 9).rlike("[1-6]"), digit(low, 9).cast("int")),
        F.when(low == "title", F.lit(1)), F.when(low == "subtitle", F.lit(2)),
        F.when(F.lower(style_id).startswith("heading") & digit(style_id, 8).rlike("[1-6]"), digit(style_id, 8).cast("int")),
        F.when(outline.between(0, 5), outline + 1),
    )
    return level


def lines(docs: DataFrame, options: WordOptions | None = None) -> DataFrame:
    """(doc_id, seq, type, list_level, words, is_table_row, is_table_header, table_columns, table_no).

    Styles and list formats are looked up in the document's own arrays; list
    numbers count the items of a list and level in document order.
    """
    o = options or WordOptions()
    styles = F.map_from_entries(F.transform("styles", lambda s: F.struct(s["style_id"], s)))
    levels = F.map_from_entries(F.transform("levels", lambda v: F.struct(F.concat_ws("/", v["num_id"], v["ilvl"]), v["num_fmt"])))
    looked = docs.select("doc_id", F.transform("paras", lambda p: p).alias("paras"), styles.alias("by_id"), levels.alias("by_level"))

    def typed(p: Column) -> Column:
        style = F.when(p["style_id"].isNotNull(), F.element_at("by_id", p["style_id"]))
        fmt = F.when(p["num_id"].isNotNull(), F.coalesce(F.element_at("by_level", F.concat_ws("/", p["num_id"], p["ilvl"])), F.lit("bullet")))
        return F.struct(p["seq"].alias("seq"), p["kind"].alias("kind"), heading_level(style["style_id"], style["name"], style["outline_lvl"]).alias("level"), p["num_id"].alias("num_id"), p["ilvl"].alias("ilvl"), fmt.alias("num_fmt"), clean_words(merge_runs(p["words"])).alias("words"), p["cells"].alias("table_columns"), p["is_first_row"].alias("is_table_header"), p["table_no"].alias("table_no"))

    rows = looked.select("doc_id", F.inline(F.transform("paras", typed))).where("kind = 'tr' or size(words) > 0")
    # every window and grouping below is within a document: one exchange serves them all
    rows = rows.repartition("doc_id")
    counter = F.row_number().over(Window.partitionBy("doc_id", "num_id", "ilvl").orderBy("seq"))
    rows = rows.withColumn("n", F.when(F.col("num_id").isNotNull(), counter))
    prefix = F.when(F.col("num_id").isNotNull(), T.list_prefix(F.col("num_fmt"), F.col("n"), o.compat)).otherwise(F.lit(""))
    rows = rows.withColumn("prefix", prefix)
    words = F.transform("words", lambda w, i: F.struct(F.when(i == 0, F.concat("prefix", w["s"])).otherwise(w["s"]).alias("s"), w["type"].alias("type"), (w["format"] if o.preserve_formatting else F.lit(None).cast("string")).alias("format")))
    kind = F.when(F.col("num_id").isNotNull(), F.lit("LIST")).when(F.col("level").isNotNull(), T.heading_kind(F.col("level")))
    return rows.select("doc_id", "seq", kind.alias("type"), F.when(F.col("num_id").isNotNull(), F.col("ilvl")).otherwise(F.lit(0)).alias("list_level"), words.alias("words"), (F.col("kind") == "tr").alias("is_table_row"), "is_table_header", "table_columns", "table_no", "num_id", "n")


def notes(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, note_kind, note_id, text): notes in the order of their references, footnotes first."""
    text = F.map_from_entries(F.transform("notes", lambda n: F.struct(F.concat_ws("/", n["note_kind"], n["note_id"]), n["text"])))
    refs = docs.select("doc_id", text.alias("texts"), F.inline("note_refs"))
    found = refs.withColumn("text", F.element_at("texts", F.concat_ws("/", "note_kind", "note_id"))).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy(F.desc("note_kind"), "ref_seq")
    return found.select("doc_id", F.row_number().over(order).alias("ord"), "note_kind", "note_id", "text")


def images(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline("images"))
