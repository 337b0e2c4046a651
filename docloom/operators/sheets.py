"""Cells, blocks and Markdown of decoded workbooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import cells as C
from docloom.functions import text as T
from docloom.options import SheetOptions

SHEET = ["doc_id", "sheet_no"]


def sheets(books: DataFrame) -> DataFrame:
    return books.select("doc_id", F.inline("sheets"))


def merges(books: DataFrame) -> DataFrame:
    return books.select("doc_id", F.inline("merges"))


def tables(books: DataFrame) -> DataFrame:
    return books.select("doc_id", F.inline("tables"))


def hidden(books: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, axis, idx): hidden rows and columns, ranges spelled out."""
    spans = books.select("doc_id", F.inline("hidden")).where("first <= last")
    return spans.select(*SHEET, "axis", F.explode(F.sequence("first", "last")).alias("idx")).distinct()


def _resolved(books: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, row, col, i, value, formula) of all cells, in the order of their files.

    Shared strings and number formats are looked up in the file's own arrays
    before cells become rows, so nothing is joined or moved.
    """

    def resolved(c: Column, i: Column) -> Column:
        raw = T.strip(c["raw"])
        index = F.when(raw.rlike("^[+-]?[0-9]{1,9}$"), raw.cast("int"))
        shared = F.when(index >= 0, F.get("strings", index))
        style = F.when(c["style"] >= 0, F.get("styles", c["style"]))
        given = (
            F.when((c["kind"] == "s") & shared.isNotNull(), shared)
            .when((c["kind"] == "inlineStr") & (c["inline"] != ""), c["inline"])
            .when(c["kind"] == "b", F.when(raw == "1", F.lit("TRUE")).otherwise(F.lit("FALSE")))
            .when(c["kind"].isin("e", "str"), raw)
            .when(c["raw"] == "", c["inline"])
        )
        return F.struct(c["sheet_no"].alias("sheet_no"), c["row"].alias("row"), c["col"].alias("col"), i.alias("i"), given.alias("given"), c["raw"].alias("raw"), style.alias("format_id"), F.when(style.isNotNull(), F.element_at("formats", style)).alias("code"), c["formula"].alias("formula"))

    rows = books.select("doc_id", F.inline(F.transform("cells", resolved)))
    value = F.when(F.col("given").isNotNull(), F.col("given")).otherwise(C.formatted("raw", "format_id", "code"))
    return rows.select(*SHEET, "row", "col", "i", value.alias("value"), "formula")


def cells(books: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, row, col, value, formula); the last of several cells at one place counts."""
    last = F.max_by(F.struct("value", "formula"), "i")
    return _resolved(books).groupBy(*SHEET, "row", "col").agg(last.alias("c")).select(*SHEET, "row", "col", "c.value", "c.formula")


def bounds(found: DataFrame) -> DataFrame:
    """Largest row, least and largest column of each sheet; merges don't count."""
    return found.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))


_BLOCK = "struct<kind:string,name:string,r0:int,c0:int,r1:int,c1:int,at:int>"
_MARK = f"struct<sheet_no:int,row:int,span:struct<r0:int,c0:int,c1:int>,known:{_BLOCK},gone:boolean,sheet_name:string,hidden_cols:array<struct<first:int,last:int>>,every:array<{_BLOCK}>>"


def _marks() -> Column:
    """What a workbook says about its rows besides cells; row 0 is the sheet itself, sheet -1 the workbook.

    Merges and tables become a mark a row, not a cell, and end with the sheet's
    last row, whatever they claim.
    """
    none = {"span": "struct<r0:int,c0:int,c1:int>", "known": _BLOCK, "gone": "boolean", "sheet_name": "string", "hidden_cols": "array<struct<first:int,last:int>>", "every": f"array<{_BLOCK}>"}

    def mark(sheet: Column, row: Column, **said: Column) -> Column:
        return F.struct(sheet.cast("int").alias("sheet_no"), row.cast("int").alias("row"), *[said.get(k, F.lit(None)).cast(t).alias(k) for k, t in none.items()]).cast(_MARK)

    def on_rows(items: Column, first: str, last: str, make) -> Column:
        def each(x: Column) -> Column:
            reach = F.least(x[last], F.get("sheets", x["sheet_no"])["reach"])
            return F.transform(F.when(x[first] <= reach, F.sequence(x[first], reach)).otherwise(F.array().cast("array<int>")), lambda r: make(x, r))

        return F.flatten(F.transform(items, each))

    table = lambda t, i: F.struct(F.lit("table").alias("kind"), t["name"].alias("name"), t["r0"].alias("r0"), t["c0"].alias("c0"), t["r1"].alias("r1"), t["c1"].alias("c1"), i.alias("at"), t["sheet_no"].alias("sheet_no"))
    tables = F.filter(F.transform("tables", table), lambda t: t["r0"] <= t["r1"])
    plain = lambda t: F.struct(*[t[x].alias(x) for x in ("kind", "name", "r0", "c0", "r1", "c1", "at")])
    own = lambda s: mark(
        s["sheet_no"], F.lit(0), sheet_name=s["sheet_name"], every=F.transform(F.filter(tables, lambda t: t["sheet_no"] == s["sheet_no"]), plain),
        hidden_cols=F.transform(F.filter("hidden", lambda h: (h["axis"] == "col") & (h["sheet_no"] == s["sheet_no"])), lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"))),
    )
    return F.concat(
        F.array(mark(F.lit(-1), F.lit(0))), F.transform("sheets", own),
        on_rows(F.col("merges"), "r0", "r1", lambda m, r: mark(m["sheet_no"], r, span=F.struct(m["r0"].alias("r0"), m["c0"].alias("c0"), m["c1"].alias("c1")))),
        on_rows(F.filter("hidden", lambda h: h["axis"] == "row"), "first", "last", lambda h, r: mark(h["sheet_no"], r, gone=F.lit(True))),
        on_rows(tables, "r0", "r1", lambda t, r: mark(t["sheet_no"], r, known=plain(t))),
    )


def has_data(cell: Column) -> Column:
    return ~T.blank(cell["value"]) | (cell["formula"] != "")


def grid(books: DataFrame) -> DataFrame:
    """One row per row of a sheet, all of a sheet in one partition: everything after this needs no exchange until documents are put together.

    Holds row (0: the sheet itself), cells (col, value, formula), spans (merges
    over the row), gone (hidden), blocks (tables and the run of rows with data
    that the row is in; of row 0 all tables), sheet_name and hidden_cols.
    """
    readable = books.where("error is null")
    cell = _resolved(readable).select(*SHEET, "row", F.struct("col", "i", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("formula", F.lit("")).alias("formula")).alias("cell"))
    marks = readable.select("doc_id", F.inline(_marks()))
    rows = cell.unionByName(marks, allowMissingColumns=True).repartition(*SHEET)
    rows = rows.groupBy(*SHEET, "row").agg(
        F.array_sort(F.collect_list("cell")).alias("cells"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("known")).alias("known"),
        F.coalesce(F.max("gone"), F.lit(False)).alias("gone"), F.max("sheet_name").alias("sheet_name"), F.max("hidden_cols").alias("hidden_cols"), F.max("every").alias("every"),
    )
    # the last of several cells at one place counts
    rows = rows.withColumn("cells", F.filter("cells", lambda c, k: (k == F.size("cells") - 1) | (F.get("cells", k + 1)["col"] != c["col"])))
    sheet = Window.partitionBy(*SHEET)
    free = F.exists("cells", has_data) & (F.size("known") == 0)
    rows = rows.withColumn("hidden_cols", F.coalesce(F.max("hidden_cols").over(sheet), F.array().cast("array<struct<first:int,last:int>>"))).withColumn("free", free)
    rows = rows.withColumn("island", F.col("row") - F.row_number().over(Window.partitionBy(*SHEET, "free").orderBy("row")))
    touched = F.concat(F.transform(F.filter("cells", has_data), lambda c: c["col"]), F.transform("spans", lambda s: s["c0"]), F.transform("spans", lambda s: s["c1"]))
    run = Window.partitionBy(*SHEET, "free", "island")
    edges = [F.lit("range").alias("kind"), F.lit("").alias("name"), F.min("row").over(run).alias("r0"), F.min(F.array_min(touched)).over(run).alias("c0"), F.max("row").over(run).alias("r1"), F.max(F.array_max(touched)).over(run).alias("c1"), F.lit(-1).alias("at")]
    rows = rows.withColumn("range", F.struct(*edges).cast(_BLOCK))
    blocks_of = F.when(F.col("row") == 0, F.coalesce("every", F.array().cast(f"array<{_BLOCK}>"))).when(F.col("free"), F.array("range")).otherwise(F.col("known"))
    return rows.select(*SHEET, "row", "cells", "spans", "gone", blocks_of.alias("blocks"), "sheet_name", "hidden_cols")


def blocks(rows: DataFrame) -> DataFrame:
    """(doc_id, sheet_no, kind, name, r0, c0, r1, c1) of ``grid``: tables, and runs of rows with data outside them."""
    return rows.select(*SHEET, F.explode("blocks").alias("b")).distinct().select(*SHEET, *[f"b.{x}" for x in ("kind", "name", "r0", "c0", "r1", "c1")])


def display(value: Column, formula: Column, covered: Column, formulas: bool = True) -> Column:
    """What a cell shows; ``covered``: a merge covers it that begins elsewhere."""
    text, formula_text = T.strip(value), F.concat(F.lit("="), formula)
    if formulas:
        text = F.when(formula == "", text).when(text == "", formula_text).otherwise(F.concat(text, F.lit(" ("), formula_text, F.lit(")")))
    return C.clean_cell(F.when((text == "") & covered, F.lit("[merged]")).otherwise(text))


def _merged(col: Column) -> Column:
    return F.exists("spans", lambda s: (s["c0"] <= col) & (s["c1"] >= col))


def _shown(cell: Column, col: Column, formulas: bool) -> Column:
    """What the place shows where ``cell`` (value, formula; null for none) lies."""
    first = F.exists("spans", lambda s: (s["r0"] == F.col("row")) & (s["c0"] == col))
    return display(F.coalesce(cell["value"], F.lit("")), F.coalesce(cell["formula"], F.lit("")), _merged(col) & ~first, formulas)


def shown(rows: DataFrame, formulas: bool = True) -> DataFrame:
    """(doc_id, sheet_no, row, col, shown) of ``grid``: all cells, and the places that merges cover."""
    cols = F.array_distinct(F.concat(F.transform("cells", lambda c: c["col"]), F.flatten(F.transform("spans", lambda s: F.sequence(s["c0"], s["c1"])))))
    each = rows.where("row > 0").select(*SHEET, "row", "spans", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], c))).alias("held"), F.explode(cols).alias("col"))
    return each.select(*SHEET, "row", "col", _shown(F.try_element_at("held", F.col("col")), F.col("col"), formulas).alias("shown"))


def _row(values: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |\n"))


def markdown(books: DataFrame, options: SheetOptions | None = None) -> DataFrame:
    """(doc_id, markdown) of every readable workbook: one exchange by sheet and one by document."""
    o = options or SheetOptions()
    rows = grid(books)
    each = rows.select(*SHEET, "row", "cells", "spans", "gone", "sheet_name", "hidden_cols", F.explode_outer("blocks").alias("b"))
    hidden_col = lambda c: F.exists("hidden_cols", lambda h: (h["first"] <= c) & (h["last"] >= c))
    cols = F.coalesce(F.when(F.col("b.c0") <= F.col("b.c1"), F.sequence("b.c0", "b.c1")), F.array().cast("array<int>"))
    each = each.withColumn("cols", cols if o.hidden else F.filter(cols, lambda c: ~hidden_col(c)))
    each = each.withColumn("held", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], c))))
    at = lambda c: F.try_element_at("held", c)
    full = F.exists("cols", lambda c: F.coalesce(has_data(at(c)), F.lit(False)) | _merged(c))
    mark = lambda text, flag: F.when(flag, F.concat(text, F.lit(" [hidden]"))).otherwise(text) if o.mark_hidden else text
    label = mark(F.col("row").cast("string"), F.col("gone"))
    wanted = (F.col("row") > 0) & F.col("b").isNotNull()
    if o.skip_empty_rows:
        wanted &= full
    if not o.hidden:
        wanted &= ~F.col("gone")
    line = F.when(wanted, F.struct("row", _row(F.concat(F.array(label), F.transform("cols", lambda c: _shown(at(c), c, o.formulas)))).alias("line")))
    heads = F.transform("cols", lambda c: mark(C.column_letters(c), hidden_col(c)))
    header = F.concat(_row(F.concat(F.array(F.lit("Row")), heads)), _row(F.array_repeat(F.lit("---"), F.size("cols") + 1)))
    lines = each.select(*SHEET, "b", "sheet_name", (F.size("cells") > 0).alias("filled"), header.alias("header"), line.alias("line"))
    per_block = lines.groupBy(*SHEET, "b").agg(F.max("sheet_name").alias("sheet_name"), F.max("filled").alias("filled"), F.max("header").alias("header"), F.array_sort(F.collect_list("line")).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    ref = C.range_name(F.col("b.r0"), F.col("b.c0"), F.col("b.r1"), F.col("b.c1"))
    # the sheet's name is put in where all of it is known
    kind = F.when(F.col("b.kind") == "table", F.lit("### Table: ")).otherwise(F.lit("### Range: "))
    end = F.concat(F.lit("!"), ref, F.when(F.col("b.name") != "", F.concat(F.lit(" ("), F.col("b.name"), F.lit(")"))).otherwise(F.lit("")), F.lit("\n"), F.when(F.size("lines") > 0, F.concat("header", body)).otherwise(F.lit("")))
    order = [F.col(f"b.{x}").alias(x) for x in ("r0", "c0", "r1", "c1", "name", "at")]
    part = F.when(F.col("b").isNotNull(), F.struct(*order, kind.alias("kind"), end.alias("end")))
    per_sheet = per_block.select(*SHEET, "sheet_name", "filled", part.alias("p")).groupBy(*SHEET).agg(F.max("sheet_name").alias("sheet_name"), F.max("filled").alias("filled"), F.array_sort(F.collect_list("p")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["kind"], F.coalesce("sheet_name", F.lit("")), p["end"])), "\n")
    name = F.when(F.coalesce("sheet_name", F.lit("")) != "", F.concat(F.lit("## "), "sheet_name", F.lit("\n\n"))).otherwise(F.lit("")) if o.sheet_names else F.lit("")
    # a sheet without a real cell shows its name alone
    each_sheet = per_sheet.select(*SHEET, F.concat(name, F.when(F.col("filled"), text).otherwise(F.lit(""))).alias("text"))
    known = F.array_sort(F.collect_list(F.when(F.col("sheet_no") >= 0, F.struct("sheet_no", "text"))))
    docs = each_sheet.groupBy("doc_id").agg(F.array_join(F.transform(known, lambda x: x["text"]), o.separator).alias("markdown"))
    return docs.withColumn("markdown", T.compact(F.col("markdown"))) if o.compact else docs
