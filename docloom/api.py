"""Conversions of whole collections of files.

``convert`` reads, decodes once, converts each format with DataFrame
operators and gives tables; ``write`` puts Markdown and images into files.
What is skipped because its Markdown exists is decided before decoding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import images, paragraphs, sheets
from docloom.options import Options
from docloom.plans import docx as docx_plan
from docloom.plans import pdf as pdf_plan
from docloom.plans import xlsx as xlsx_plan
from docloom.sources import docx, files, pdf, xlsx
from docloom.storage import stored


@dataclass
class Callbacks:
    """What a conversion reports on the driver, once it is done: nothing calls back from workers."""

    file_complete: Callable[[str, str | None], None] | None = None  # path, error
    file_skipped: Callable[[str, str], None] | None = None  # path, output path
    page_parsed: Callable[[str, int, int], None] | None = None  # path, page from 1, pages
    sheet_parsed: Callable[[str, str, int, int], None] | None = None  # path, sheet, rows, columns


@dataclass
class Conversion:
    """``markdown`` (doc_id, markdown), ``images`` (doc_id, image_id, …, data), ``log`` (doc_id, status, error)."""

    markdown: DataFrame
    images: DataFrame
    log: DataFrame
    options: Options = field(default_factory=Options)
    #: (doc_id, output_path, status), where it was looked up before decoding.
    targets: DataFrame | None = None
    pages: DataFrame | None = None  # doc_id, page_idx, n_pages
    sheets: DataFrame | None = None  # doc_id, sheet_no, sheet_name, rows, cols

    def summary(self) -> DataFrame:
        return self.log.groupBy("status").agg(F.count("*").alias("files"))

    def write(self, options: Options | None = None, existing: DataFrame | None = None) -> DataFrame:
        """Writes files by ``files.targets`` and returns the log with output paths.

        Images go to a folder beside each file, and its placeholders become links.
        """
        o = options or self.options
        at = self.targets
        if at is None or existing is not None or o != self.options:
            ids = self.markdown.select("doc_id")
            at = stored(files.targets(ids, files.existing(ids, o) if existing is None else existing, o), "targets")
        new = at.where("status = 'new'").join(self.markdown.select("doc_id"), "doc_id", "left_semi")
        shown = images.placed(self.images, new)
        links = shown.where(F.length("data") > 0).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("ord"), F.col("image_id").alias("id"), "alt", "link")).alias("links"))
        texts = self.markdown.join(new, "doc_id").join(links, "doc_id", "left")
        files.write_texts(texts.select("output_path", images.references(F.col("markdown"), F.col("links")).alias("markdown")))
        files.write_images(shown)
        known = at.select("doc_id", "output_path", F.col("status").alias("target"))
        return self.log.join(known, "doc_id", "left").withColumn("status", F.when(F.col("target") == "skipped", F.lit("skipped")).otherwise(F.col("status"))).drop("target")

    def notify(self, calls: Callbacks) -> None:
        """Calls back for every page, sheet and file, a partition of rows at a time."""
        if calls.page_parsed and self.pages is not None:
            for r in self.pages.orderBy("doc_id", "page_idx").toLocalIterator():
                calls.page_parsed(r.doc_id, r.page_idx + 1, r.n_pages)
        if calls.sheet_parsed and self.sheets is not None:
            for r in self.sheets.orderBy("doc_id", "sheet_no").toLocalIterator():
                calls.sheet_parsed(r.doc_id, r.sheet_name, r.rows, r.cols)
        where = {r.doc_id: r.output_path for r in self.targets.where("status = 'skipped'").toLocalIterator()} if calls.file_skipped and self.targets is not None else {}
        for r in self.log.orderBy("doc_id").toLocalIterator():
            if r.status == "skipped":
                if calls.file_skipped:
                    calls.file_skipped(r.doc_id, where.get(r.doc_id, ""))
            elif calls.file_complete:
                calls.file_complete(r.doc_id, None if r.status == "converted" else r.error or r.status)


_IMAGE = "doc_id string, image_id string, ord int, page_idx int, source_name string, alt string, format string, width int, height int, data binary, is_page_scan boolean"


def convert_files(found: DataFrame, options: Options | None = None, targets: DataFrame | None = None) -> Conversion:
    """Conversion of (doc_id, ext, length, content), but for what ``targets`` (doc_id, output_path, status) skips."""
    o = options or Options()
    spark = found.sparkSession
    none = F.lit(None).cast("string")
    log = None
    if targets is not None:
        gone = targets.where("status = 'skipped'").select("doc_id")
        log = gone.select("doc_id", F.lit("skipped").alias("status"), none.alias("error"))
        found = found.join(gone, "doc_id", "left_anti") if not gone.isEmpty() else found
    large = F.col("length") > o.most_bytes
    unknown = ~F.col("ext").isin(*files.KNOWN)
    plain = found.select("doc_id", "length", "ext").where(large | unknown)
    state = F.when(large, F.lit("failed")).otherwise(F.lit("unsupported"))
    plain = plain.select("doc_id", state.alias("status"), F.when(large, F.lit("file too large")).alias("error"))
    log = plain if log is None else log.unionByName(plain)
    of = lambda ext: found.where(~large & (F.col("ext") == ext))
    kinds = {r.ext for r in found.select("ext").distinct().collect()}
    books, texts = stored(xlsx.decode(of(".xlsx")), "xlsx"), stored(docx.decode(of(".docx")), "docx")
    prints = stored(pdf.decode(of(".pdf"), o.pdf.images or o.pdf.scan_mode), "pdf")
    made = []
    for ext, decoded, plan, own in ((".xlsx", books, xlsx_plan, o.xlsx), (".docx", texts, docx_plan, o.docx), (".pdf", prints, pdf_plan, o.pdf)):
        if ext in kinds:  # a plan without a file would cost its jobs all the same
            made.append(plan.markdown(decoded, own))
    markdown = reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], "doc_id string, markdown string")
    state = F.when(F.col("error").isNull(), F.lit("converted")).otherwise(F.lit("failed"))
    for decoded in (books, texts):
        log = log.unionByName(decoded.select("doc_id", state.alias("status"), "error"))
    log = log.unionByName(prints.select("doc_id", F.when(F.col("status") == "ok", F.lit("converted")).otherwise(F.col("status")).alias("status"), "error"))
    shown = _images(texts, prints, o) if kinds & {".pdf", ".docx"} and (o.docx.images or o.pdf.images or o.pdf.scan_mode) else spark.createDataFrame([], _IMAGE)
    pages = prints.select("doc_id", "n_pages", F.inline("pages")).select("doc_id", "page_idx", "n_pages")
    parsed = sheets.sheets(books).select(*sheets.SHEET, "sheet_name", "rows", "cols")
    return Conversion(markdown, shown, log, o, targets, pages, parsed)


def _images(texts: DataFrame, prints: DataFrame, o: Options) -> DataFrame:
    pages = images.is_scan(pdf_plan.pages_of(prints), pdf_plan.items_of(prints), pdf_plan.images_of(prints))
    pages = pages if o.pdf.scan_mode else pages.withColumn("is_scanned", F.lit(False))
    shown = pdf_plan.pictures(prints, pages, o.pdf)
    data = F.when(F.col("format") == "png", images.png("data", "width", "height", "bits", "space")).otherwise(F.col("data"))
    from_pdf = shown.select("doc_id", "image_id", "ord", "page_idx", "source_name", F.lit("").alias("alt"), "format", "width", "height", data.alias("data"), "is_page_scan")
    own = paragraphs.images(texts) if o.docx.images else paragraphs.images(texts).where("false")
    from_docx = own.select("doc_id", "image_id", "ord", F.lit(0).alias("page_idx"), "source_name", "alt", images.sniff(F.col("data")).alias("format"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), "data", F.lit(False).alias("is_page_scan"))
    return from_pdf.unionByName(from_docx)


def convert(spark: SparkSession, path: str, options: Options | None = None) -> Conversion:
    """Conversion of the files at a path: one file, a glob, or a folder with ``recursive``.

    With ``skip_existing`` files whose Markdown exists are in the log alone.
    """
    o = options or Options()
    found = files.read(spark, path, o)
    ids = found.select("doc_id")
    return convert_files(found, o, stored(files.targets(ids, files.existing(ids, o), o), "targets"))


def convert_bytes(spark: SparkSession, data: bytes, ext: str, options: Options | None = None) -> tuple[str, list[dict[str, Any]]]:
    """Markdown and images of one file's bytes; ValueError says why there are none."""
    ext = files.normalized([ext])[0]
    if ext not in files.KNOWN:
        raise ValueError(f"unsupported file type: {ext}")
    done = convert_files(spark.createDataFrame([("file", ext, len(data), data)], "doc_id string, ext string, length bigint, content binary"), options)
    text = done.markdown.first()
    if text is None:
        raise ValueError(done.log.first().error)
    return text.markdown, [r.asDict() for r in done.images.orderBy("page_idx", "ord").collect()]
