"""Files as rows: listing, extensions, targets and what exists already."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.options import Options


KNOWN = (".pdf", ".docx", ".xlsx")


def normalized(extensions: Sequence[str]) -> list[str]:
    """Lower case, with a dot."""
    return [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def glob(extensions: Sequence[str]) -> str:
    """A path filter that ignores case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in normalized(extensions)) + "}"


def walk(root: str) -> Iterator[tuple[str, str]]:
    """(path, real path) of all files under a local folder, by name; follows links, each folder once."""
    seen: set[str] = set()

    def down(folder: str) -> Iterator[tuple[str, str]]:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            if os.path.isdir(path):
                yield from down(path)
            elif os.path.isfile(path):
                yield path, os.path.realpath(path)

    yield from down(root)


def _has_links(root: str) -> bool:
    return any(os.path.islink(os.path.join(folder, name)) for folder, folders, names in os.walk(root) for name in (*folders, *names))


def read(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    """(doc_id, ext, length, modified, content) of the files at a path or glob with wanted extensions."""
    o = options or Options()
    at = local(path)
    if "://" not in at and not any(c in at for c in "*?[{"):
        if not os.path.exists(at):
            raise FileNotFoundError(path)
        if os.path.isdir(at) and not o.recursive:
            raise IsADirectoryError(f"{path} is a folder: set recursive")
        if os.path.isfile(at) and os.path.splitext(at)[1].lower() not in KNOWN:
            raise ValueError(f"unsupported file type: {os.path.splitext(at)[1] or at} (supported: {', '.join(KNOWN)})")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(o.recursive).lower())
    if o.recursive:
        reader = reader.option("pathGlobFilter", glob(o.extensions))
    if o.recursive and os.path.isdir(at) and _has_links(at):
        # links may lead in circles, and to files met before: each real file is read once
        paths: dict[str, str] = {}
        for p, real in walk(at):
            if os.path.splitext(p)[1].lower() in normalized(o.extensions):
                paths.setdefault(real, p)
        reader = spark.read.format("binaryFile")
        path = list(paths.values())
        if not paths:
            reader, path = spark.read.format("binaryFile").option("pathGlobFilter", "*.no-such-extension"), at
    found = reader.load(path).select(F.col("path").alias("doc_id"), extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("modified"), "content")
    return found.where(F.col("ext").isin(*normalized(o.extensions)))


def local(path: str) -> str:
    """A path, or ``file:`` address, as the file system that all executors mount knows it."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _bases(ids: DataFrame, o: Options) -> DataFrame:
    """``ids`` (doc_id) with __base: the output path without number and '.md'."""
    name = F.regexp_extract("doc_id", r"([^/\\]+)$", 1)
    return ids.withColumn("__base", F.concat(F.lit(o.output_directory.rstrip("/") + "/"), name) if o.output_directory else F.col("doc_id"))


def existing(ids: DataFrame, options: Options | None = None) -> DataFrame:
    """(path) of the files that are where ``ids`` (doc_id) would be written.

    Executors look at the names that could be chosen, as many as it takes to
    find a free one for each file that meets at a name; no folder is listed.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for base, n in zip(batch["__base"], batch["n"]):
                free = i = 0
                while free < n:
                    path = f"{base}.md" if i == 0 else f"{base}-{i}.md"
                    if os.path.exists(local(path)):
                        found.append(path)
                    else:
                        free += 1
                    i += 1
            yield pd.DataFrame({"path": found}, dtype=object)

    return _bases(ids, options or Options()).groupBy("__base").agg(F.count("*").alias("n")).mapInPandas(look, "path string")


def targets(files: DataFrame, existing: DataFrame, options: Options | None = None) -> DataFrame:
    """``files`` (doc_id) with output_path and status 'new' or 'skipped'.

    The output lies beside the input, or flat in the output folder; files that
    meet at one name get '-1', '-2' and so on, the first by path the plain one.
    ``existing`` (path) holds what is there: a file whose own name is taken is
    skipped, so a second run skips what the first one wrote; without
    ``skip_existing`` it gets the next free number instead.
    """
    o = options or Options()
    rows = _bases(files, o)
    # 'a.pdf.md' is the plain name of a.pdf, 'a.pdf-1.md' the next
    parts = [F.regexp_extract("path", r"^(.*?)(?:-([0-9]+))?\.md$", k).alias(name) for k, name in ((1, "__base"), (2, "__n"))]
    taken = existing.select(*parts).select("__base", F.when(F.col("__n") == "", F.lit(0)).otherwise(F.expr("try_cast(__n AS int)")).alias("__at")).dropna().distinct()
    rank = F.row_number().over(Window.partitionBy("__base").orderBy("doc_id")) - 1
    rows = rows.withColumn("__at", rank)
    # names that very many files meet at are common: a number costs a row of a join or window, not a list of all that is taken
    if o.skip_existing:
        rows = rows.join(taken.withColumn("__taken", F.lit(True)), ["__base", "__at"], "left")
        number, status = F.col("__at"), F.when(F.col("__taken"), F.lit("skipped")).otherwise(F.lit("new"))
    else:
        # the i-th taken number n, from 0, has n - i free ones below: it is passed by the files of that rank and after
        below = F.col("__at") - (F.row_number().over(Window.partitionBy("__base").orderBy("__at")) - 1)
        both = rows.withColumn("__taken", F.lit(False)).unionByName(taken.select("__base", below.alias("__at"), F.lit(True).alias("__taken")), allowMissingColumns=True)
        passed = F.count_if("__taken").over(Window.partitionBy("__base").orderBy("__at", F.desc("__taken")).rowsBetween(Window.unboundedPreceding, 0))
        rows = both.withColumn("__passed", passed).where("not __taken")
        number, status = F.col("__at") + F.col("__passed"), F.lit("new")
    path = F.concat("__base", F.when(number == 0, F.lit("")).otherwise(F.concat(F.lit("-"), number.cast("string"))), F.lit(".md"))
    return rows.withColumn("output_path", path).withColumn("status", status).drop("__base", "__at", "__taken", "__passed")


def _save(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def write_texts(converted: DataFrame) -> None:
    """Writes (output_path, markdown) as files, each executor its own rows.

    For file systems that all executors mount; a retried task writes the same
    bytes to the same place.
    """

    def save(rows: Iterator) -> None:
        for row in rows:
            _save(local(row.output_path), row.markdown.encode())

    converted.select("output_path", "markdown").foreachPartition(save)


def write_images(found: DataFrame) -> None:
    """Writes (image_path, data) as files, in the same way; images without data are left out."""

    def save(rows: Iterator) -> None:
        for row in rows:
            _save(local(row.image_path), bytes(row.data))

    found.where(F.length("data") > 0).select("image_path", "data").foreachPartition(save)
