"""Conversions of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.api import convert_files
from docloom.options import Options
from docloom.sources import files
from docloom.storage import released

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, options: Options | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream of (doc_id, ext, length, content)."""
    o = options or Options()
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files.glob(o.extensions))
    if o.recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select(F.col("path").alias("doc_id"), files.extension(F.col("path")).alias("ext"), "length", "content")


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, options: Options | None = None, once: bool = True) -> StreamingQuery:
    """Writes Markdown, images and log of every new file as Parquet under ``output``.

    The checkpoint remembers which files were read, so nothing is converted
    twice; a batch that is repeated overwrites its own folder.
    """

    def save(batch: DataFrame, number: int) -> None:
        with released(spark):
            done = convert_files(batch, options)
            for name, table in (("markdown", done.markdown), ("images", done.images), ("log", done.log)):
                table.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    writer = arriving(spark, folder, options).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
