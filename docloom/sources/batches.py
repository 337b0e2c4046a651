"""Decoders as maps over Arrow batches whose output is cut by its size, not by the number of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A batch ends with the file that fills it: so many array elements, or bytes of files.
ELEMENTS, BYTES = 20_000, 2 << 20


def cut(rows: Iterator[tuple[int, int, dict[str, Any]]]) -> Iterator[list[dict[str, Any]]]:
    """Rows of (elements, bytes, row) in lists of bounded size."""
    held: list[dict[str, Any]] = []
    elements = size = 0
    for n, b, row in rows:
        held.append(row)
        elements, size = elements + n + 1, size + b
        if elements >= ELEMENTS or size >= BYTES:
            yield held
            held, elements, size = [], 0, 0
    if held:
        yield held


def decode(files: DataFrame, parse: Callable[[bytes], dict[str, Any]], failed: Callable[[Exception], dict[str, Any]], schema: str) -> DataFrame:
    """A row of ``schema`` for each of ``files`` (doc_id, content): what ``parse`` finds, or what ``failed`` says of its error."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict[str, Any]]]:
        for batch in batches:
            for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                data = content.as_py() or b""
                try:
                    found = {"error": None} | parse(data)
                except Exception as e:  # a broken file is a row, whatever is wrong with it
                    found = failed(e)
                size = len(data) + sum(len(i["data"] or b"") for i in found.get("images") or ())
                yield sum(len(v) for v in found.values() if isinstance(v, list)), size, {"doc_id": doc_id.as_py()} | found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cut(each(batches)):
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("doc_id", "content").mapInArrow(run, schema)
