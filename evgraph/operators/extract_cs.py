"""Facts of C# files: one pass of the parser over each file, all kinds of facts in one tagged stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "analysis_id string, path string, seq int, fact string, line int, end_line int, kind string, name string, container string, namespace string, target string, detail string"


def facts(files: DataFrame) -> DataFrame:
    """files: analysis_id, path, content. A file that can't be read gives one row with fact 'error' and no others."""
    from .cs_parser import parse

    schema = pa.schema(
        [("analysis_id", pa.string()), ("path", pa.string()), ("seq", pa.int32()), ("fact", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), *((n, pa.string()) for n in ("kind", "name", "container", "namespace", "target", "detail"))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for analysis, path, text in zip(*(b.column(c).to_pylist() for c in ("analysis_id", "path", "content")), strict=True):
                try:
                    rows += [(analysis, path, n, *astuple(f)) for n, f in enumerate(parse(text or ""))]
                except Exception as e:  # the contract: a file's failure is a row
                    rows.append((analysis, path, 0, "error", 1, 1, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)

    chosen = files.where(F.lower("path").endswith(".cs")).select("analysis_id", "path", "content")
    # Parsing is the work, whatever the bytes: a table of few bytes may hold, or make, very many files.
    return chosen.repartition(2 * files.sparkSession.sparkContext.defaultParallelism).mapInArrow(read, SCHEMA)
