"""Packages and project references of manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines

#: Sections of package.json, in order.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def npm(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analysis_id, path, section, name, version, line, seq; errors) of package.json files.

    The line is the first that holds the quoted name, ignoring case, else 1.
    """
    chosen = files.where(F.lower(paths.file_name(F.col("path"))) == "package.json")
    parsed = chosen.withColumn("_whole", F.try_parse_json("content"))
    good = parsed.where(F.col("_whole").isNotNull())
    kept = []
    def entry(n: int, section: str):
        return lambda e: F.struct(F.lit(n).alias("rank"), F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("version"))

    for n, section in enumerate(SECTIONS):
        entries = F.map_entries(F.from_json(F.get_json_object("content", f"$.{section}"), "map<string,string>"))
        kept.append(F.transform(F.coalesce(entries, F.array().cast("array<struct<key: string, value: string>>")), entry(n, section)))
    low = lines(F.lower("content"))
    spread = good.select("analysis_id", "path", low.alias("_lines"), F.posexplode(F.concat(*kept)).alias("seq", "e"))
    quoted = F.concat(F.lit('"'), F.lower("e.name"), F.lit('"'))
    first = F.get(F.filter(F.transform("_lines", lambda x, i: F.when(x.contains(quoted), i + 1)), lambda i: i.isNotNull()), F.lit(0))
    rows = spread.select("analysis_id", "path", "e.section", "e.name", "e.version", F.coalesce(first, F.lit(1)).cast("int").alias("line"), "seq")
    return rows, parsed.where(F.col("_whole").isNull()).select("analysis_id", "path", F.lit("The manifest isn't JSON.").alias("message"))


def csproj(files: DataFrame) -> DataFrame:
    """analysis_id, path, kind (project or package), name, version, target, line of .csproj files; files that aren't XML have none."""
    schema = pa.schema([("analysis_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("version", pa.string()), ("target", pa.string()), ("line", pa.int32())])

    def references(text: str) -> list[tuple]:
        found: list[tuple] = []
        parser = expat.ParserCreate()

        def start(tag: str, attributes: dict) -> None:
            tag, to = tag.rpartition(":")[2], attributes.get("Include", "").strip()
            if tag == "ProjectReference" and to:
                target = to.replace("\\", "/")
                found.append(("project", re.sub(r"\.[^.]*$", "", target.rsplit("/", 1)[-1]), None, target, parser.CurrentLineNumber))
            elif tag == "PackageReference" and to:
                found.append(("package", to, attributes.get("Version"), None, parser.CurrentLineNumber))

        parser.StartElementHandler = start
        try:
            parser.Parse(text.lstrip("﻿"), True)
        except expat.ExpatError:
            return []
        return found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(a, p, *r) for a, p, t in zip(*(b.column(c).to_pylist() for c in ("analysis_id", "path", "content")), strict=True) for r in references(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)

    chosen = files.where(F.lower("path").endswith(".csproj")).select("analysis_id", "path", "content")
    return chosen.mapInArrow(read, "analysis_id string, path string, kind string, name string, version string, target string, line int")
