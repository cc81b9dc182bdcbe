"""Chunks of files: sections, whole files, symbols, and greedy packing of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.ids import evidence_key
from ..sources.files import settle
from .ordered import running_totals

CHUNK_CHARS = 2000
PIECE = "struct<content: string, start_line: int, end_line: int>"


def numbered_lines(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    return files.select(*keys, F.posexplode(t.lines(F.col(text))).alias("_at", "line")).withColumn("line_no", F.col("_at") + 1).drop("_at")


def markdown_sections(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, section, heading (null before the first), start_line, end_line, content of each section.

    A section begins at the first line and at each heading; its lines are a slice of the file's.
    """
    split = files.select(*keys, F.explode(F.array(t.lines(F.col(text)))).alias("lines"))
    every = F.sequence(F.lit(1), F.size("lines"))
    starts = F.filter(every, lambda no: (no == 1) | t.is_heading(F.get("lines", no - 1)))
    placed = split.select(*keys, "lines", F.explode(F.array(starts)).alias("starts"))
    spread = placed.select(*keys, "lines", "starts", F.posexplode("starts").alias("section", "start_line"))
    end = F.coalesce(F.get("starts", F.col("section") + 1) - 1, F.size("lines"))
    first = F.get("lines", F.col("start_line") - 1)
    body = F.array_join(F.slice("lines", F.col("start_line"), end - F.col("start_line") + 1), "\n")
    return spread.select(*keys, "section", F.when(t.is_heading(first), F.trim(first)).alias("heading"), "start_line", end.alias("end_line"), body.alias("content"))


def pack_lines(text: Column, first_line: Column, most: int = CHUNK_CHARS) -> Column:
    """Array of (content, start_line, end_line): lines joined while they fit; a longer line is cut into pieces of its own."""
    state = F.struct(F.array().cast(f"array<{PIECE}>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("start"), F.lit(0).alias("at"))

    def piece(content: Column, start: Column, end: Column) -> Column:
        return F.struct(content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    def flush(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(piece(s["open"], s["start"], s["at"]))))

    def step(s: Column, line: Column) -> Column:
        no = F.when(s["at"] == 0, first_line).otherwise(s["at"] + 1).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / most).cast("int")), lambda k: piece(F.substring(line, k * most + 1, F.lit(most)), no, no))
        nothing = F.lit(None).cast("string")
        fits = s["open"].isNotNull() & (F.length(s["open"]) + 1 + F.length(line) <= most)

        def to(done: Column, opened: Column, start: Column) -> Column:
            return F.struct(done.alias("done"), opened.alias("open"), start.cast("int").alias("start"), no.alias("at"))

        return (
            F.when(F.length(line) > most, to(F.concat(flush(s), cuts), nothing, no))
            .when(fits, to(s["done"], F.concat(s["open"], F.lit("\n"), line), s["start"]))
            .otherwise(to(flush(s), line, no))
        )

    return F.aggregate(t.lines(text), state, step, flush)


def packed(files: DataFrame, keys: list[str], text: str, first_line: Column | None = None, most: int = CHUNK_CHARS) -> DataFrame:
    start = F.lit(1) if first_line is None else first_line
    return files.select(*keys, F.posexplode(pack_lines(F.col(text), start, most)).alias("piece", "p")).select(*keys, "piece", "p.*")


def whole_files(files: DataFrame, keys: list[str], text: str, confidence: float = 1.0) -> DataFrame:
    """One masked chunk a file, with its lines and token estimate."""
    masked = t.mask_secrets(F.col(text))
    return files.select(
        *keys, masked.alias("content"), F.lit(1).alias("start_line"), F.size(t.lines(F.col(text))).alias("end_line"), t.token_estimate(masked).alias("token_count"), F.lit(confidence).alias("confidence")
    )


def generate(files: DataFrame, symbols: DataFrame, evidences: DataFrame) -> DataFrame:
    """All chunks of an analysis, in order.

    files: analysis_id, path, content. symbols: analysis_id, path, name, kind, start_line, end_line.
    evidences: analysis_id, id, file_path, start_line, end_line, confidence. Documentation without symbols is cut into
    sections, files with symbols give a chunk a symbol, others one whole chunk; each is packed to CHUNK_CHARS, masked, and
    carries the ids and mean confidence of the evidence that overlaps it.
    """
    keys = ["analysis_id", "path"]
    low = files.withColumn("_path", F.lower("path"))
    named = symbols.withColumn("_path", F.lower("path")).drop("path")
    has = named.select("analysis_id", "_path").distinct()
    bare = low.join(has, ["analysis_id", "_path"], "left_anti")
    docs, others = bare.where(t.is_documentation(F.col("path"))), bare.where(~t.is_documentation(F.col("path")))
    sections = markdown_sections(docs, keys, "content").select(*keys, F.col("heading").alias("symbol"), "start_line", "end_line", "content", F.lit(1.0).alias("base"))
    missing = F.concat(F.lit("// source of "), F.col("name"), F.lit(" is not available"))
    body = F.array_join(F.slice(t.lines(F.col("content")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    by_symbol = named.join(low.select(*keys, "_path", "content"), ["analysis_id", "_path"], "left").select(
        "analysis_id", F.coalesce("path", "_path").alias("path"), F.col("name").alias("symbol"), "start_line", "end_line", F.coalesce(body, missing).alias("content"), F.lit(0.85).alias("base")
    )
    whole = others.select(*keys, F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("start_line"), F.size(t.lines(F.col("content"))).alias("end_line"), "content", F.lit(1.0).alias("base"))
    spans = sections.unionByName(by_symbol).unionByName(whole)
    spans = spans.withColumnsRenamed({"start_line": "span_start", "end_line": "span_end"})
    cut = packed(spans, [*keys, "symbol", "base", "span_start", "span_end"], "content", F.col("span_start"))
    cut = cut.where(F.trim("content") != "").withColumn("content", t.mask_secrets(F.col("content")))
    over = evidences.select("analysis_id", F.lower("file_path").alias("_path"), F.col("id").alias("evidence_id"), F.col("start_line").alias("e_start"), F.col("end_line").alias("e_end"), F.col("confidence").alias("e_confidence"))
    chunk = cut.withColumn("_path", F.lower("path")).withColumn("chunk", F.struct("path", "span_start", "span_end", "symbol", "piece", "start_line"))
    met = chunk.join(over, (chunk["analysis_id"] == over["analysis_id"]) & (chunk["_path"] == over["_path"]) & (F.col("start_line") <= F.col("e_end")) & (F.col("end_line") >= F.col("e_start")), "left")
    grouped = met.groupBy(chunk["analysis_id"], "chunk", "path", "symbol", "base", "content", "start_line", "end_line").agg(
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.avg("e_confidence").alias("mean")
    )
    grouped = settle(grouped, "chunks")  # packed and masked once, for the count and for the rows
    # Chunks are numbered within their file, files by how many chunks the files before them have.
    counted = running_totals(grouped.groupBy(*keys).agg(F.count("*").alias("n")), [F.upper("path"), F.col("path")], {"_to": F.col("n")}, ("analysis_id",))
    before = counted.select(F.col("analysis_id").alias("_a"), F.col("path").alias("_p"), (F.col("_to") - F.col("n")).alias("_before"))
    placed = grouped.join(before, (grouped["analysis_id"] == before["_a"]) & (grouped["path"] == before["_p"]))
    order = Window.partitionBy("analysis_id", "path").orderBy("chunk")
    return placed.select(
        "analysis_id",
        (F.col("_before") + F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        F.col("path").alias("file_path"),
        "symbol",
        "content",
        "start_line",
        "end_line",
        t.token_estimate(F.col("content")).alias("token_count"),
        "evidence_ids",
        evidence_key(F.col("path"), F.col("start_line"), F.col("end_line")).alias("evidence_key"),
        F.coalesce("mean", "base").alias("confidence"),
    )
