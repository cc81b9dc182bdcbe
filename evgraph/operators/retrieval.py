"""Evidence and chunk retrieval: text filters, exact vector top-k, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import band
from ..functions.vectors import cosine_distance, embed
from ..sources.files import settle
from .nearest import matrix, nearest

DIMENSION, TOP, MOST_TOP, EVIDENCE = 1536, 5, 100, 20
#: Queries of a block at most; numbers of a block's vectors, about; scopes up to which their numbers of blocks are broadcast.
BROADCAST_QUERIES = 8_192
VALUES = 4_000_000
SCOPES = 10_000


def check_query(vector: list[float], k: int, dimension: int = DIMENSION) -> None:
    if len(vector) != dimension:
        raise ValueError(f"a query has {dimension} values, not {len(vector)}")
    if not 1 <= k <= MOST_TOP:
        raise ValueError(f"k is from 1 to {MOST_TOP}")


def top_k(vectors: DataFrame, query: list[float], k: int = TOP, vector: str = "embedding", order: str = "id", dimension: int = DIMENSION) -> DataFrame:
    """The k rows nearest to one vector, ties by order: a top-k in each task, then of those."""
    check_query(query, k, dimension)
    q = F.array(*(F.lit(float(x)) for x in query))
    found = vectors.where(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(F.col(vector), q))
    return found.orderBy("distance", order).limit(k).withColumn("similarity", 1 - F.col("distance"))


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, scope: list[str] | None = None, vector: str = "embedding", order: str = "id") -> DataFrame:
    """query_id, order, distance and rank of the k rows nearest to each query, within its scope.

    Vectors are dealt to blocks of some VALUES numbers, queries to blocks of BROADCAST_QUERIES or fewer, and each block of a scope's vectors
    meets each of its queries in a task, by matrix products; the k nearest of a block are ranked together then. Nothing is broadcast or sent to the driver.
    """
    own = F.array(*(F.col(c).cast("string") for c in scope or [])).cast("array<string>")
    whole = ~F.exists("_scope", lambda c: c.isNull())
    right = vectors.where(F.col(vector).isNotNull()).select(own.alias("_scope"), F.col(order).alias("_id"), F.col(vector).cast("array<double>" if dict(vectors.dtypes)[vector] == "array<double>" else "array<float>").alias("_v")).where(whole)
    left = queries.select(own.alias("_scope"), F.col("query_id").alias("_id"), F.col("query").cast("array<double>").alias("_v")).where(whole)
    blocks = lambda df, n, most: df.groupBy("_scope").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.greatest(F.size("_v"), F.lit(1))) / VALUES), F.ceil(F.count("*") / most)).cast("int").alias(n))
    sizes = settle(blocks(right, "_rights", VALUES).join(blocks(left, "_lefts", BROADCAST_QUERIES), "_scope"), "vector-blocks")
    sizes = F.broadcast(sizes) if sizes.limit(SCOPES + 1).count() <= SCOPES else sizes
    mine = lambda n: F.pmod(F.xxhash64("_id", "_v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = left.join(sizes, "_scope").select("_scope", mine("_lefts").alias("_l"), every("_rights").alias("_r"), "_id", "_v")
    held = right.join(sizes, "_scope").select("_scope", every("_lefts").alias("_l"), mine("_rights").alias("_r"), "_id", "_v")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        q, x, distance = nearest(matrix(asked["_v"]), matrix(held["_v"]), held["_id"], k)
        return pa.table({"query_id": asked["_id"].take(q), "_id": held["_id"].take(x), "distance": pa.array(distance)})

    by = ("_scope", "_l", "_r")
    near = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, f"query_id {dict(left.dtypes)['_id']}, _id {dict(right.dtypes)['_id']}, distance double").withColumnRenamed("_id", order)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", order))).where(F.col("rank") <= k)


def evidence(rows: DataFrame, path: str | None, symbol: str | None, text: str | None, least: float) -> DataFrame:
    """The first EVIDENCE matching rows in (file_path, start_line, id) order, then those of enough confidence: the cut comes first."""
    kept = F.lit(True)
    for column, value in (("file_path", path), ("symbol", symbol), ("description", text)):
        if value:
            kept = kept & F.coalesce(F.col(column).contains(value), F.lit(False))
    return rows.where(kept).orderBy("file_path", "start_line", "id").limit(EVIDENCE).where(F.coalesce("confidence", F.lit(1.0)) >= least)


def evidence_band(found: DataFrame) -> DataFrame:
    mean = F.avg(F.coalesce("confidence", F.lit(1.0)))
    return found.agg(F.count("*").alias("n"), mean.alias("_mean")).select("n", F.bround("_mean", 6).alias("mean_confidence"), band(F.col("_mean")).alias("band"))


def chunks(rows: DataFrame, path: str | None, symbol: str | None, word: str | None, least: float) -> DataFrame:
    kept = F.coalesce("confidence", F.lit(1.0)) >= least
    for column, value in (("file_path", path), ("symbol", symbol), ("content", word)):
        if value:
            kept = kept & F.coalesce(F.col(column).contains(value), F.lit(False))
    return rows.where(kept).orderBy("chunk_index")


def results(found: DataFrame) -> DataFrame:
    """Search rows: path from file or evidence, lines from evidence or 1, similarity, confidence 1 where none is stored."""
    return found.select(
        F.col("id").alias("chunk_id"),
        "analysis_id",
        "source_file_id",
        F.coalesce("source_path", "evidence_path", F.lit("")).alias("file_path"),
        "symbol",
        F.coalesce("start_line", F.lit(1)).alias("start_line"),
        F.coalesce("end_line", F.lit(1)).alias("end_line"),
        "content",
        "token_count",
        "chunk_index",
        "evidence_id",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        "distance",
        (1 - F.col("distance")).alias("similarity"),
    )


def with_provenance(found: DataFrame, files: DataFrame, evidences: DataFrame) -> DataFrame:
    """Chunks (id, source_file_id, evidence_id and more) with source_path of their file and evidence_path, start_line, end_line and confidence of their evidence; null where there is none."""
    own = files.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path"))
    proof = evidences.select(F.col("id").alias("evidence_id"), F.col("file_path").alias("evidence_path"), "start_line", "end_line", "confidence")
    return found.drop("start_line", "end_line", "confidence").join(own, "source_file_id", "left").join(proof, "evidence_id", "left")


def embed_builtin(rows: DataFrame, text: str, dimension: int = DIMENSION) -> DataFrame:
    return rows.withColumn("embedding", embed(F.col(text), dimension))


def populate(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], dimension: int, size: int = 32) -> DataFrame:
    """rows (id, content) with embedding and embed_error, by a provider that takes lists of texts.

    Blank contents are skipped. A batch of `size` texts fails as a whole on an exception, a
    wrong number of vectors or a wrong length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("content").to_pylist()
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            able = [k for k, x in enumerate(texts) if x and x.strip()]
            for begin in range(0, len(able), size):
                part = able[begin : begin + size]
                try:
                    got = provider([texts[k] for k in part])
                    if len(got) != len(part) or any(len(v) != dimension for v in got):
                        raise ValueError("wrong number or length of vectors")
                    for k, v in zip(part, got, strict=True):
                        vectors[k] = v
                except Exception as e:  # the contract: a failure is a value
                    for k in part:
                        errors[k] = str(e) or type(e).__name__
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("content"), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["id", "content", "embedding", "embed_error"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "content").mapInArrow(run, f"id {kind}, content string, embedding array<float>, embed_error string")


def outcome(populated: DataFrame) -> DataFrame:
    """eligible, embedded and the status of a population."""
    able = F.coalesce(F.trim("content"), F.lit("")) != ""
    counted = populated.agg(F.count_if(able).alias("eligible"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))
    return counted.withColumn("status", outcome_status(F.col("eligible"), F.col("embedded")))


def outcome_status(eligible: Column, embedded: Column) -> Column:
    return F.when(eligible == 0, "NoEligibleChunks").when(embedded == eligible, "AllSucceeded").when(embedded == 0, "CompleteFailure").otherwise("PartialFailure")
