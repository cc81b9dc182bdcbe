"""Approximate nearest neighbours: an inverted file over k-means cells, with exact distances within the cells that are read.

Vectors are scaled to unit length. Cells are fitted on a bounded sample and every vector is indexed, in the folder of its cell. A query reads the
vectors of its nearest cells and ranks them by their exact distance. recall() holds an answer against the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import top_k_each

#: Bound of the sample that cells are fitted on, in rows; more cells than the root of this make no better index.
SAMPLE = 50_000
SEED = 7


@dataclass(frozen=True)
class Index:
    """Written vectors (id, vector of unit length) by cell, and the centre of each cell."""

    path: str
    centres: np.ndarray

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cells(scaled: Column, centres: np.ndarray, n: int) -> Column:
    """The n cells whose centres are nearest, nearest first: the centres are literals, as many as there are cells."""
    near = F.array(*(F.struct((-_dot(scaled, F.array(*map(F.lit, c.tolist())))).alias("d"), F.lit(k).alias("cell")) for k, c in enumerate(centres)))
    return F.transform(F.slice(F.array_sort(near), 1, n), lambda x: x["cell"])


def build(vectors: DataFrame, path: str, cells: int = 32, sample: int = SAMPLE) -> Index:
    """Index the rows of vectors (id, embedding); rows without a vector, or with one of length 0, have no direction and are left out."""
    scaled = vectors.select("id", _unit(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
    drawn = scaled.orderBy(F.xxhash64("id")).limit(sample)
    fitted = KMeans(k=cells, seed=SEED, maxIter=15, featuresCol="features").fit(drawn.select(array_to_vector("vector").alias("features")))
    centres = np.array(fitted.clusterCenters())
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    scaled.withColumn("cell", F.get(_cells(F.col("vector"), centres, 1), F.lit(0))).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    return Index(path, centres)


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query_id, id, distance and rank of the k nearest of each query (query_id, query) in its `probes` nearest cells; all cells make it exact.

    Only the folders of the cells that are asked for are read. Each task keeps its k nearest of a query before they are ranked together.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", _unit(F.col("query")).alias("_q")).where("_q IS NOT NULL")
    probing = asked.withColumn("cell", F.explode(_cells(F.col("_q"), index.centres, probes)))
    return top_k_each(index.read(spark), probing.withColumnRenamed("_q", "query"), k, ["cell"], "vector")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hit.count() / max(1, exact.count())
