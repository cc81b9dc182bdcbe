"""What diagrams of layers share: sides of a join, edges, the first node that is alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def side(nodes: DataFrame, mark: str, *columns: str) -> DataFrame:
    """The columns of a layer's nodes under names for one side of a join."""
    return nodes.select("analysis_id", *(F.col(c).alias(f"{mark}_{c}") for c in columns or ("id", "name", "file_path", "rank")))


def stem(name: str, *endings: str) -> Column:
    """A name in lower case without words in it."""
    return F.lower(reduce(lambda c, e: F.replace(c, F.lit(e), F.lit("")), endings, F.col(name)))


def edge(df: DataFrame, source: str | Column, target: str | Column, label: str | Column, confirmed: bool) -> DataFrame:
    source, target = (F.col(x) if isinstance(x, str) else x for x in (source, target))
    said = F.lit(label) if isinstance(label, str) else label
    return df.select("analysis_id", source.alias("source_id"), target.alias("target_id"), said.alias("label"), F.lit("confirmed" if confirmed else "inferred").alias("state"))


def first_like(left: DataFrame, right: DataFrame, alike: Column) -> DataFrame:
    """Each left node with the first right node of its analysis that is alike; null if none is. Both sides are at most a layer's cap an analysis."""
    met = left.join(right, "analysis_id").where(alike)
    best = met.groupBy("analysis_id", "l_id").agg(F.min_by("r_id", "r_rank").alias("like_id"))
    return left.join(best, ["analysis_id", "l_id"], "left")


def first(nodes: DataFrame, name: str) -> DataFrame:
    """The first node of each analysis."""
    return nodes.groupBy("analysis_id").agg(F.min_by("id", "rank").alias(name))


def pick(key: Column, n: Column) -> Column:
    """A number from 1 to n that a key is dealt by hash."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n + 1
