"""Joins on prefixes, intervals and contained text, each turned into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def longest_prefix(files: DataFrame, path: str, owners: DataFrame, root: str, keep: list[str]) -> DataFrame:
    """Each file with the owner whose root is its longest ancestor directory; '' owns all. Left join."""
    spread = files.select("*", F.explode_outer(paths.ancestors(F.col(path))).alias("_up"))
    met = spread.join(owners.select(F.col(root).alias("_root"), *keep), F.lower("_up") == F.lower("_root"), "left")
    best = F.max_by(F.struct(F.col("_root").alias("root"), *keep), F.when(F.col("_root").isNotNull(), F.struct(F.length("_up"), "_root", *keep)))
    return met.groupBy(*files.columns).agg(best.alias("_best")).select(*files.columns, "_best.*")


def enclosing(points: DataFrame, spans: DataFrame, on: list[str], at: str, begin: str, end: str, rank: Column) -> DataFrame:
    """Each point with the span of its group that holds it; of several the one of highest rank. Inner join."""
    met = points.join(spans, on).where((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end)))
    own = F.struct(*(c for c in spans.columns if c not in on))
    best = F.max_by(own, F.struct(rank, own))
    return met.groupBy(*points.columns).agg(best.alias("_best")).select(*points.columns, "_best.*")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], l_begin: str, l_end: str, r_begin: str, r_end: str) -> DataFrame:
    """Pairs of closed intervals of a group that share a point."""
    return left.join(right, on).where((F.col(l_begin) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_begin)))


def overlapping_by_bin(left: DataFrame, right: DataFrame, on: list[str], l_begin: str, l_end: str, r_begin: str, r_end: str, width: int) -> DataFrame:
    """As overlapping, for groups of any size: both sides are dealt to bins of the axis; a pair is kept in the later of its first bins only."""

    def bins(df: DataFrame, begin: str, end: str, name: str) -> DataFrame:
        low, high = F.floor(F.col(begin) / width), F.floor(F.col(end) / width)
        return df.where(F.col(end) >= F.col(begin)).withColumn(name, low).withColumn("_bin", F.explode(F.sequence(low, high)))

    met = bins(left, l_begin, l_end, "_l").join(bins(right, r_begin, r_end, "_r"), [*on, "_bin"])
    pair = (F.col(l_begin) <= F.col(r_end)) & (F.col(l_end) >= F.col(r_begin)) & (F.col("_bin") == F.greatest("_l", "_r"))
    return met.where(pair).drop("_bin", "_l", "_r")


def mentions(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Texts with each name that stands in them as a whole identifier: words are split off and joined, not compared one by one."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)))
    return texts.withColumn("_word", word).join(names, F.col("_word") == F.col(name)).drop("_word")
