"""Counts, shares and overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import share, support


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """name and rows of each table, in one query."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()))


def by_type(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def language_shares(df: DataFrame, language: str, *more: Column) -> DataFrame:
    """Rows of each language, their percent (half to even) and how well the language is supported.

    The total comes from the few grouped rows, not from a second scan.
    """
    grouped = df.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n"), *more)
    total = F.sum("n").over(Window.partitionBy())
    return grouped.withColumn("share", share(F.col("n"), total)).withColumn("support", support(F.col("language")))
