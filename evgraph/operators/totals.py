"""Totals on several levels, and joins as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cube(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Totals of every combination of keys; level has a bit for each key that is added up over, the first key's the highest."""
    return df.cube(*keys).agg(F.grouping_id(*keys).cast("int").alias("level"), *(v.alias(n) for n, v in totals.items()))


def rollup(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Totals of every prefix of keys."""
    return df.rollup(*keys).agg(F.grouping_id(*keys).cast("int").alias("level"), *(v.alias(n) for n, v in totals.items()))


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], **totals: Column) -> DataFrame:
    """Totals of the named combinations of keys."""
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id(*keys).cast("int").alias("level"), *(v.alias(n) for n, v in totals.items()))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, take: list[str], width: int = 90 * 86_400) -> DataFrame:
    """left with the columns `take` of the last right row of its key whose `since` is not after its `at`; null if there is none.

    key names a column of both sides, at and since are timestamps. Both sides are put together and dealt to (key, span of `width` seconds), so a key of any size is
    spread over its spans; a span without a right row before takes the last one of the key's earlier spans, of which there is one row each. Of right rows at one time the
    greatest by `take` counts.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c)) / (width * 1_000_000)).cast("long")
    row = F.struct(F.col(since).alias("since"), *(F.col(c).alias(c) for c in take))
    known = right.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_key"), span(since).alias("_span"), F.col(since).alias("_at"), row.alias("_row"))
    known = known.groupBy("_key", "_span", "_at").agg(F.max("_row").alias("_row"))
    asked = left.withColumns({"_key": F.col(key), "_span": span(at), "_at": F.col(at), "_own": F.struct(*left.columns)}).select("_key", "_span", "_at", "_own")
    both = asked.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)).unionByName(known.withColumn("_own", F.lit(None).cast(asked.schema["_own"].dataType)))
    within = Window.partitionBy("_key", "_span").orderBy("_at", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_last", F.last("_row", ignorenulls=True).over(within)).where("_own IS NOT NULL")
    spans = known.groupBy("_key", "_span").agg(F.max("_row").alias("_row")).unionByName(asked.select("_key", "_span").distinct().withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)))
    ends = spans.groupBy("_key", "_span").agg(F.max("_row").alias("_row"))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_key").alias("_k"), F.col("_span").alias("_s"), F.last("_row", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    met = inside.join(carried, (F.col("_key") == F.col("_k")) & (F.col("_span") == F.col("_s")), "left").withColumn("_best", F.coalesce("_last", "_carried"))
    return met.select("_own.*", *(F.col(f"_best.{c}").alias(c) for c in take))
