"""First and last per key, caps, running limits and overflow buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources.files import settle


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in a form that can be ordered: maps as their sorted entries."""
    return F.struct(*((F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema))


def first_per_key(df: DataFrame, key: Column, order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order, by an aggregate that is summed within tasks: no group is sorted.

    Rows that tie in the order go by all of their columns, so a rerun gives the same rows.
    """
    rank = F.struct(F.struct(*order), whole_row(df))
    pick = (F.max_by if last else F.min_by)(F.struct(*(F.col(f"`{c}`") for c in df.columns)), rank)
    return df.groupBy(key.alias("_key")).agg(pick.alias("_row")).select("_row.*")


def first_per_key_ci(df: DataFrame, parts: list[Column], order: list) -> DataFrame:
    """One row for each combination of parts, ignoring case; the first wins."""
    return first_per_key(df, F.lower(F.concat_ws("->", *parts)), order)


def top_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def overflow(df: DataFrame, group: list[str], label: str, order: list, n: int) -> DataFrame:
    """group, label and size: the first n labels of each group, then one row '+k more'."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    shown = ranked.where(F.col("_rank") <= n).select(*group, F.col(label).alias("label"), F.lit(1).cast("long").alias("size"))
    counted = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > n)
    rest = counted.select(*group, F.concat(F.lit("+"), (F.col("_n") - n).cast("string"), F.lit(" more")).alias("label"), (F.col("_n") - n).alias("size"))
    return shown.unionByName(rest)


def cap(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of all; a top-k within tasks."""
    return df.orderBy(*order).limit(most)


def within_running_total(df: DataFrame, group: list[str], order: list, size: Column, largest: int, total: int) -> DataFrame:
    """Rows no larger than largest, while the running total of those before and the row itself stays within total.

    A row that is too large adds nothing; the first that would pass the total ends its group.
    """
    kept = df.where(size <= largest)
    running = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return kept.withColumn("running", running).where(F.col("running") <= total)


def running_totals(df: DataFrame, order: list[Column | str], totals: dict[str, Column], group: tuple[str, ...] = ()) -> DataFrame:
    """df with each total of a row and all rows before it in one order (within its group, if columns are named), without one task for an order or a group.

    The rows are dealt to ranges of (group, order) and written, so that each stays in its range. A range's totals are summed by group, the sums of
    the ranges before it are put in front, and totals run within a range only. What one task orders besides is a row for each range that a
    group reaches into. The order should be total: rows that tie in it stand in one range, in any order. Hand over narrow rows.
    """
    keys = ["_range", *group]
    placed = settle(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum {n}") for n, v in totals.items()))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"_key {k}") for k in keys), *(F.coalesce(F.sum(f"_sum {n}").over(earlier), F.lit(0)).alias(f"_before {n}") for n in totals))
    on = reduce(lambda a, b: a & b, (placed[k].eqNullSafe(F.col(f"_key {k}")) for k in keys))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = placed.join(before if group else F.broadcast(before), on)  # without groups: a row a range, as many as shuffle partitions
    return met.select(*(placed[c] for c in df.columns), *((F.col(f"_before {n}") + F.sum(v).over(within)).alias(n) for n, v in totals.items()))


def without_match(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def sections(lines: DataFrame, group: list[str], at: str, starts: Column) -> DataFrame:
    """Adds section: how many rows up to this one start a section; 0 before the first."""
    order = Window.partitionBy(*group).orderBy(at)
    return lines.withColumn("section", F.sum(starts.cast("int")).over(order))
