"""Cascades of references: by the first key that is known, of several kinds of keys in order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .mentions import containing
from .ordered import first_per_key


@dataclass(frozen=True)
class Stage:
    """Keys that rows ask for (an array, the best first) and the table that knows them by its column `on`; of rows with one key the first by `order`."""

    asked: Column
    known: DataFrame
    on: str
    order: tuple[str, ...]


def ranked_cascade(rows: DataFrame, key: list[str], stages: list[Stage], take: list[str]) -> DataFrame:
    """rows with the columns `take` of the first stage, and in it the first key, that is known; null if none is.

    Every stage is an equi-join with one row a key; what is found is ranked by stage and by key, and the best is taken in one aggregate. key: the
    columns that tell rows apart; rows that share them get the same.
    """
    found = []
    for rank, stage in enumerate(stages):
        known = first_per_key(stage.known.where(F.col(stage.on).isNotNull()).select(F.col(stage.on).alias("_on"), *take, *(F.col(c).alias(f"_order {k}") for k, c in enumerate(stage.order))), F.col("_on"), [f"`_order {k}`" for k in range(len(stage.order))])
        asked = rows.select(*key, F.posexplode(stage.asked).alias("_choice", "_asked")).where("_asked IS NOT NULL").distinct()
        found.append(asked.join(known, F.col("_asked") == F.col("_on")).select(*key, F.lit(rank).alias("_rank"), "_choice", *take))
    every = reduce(DataFrame.unionByName, found)
    best = first_per_key(every, F.struct(*key), ["_rank", "_choice"]).select(*(F.col(k).alias(f"_key {k}") for k in key), *take)
    on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(best[f"_key {k}"]) for k in key))
    return rows.join(best, on, "left").select(*(rows[c] for c in rows.columns), *(best[c] for c in take))


def project_of_files(files: DataFrame, projects: DataFrame, take: str = "project_id") -> DataFrame:
    """files with their project: that of the id they name (project_ref), else whose manifest they are, else whose folder is their longest ancestor, else the analysis's first.

    files: analysis_id, path, project_ref. projects: analysis_id, project_id, path, seq. Paths are compared ignoring case.
    """
    a = F.col("analysis_id")
    keyed = projects.select(
        "analysis_id", "project_id", "seq", F.concat_ws("|", a, "project_id").alias("by_id"), F.concat_ws("|", a, F.lower("path")).alias("by_path"), F.concat_ws("|", a, F.lower(paths.directory(F.col("path")))).alias("by_root")
    ).withColumn(take, F.col("project_id"))
    up = F.transform(F.reverse(F.array_sort(paths.ancestors(F.col("path")), lambda x, y: F.length(x) - F.length(y))), lambda x: F.concat_ws("|", a, F.lower(x)))
    order = ("seq", "project_id")
    stages = [
        Stage(F.array(F.when(F.col("project_ref").isNotNull(), F.concat_ws("|", a, "project_ref"))), keyed, "by_id", order), Stage(F.array(F.concat_ws("|", a, F.lower("path"))), keyed, "by_path", order),
        Stage(up, keyed, "by_root", order), Stage(F.array(a), keyed, "analysis_id", order),
    ]
    return ranked_cascade(files, ["analysis_id", "path", "project_ref"], stages, [take])


def project_of_references(references: DataFrame, projects: DataFrame) -> DataFrame:
    """analysis_id, path and project: the first project (seq) whose name the path holds, anywhere; the path alone if none is."""
    names = projects.select("analysis_id", "name").distinct()
    hits = containing(references.select("analysis_id", "path").distinct(), "path", "path", names, "name")
    ranked = hits.join(first_per_key(projects.select("analysis_id", "name", "seq"), F.struct("analysis_id", "name"), ["seq"]), ["analysis_id", "name"])
    first = first_per_key(ranked, F.struct("analysis_id", "path"), ["seq"]).select("analysis_id", "path", F.col("name").alias("project"))
    return references.join(first, ["analysis_id", "path"], "left")


def first_edge_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) with the first edge (seq) that touches them, as edge_source, edge_target and edge_seq: two equi-joins and one aggregate."""
    ends = [edges.select(F.lower(end).alias("_end"), F.col("source_id").alias("edge_source"), F.col("target_id").alias("edge_target"), F.col("seq").alias("edge_seq")) for end in ("source_id", "target_id")]
    first = first_per_key(ends[0].unionByName(ends[1]), F.col("_end"), ["edge_seq"])
    return nodes.join(first, F.lower("id") == F.col("_end"), "left").drop("_end")
