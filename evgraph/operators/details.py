"""What belongs to dependencies and entities, for whole tables; a detail of one is the same with one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROOF = ("id", "file_path", "start_line", "end_line", "description")


def _listed(rows: DataFrame, on: str) -> DataFrame:
    """Evidence rows as a sorted list for each key."""
    return rows.groupBy(on).agg(F.array_sort(F.collect_set(F.struct("file_path", "start_line", "end_line", "id", "description"))).alias("evidence"))


def dependencies_with_evidence(dependencies: DataFrame, evidences: DataFrame) -> DataFrame:
    """dependencies with the list of their evidence; an empty one where there is none."""
    proof = evidences.select(*PROOF)
    met = dependencies.select(F.col("id").alias("_d"), F.col("evidence_id").alias("_e")).distinct().join(proof, F.col("_e") == F.col("id"))
    none = F.array().cast("array<struct<file_path: string, start_line: int, end_line: int, id: string, description: string>>")
    return dependencies.join(_listed(met, "_d"), F.col("id") == F.col("_d"), "left").drop("_d").withColumn("evidence", F.coalesce("evidence", none))


def entity_evidence(entities: DataFrame, evidences: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """entity_id and the evidence that names the entity or lies in the file of its source symbol: two equi-joins, each evidence once.

    entities: analysis_id, id, name, source_symbol_id. symbols: id, source_file_id. files: id, path. An evidence without a description says what it defines.
    """
    e = entities.select("analysis_id", F.col("id").alias("entity_id"), "name", "source_symbol_id")
    source = e.join(symbols.select(F.col("id").alias("source_symbol_id"), "source_file_id"), "source_symbol_id").join(files.select(F.col("id").alias("source_file_id"), F.col("path").alias("file_path")), "source_file_id")
    proof = evidences.select("analysis_id", *PROOF, "symbol")
    by_name = proof.withColumn("name", F.regexp_replace("symbol", "^entity:", "")).join(e, ["analysis_id", "name"])
    by_file = proof.join(source.select("analysis_id", "entity_id", "name", "file_path"), ["analysis_id", "file_path"])
    columns = ("entity_id", "name", *PROOF)
    found = by_name.select(*columns).unionByName(by_file.select(*columns)).distinct()
    said = F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description")).otherwise(F.concat(F.lit("Defines the "), "name", F.lit(" entity.")))
    return found.select("entity_id", *PROOF[:-1], said.alias("description"))
