"""The graph as normalised tables with deterministic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ids import evidence_key, guid, key
from ..functions.text import snippet
from . import chunks
from .intervals import longest_prefix
from .ordered import first_per_key

SYMBOLS = ("Namespace", "Class", "Interface", "Struct", "Method", "Property", "Field", "Enum", "Record", "Component")


def evidences(edges: DataFrame) -> DataFrame:
    """One row for each file and line span: that of the first edge."""
    kind = F.when(F.col("type") == "Exposes", "Route").when(F.col("type") == "MapsTo", "Database").when(F.col("type") == "Calls", "Invocation").when(F.col("type") == "DependsOn", "Dependency").otherwise("Declaration")
    rows = edges.where("file_path IS NOT NULL").select(
        "analysis_id", "file_path", F.col("target_id").alias("symbol"), F.greatest("start_line", F.lit(1)).alias("start_line"), F.greatest("end_line", "start_line", F.lit(1)).alias("end_line"),
        kind.alias("evidence_type"), snippet(F.col("snippet")).alias("description"), "confidence", "seq",
    )
    span = evidence_key(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    first = first_per_key(rows, F.concat_ws("|", F.col("analysis_id"), F.lower(span)), ["seq"])
    return first.withColumn("id", guid(key("evidence", F.col("analysis_id"), span))).withColumn("evidence_key", span).drop("seq")


def tables(analysis: DataFrame, files: DataFrame, projects: DataFrame, nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """projects, source_files, code_symbols, evidences, dependencies, api_endpoints, database_entities, database_relationships, document_chunks, analysis_issues.

    analysis: id, repository_id. files: analysis_id, path, language, size, hash, content (text). Ids are those of the natural keys,
    so a rerun gives the same rows. Routes and handlers are taken from the endpoint's properties, relations keep their
    multiplicity (many to one is stored as one to many the other way), and a missing evidence is null.
    """
    a = F.col("analysis_id")
    roots = projects.withColumn("root", paths.directory(F.col("path"))).withColumn("project_id", guid(key("project", a, F.col("path"))))
    projects_table = roots.select(F.col("project_id").alias("id"), "analysis_id", "name", "path", "language", "project_type")
    placed = longest_prefix(files.select("analysis_id", "path", "language", "size", "hash"), "path", roots.select("root", "project_id"), "root", ["project_id"])
    source_files = placed.select(guid(key("file", a, F.col("path"))).alias("id"), "analysis_id", "project_id", "path", "language", "size", "hash", F.lit("Analyzed").alias("analysis_status"))
    proof = evidences(edges)
    by_span = proof.select(F.col("analysis_id").alias("_a"), F.lower("evidence_key").alias("_k"), F.col("id").alias("evidence_id"))

    def proven(df: DataFrame) -> DataFrame:
        span = F.lower(evidence_key(F.col("file_path"), F.greatest("start_line", F.lit(1)), F.greatest("end_line", "start_line", F.lit(1))))
        return df.withColumn("_span", span).join(by_span, (df["analysis_id"] == F.col("_a")) & (F.col("_span") == F.col("_k")), "left").drop("_a", "_k", "_span")

    symbols = nodes.where(F.col("type").isin(*SYMBOLS) & F.col("start_line").isNotNull() & F.col("file_path").isNotNull())
    full = F.concat_ws(".", F.col("properties")["Namespace"], F.col("properties")["Container"], F.col("name"))
    symbol_type = F.when(F.col("type").isin("Record", "Component"), "Class").otherwise(F.col("type"))
    code_symbols = symbols.select(
        guid(key("symbol", a, F.col("id"))).alias("id"), "analysis_id", guid(key("file", a, F.col("file_path"))).alias("source_file_id"), "name", full.alias("full_name"), symbol_type.alias("symbol_type"), "start_line", "end_line", F.col("id").alias("node_id")
    )
    kind = F.when(F.col("target_id").startswith("package:"), "PackageReference").when(F.col("target_id").startswith("project:") & (F.col("type") == "DependsOn"), "ProjectReference").otherwise(F.col("type"))
    dependencies = proven(edges).select(
        guid(key("dep", a, F.col("source_id"), F.col("type"), F.col("target_id"))).alias("id"), "analysis_id", "source_id", "target_id", kind.alias("dependency_type"), "evidence_id",
        guid(key("symbol", a, F.col("source_id"))).alias("source_guid"), guid(key("symbol", a, F.col("target_id"))).alias("target_guid"),
    )
    p = F.col("properties")
    points = longest_prefix(nodes.where("type = 'Endpoint'").withColumn("properties", F.map_entries("properties")).select("analysis_id", "id", "name", "file_path", "start_line", "end_line", "properties"), "file_path", roots.select("root", "project_id"), "root", ["project_id"])
    points = proven(points.withColumn("properties", F.map_from_entries("properties")))
    handler = p["HandlerSymbol"]
    api_endpoints = points.select(
        guid(key("endpoint", a, F.col("id"))).alias("id"), "analysis_id", "project_id", p["HttpMethod"].alias("method"), p["RouteTemplate"].alias("route"), F.when(handler.contains("."), F.substring_index(handler, ".", 1)).alias("controller"),
        F.when(handler.contains("."), F.substring_index(handler, ".", -1)).alias("action"), F.lit(None).cast("string").alias("symbol_id"), "evidence_id",
    )
    entities = nodes.where("type = 'DatabaseEntity'")
    entity_id = lambda node: guid(key("dbentity", a, node))
    database_entities = entities.select(entity_id(F.col("id")).alias("id"), "analysis_id", "name", F.lit("Table").alias("entity_type"), guid(key("symbol", a, F.concat(F.lit("class:"), "name"))).alias("source_symbol_id"))
    many = edges.where(F.map_contains_key(F.coalesce("properties", F.create_map().cast("map<string,string>")), "Multiplicity")).withColumn("_m", p["Multiplicity"])
    swap = F.col("_m") == "ManyToOne"
    pairs = proven(many).withColumn("_s", F.when(swap, F.col("target_id")).otherwise(F.col("source_id"))).withColumn("_t", F.when(swap, F.col("source_id")).otherwise(F.col("target_id")))
    known = entities.select(F.col("analysis_id").alias("_e"), F.lower("id").alias("_n")).distinct()
    for end in ("_s", "_t"):
        pairs = pairs.join(known, (pairs["analysis_id"] == F.col("_e")) & (F.lower(end) == F.col("_n")), "left_semi")
    database_relationships = pairs.select(
        guid(key("dbrel", a, F.col("_s"), F.col("_t"))).alias("id"), "analysis_id", entity_id(F.col("_s")).alias("source_entity_id"), entity_id(F.col("_t")).alias("target_entity_id"), F.when(swap, "OneToMany").otherwise(F.col("_m")).alias("relationship_type"), "evidence_id"
    )
    spans = nodes.where("file_path IS NOT NULL AND start_line IS NOT NULL").select("analysis_id", F.col("file_path").alias("path"), "name", F.col("type").alias("kind"), "start_line", "end_line")
    made = chunks.generate(files.select("analysis_id", "path", "content"), spans, proof.select("analysis_id", "id", "file_path", "start_line", "end_line", "confidence"))
    chunk = made.withColumn("id", guid(key("chunk", a, F.col("file_path"), F.col("chunk_index")))).withColumn("source_file_id", guid(key("file", a, F.col("file_path"))))
    own = guid(key("evidence", a, F.col("evidence_key")))
    chunk = chunk.withColumn("evidence_id", F.coalesce(F.try_element_at("evidence_ids", F.lit(1)), own))
    # A chunk that no evidence overlaps gets one of its own.
    added = chunk.where(F.size("evidence_ids") == 0).select(
        "analysis_id", "file_path", "symbol", "start_line", "end_line", F.when(F.col("symbol").isNotNull(), "Declaration").otherwise("Configuration").alias("evidence_type"), snippet(F.col("content")).alias("description"), "confidence", F.col("evidence_id").alias("id"), "evidence_key"
    )
    all_proof = first_per_key(proof.unionByName(added), F.concat_ws("|", "analysis_id", "id"), ["file_path", "start_line"])
    analysis_issues = issues.select(guid(key("issue", a, F.col("path"), F.col("message"))).alias("id"), "analysis_id", F.col("path").alias("file_path"), F.lit("AnalysisWarning").alias("issue_type"), F.lit("Warning").alias("severity"), "message")
    return {
        "analyses": analysis, "projects": projects_table, "source_files": source_files, "code_symbols": code_symbols, "evidences": all_proof, "dependencies": dependencies, "api_endpoints": api_endpoints,
        "database_entities": database_entities, "database_relationships": database_relationships, "document_chunks": chunk, "analysis_issues": analysis_issues,
    }
