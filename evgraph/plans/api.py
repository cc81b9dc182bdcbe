"""The query API over an analysis's stored tables: lists, details, overview and status.

tables is a mapping from table name to DataFrame, as analyze() makes and read_table() reads. Every query is
filtered by analysis first, so only that analysis's partition is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import details, histograms, listing

#: Names a dependency type and an evidence type can have.
DEPENDENCY_TYPES = tuple("ProjectReference PackageReference Inherits Implements Calls DependsOn Contains Defines Exposes MapsTo Reads Writes".split())
EVIDENCE_TYPES = tuple("ArchitectureEdge ProjectDependency ApiEndpoint DatabaseModel CodeSymbol General Declaration Invocation Configuration Dependency Route Database".split())


class Analysis:
    """One completed analysis. The gate is one row; what follows is lazy."""

    def __init__(self, tables: dict[str, DataFrame], analysis_id: str):
        listing.ensure_completed(tables["analyses"], analysis_id)
        self.id, self.tables = analysis_id, tables

    def table(self, name: str) -> DataFrame:
        return self.tables[name].where(F.col("analysis_id") == self.id)

    def one(self, name: str, row_id: str) -> DataFrame:
        found = self.table(name).where(F.col("id") == row_id)
        if not found.limit(1).count():
            raise listing.NotFound(row_id)
        return found

    def files(self, path: str | None = None, language: str | None = None, project: str | None = None, search: str | None = None, page: int = 1, size: int = listing.PAGE) -> DataFrame:
        f = self.table("source_files")
        kept = f.where(listing.has_text("path", path) & listing.has_text("path", search) & listing.of_language(F.col("language"), F.col("path"), language))
        kept = kept.where(F.col("project_id") == project) if project else kept
        return listing.page_of(kept, ["path"], page, size)

    def file(self, file_id: str) -> DataFrame:
        symbols = self.table("code_symbols").select("source_file_id", "start_line", "name", "symbol_type", "end_line")
        return listing.with_children(self.one("source_files", file_id), symbols, F.col("id") == F.col("source_file_id"), ["id", "path", "language", "size"], ["start_line", "name", "symbol_type", "end_line"], "symbols")

    def file_content(self, file_id: str) -> DataFrame:
        """path, content and line count; a placeholder where the content isn't kept."""
        kept = self.tables["files"].select("path", "content") if "files" in self.tables else None
        found = self.one("source_files", file_id).select("path")
        whole = found.join(kept, "path", "left") if kept is not None else found.withColumn("content", F.lit(None).cast("string"))
        return whole.select("path", F.coalesce("content", F.lit("// content is not available")).alias("content"), F.when(F.col("content").isNotNull(), F.size(F.split("content", r"\r\n|\r|\n", -1))).otherwise(0).alias("lines"))

    def endpoints(self, method: str | None = None, route: str | None = None, project: str | None = None, controller: str | None = None, page: int = 1, size: int = listing.PAGE) -> DataFrame:
        e = self.table("api_endpoints").where(listing.has_text("route", route) & listing.has_text("controller", controller))
        e = e.where(F.upper("method") == method.upper()) if method else e
        e = e.where(F.col("project_id") == project) if project else e
        names = self.table("projects").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
        return listing.page_of(e.join(names, "project_id", "left"), ["route", "method"], page, size)

    def endpoint(self, endpoint_id: str) -> DataFrame:
        proof = self.table("evidences").select(F.col("id").alias("evidence_id"), "file_path", "start_line", "end_line", "description")
        names = self.table("projects").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
        return self.one("api_endpoints", endpoint_id).join(names, "project_id", "left").join(proof, "evidence_id", "left")

    def dependencies(self, project: str | None = None, direction: str = "both", kind: str | None = None, page: int = 1, size: int = listing.PAGE) -> DataFrame:
        d = self.table("dependencies").where(listing.of_kind("dependency_type", kind, DEPENDENCY_TYPES))
        d = d.where(listing.in_direction(F.col("source_id"), F.col("target_id"), F.lit(project), direction)) if project else d
        names = self.table("projects").select(F.concat(F.lit("project:"), "name").alias("key"), "name")
        named = listing.with_names(listing.with_names(d, "source_id", names, "key", "name", "source_name"), "target_id", names, "key", "name", "target_name")
        return listing.page_of(named, ["id"], page, size)

    def dependency(self, dependency_id: str) -> DataFrame:
        """A dependency with the list of its evidence."""
        return details.dependencies_with_evidence(self.one("dependencies", dependency_id), self.table("evidences"))

    def evidences(self, path: str | None = None, symbol: str | None = None, kind: str | None = None, page: int = 1, size: int = listing.PAGE) -> DataFrame:
        kept = self.table("evidences").where(listing.has_text("file_path", path) & listing.has_text("symbol", symbol) & listing.of_kind("evidence_type", kind, EVIDENCE_TYPES))
        return listing.page_of(kept, ["file_path", "start_line", "id"], page, size)

    def evidence(self, evidence_id: str) -> DataFrame:
        return self.one("evidences", evidence_id)

    def symbol(self, symbol_id: str) -> DataFrame:
        outgoing = self.table("dependencies").select("source_guid", "target_id", "dependency_type")
        return listing.with_children(self.one("code_symbols", symbol_id), outgoing, F.col("id") == F.col("source_guid"), ["id", "full_name", "symbol_type", "start_line", "end_line"], ["target_id", "dependency_type"], "depends_on")

    def database_model(self) -> tuple[DataFrame, DataFrame]:
        state = F.when(F.col("evidence_id").isNotNull(), "confirmed").otherwise("inferred")
        return self.table("database_entities"), self.table("database_relationships").withColumn("state", state)

    def entity(self, entity_id: str) -> tuple[DataFrame, DataFrame]:
        """(relationships of an entity, evidence that names it or lies in its source file)."""
        found = self.one("database_entities", entity_id)
        relations = listing.touching(self.table("database_relationships"), found.select("id"), "source_entity_id", "target_entity_id", "id")
        return relations, details.entity_evidence(found, self.table("evidences"), self.table("code_symbols"), self.table("source_files"))

    def overview(self) -> DataFrame:
        names = ("projects", "source_files", "code_symbols", "dependencies", "api_endpoints", "database_entities")
        return histograms.overview({n: self.table(n) for n in names})

    def languages(self) -> DataFrame:
        return histograms.language_shares(self.table("source_files"), "language")

    def status(self) -> DataFrame:
        a = self.tables["analyses"].where(F.col("id") == self.id)
        return a.select("id", "status", scores.progress(F.col("current_stage"), F.col("status") == "Failed").alias("percent"))

    def metrics(self) -> DataFrame:
        """Counts of nodes and edges by type."""
        kinds = [histograms.by_type(self.table(n), "type").select(F.lit(n).alias("of"), "type", "n") for n in ("nodes", "edges")]
        return reduce(DataFrame.unionByName, kinds)
