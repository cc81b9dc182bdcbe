"""Scans: which files of a repository are read, what they are, which projects they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import paths
from .ordered import cap, running_totals

ERROR = "path string, message string"


def sources(files: DataFrame, most_files: int = rules.MOST_FILES, most_file: int = rules.MOST_FILE_BYTES, most_all: int = rules.MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of an analysis scan of (path, size, content); files gain category, language and hash.

    Limits are global and in path order: a file that is too large is left out with an error, whatever others have its path, then the
    number of files and their total size end the scan, with one error each.
    """
    bare = files.drop("category").withColumn("path", paths.normal(F.col("path")))
    allowed = ~paths.unsafe(F.col("path")) & ~rules.in_ignored_directory(F.col("path"), rules.IGNORED_ANALYSIS) & ~rules.is_secret_file(F.col("path")) & ~rules.is_generated(F.col("path"))
    known = bare.where(allowed).withColumn("category", rules.category(F.col("path"))).where(F.col("category").isNotNull() | rules.project_type(F.col("path")).isNotNull())
    large = known.where(F.col("size") > most_file).select("path", F.lit("The file is too large.").alias("message"))
    # Names and sizes are ordered over all ranges of paths; contents stay where they are.
    sized = known.where((F.col("size") <= most_file) & F.col("category").isNotNull()).select("path", "size")
    ranked = running_totals(sized, [F.upper("path"), F.col("path"), F.col("size")], {"_n": F.lit(1), "_sum": F.col("size")})
    over = F.when(F.col("_n") > most_files, "The number of files is at its limit.").when(F.col("_sum") > most_all, "The size of the files is at its limit.")
    judged = ranked.withColumn("message", over)
    ended = judged.where("message IS NOT NULL").groupBy("message").agg(F.min_by("path", "_n").alias("path")).select("path", "message")
    kept = _within(known.where(F.col("size") <= most_file), judged)
    kept = kept.withColumn("language", rules.language(F.col("path"))).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    return kept, large.union(ended)


def _within(files: DataFrame, judged: DataFrame) -> DataFrame:
    """The files that the limits leave: of those alike in path and size, among which the scan may end, as many as were let in, by their contents' hash."""
    counts = judged.groupBy("path", "size").agg(F.count_if(F.col("message").isNull()).alias("_in"), F.count("*").alias("_all")).where("_in > 0")
    met = files.join(counts, ["path", "size"])
    whole, last = met.where("_in = _all"), met.where("_in < _all")
    alike = Window.partitionBy("path", "size").orderBy(F.sha2(F.col("content").cast("binary"), 256))
    last = last.withColumn("_n", F.row_number().over(alike)).where("_n <= _in").drop("_n")
    return whole.unionByName(last).select(*files.columns)


def ingest(files: DataFrame, extra: tuple[str, ...] = (), most: int = rules.MOST_INGEST_BYTES) -> DataFrame:
    """The ingest scan: its own ignored directories (and extra ones), endings and size limit."""
    named = files.withColumn("path", paths.normal(F.col("path")))
    bad = rules.in_ignored_directory(F.col("path"), [*rules.IGNORED_INGEST, *map(str.lower, extra)], dotted=False) | rules.has_ignored_ending(F.col("path")) | (F.col("size") > most)
    return named.where(~bad & ~paths.unsafe(F.col("path"))).withColumn("language", rules.language(F.col("path"))).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))


def projects(files: DataFrame) -> DataFrame:
    """name, path, project_type and language of the projects that manifests make (analysis scan)."""
    allowed = ~rules.in_ignored_directory(F.col("path"), rules.IGNORED_ANALYSIS)
    found = files.where(allowed).withColumn("project_type", rules.project_type(F.col("path"))).where("project_type IS NOT NULL")
    folder = paths.file_name(paths.directory(F.col("path")))
    name = F.when(F.col("project_type") == "CSharp", paths.stem(F.col("path"))).otherwise(F.when(folder == "", paths.stem(F.col("path"))).otherwise(folder))
    language = rules.when_chain([(F.col("project_type") == k, v) for k, v in rules.PROJECT_LANGUAGE.items()])
    return found.select(name.alias("name"), "path", "project_type", language.alias("language"))


def solutions(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").endswith(".sln")).select(paths.stem(F.col("path")).alias("name"), "path")


def ingest_projects(files: DataFrame) -> DataFrame:
    """Projects of the ingest scan: package.json gives the name it holds."""
    name = F.lower(paths.file_name(F.col("path")))
    kind = rules.when_chain([(name.endswith(".csproj"), "CSharp"), (name.endswith(".sln"), "Solution"), (name == "package.json", "Node"), (name == "tsconfig.json", "TypeScript")])
    named = F.coalesce(F.when(kind == "Node", F.get_json_object(F.decode(F.col("content").cast("binary"), "UTF-8"), "$.name")), F.when(kind.isin("CSharp", "Solution"), paths.stem(F.col("path"))), paths.file_name(paths.directory(F.col("path"))))
    return files.withColumn("kind", kind).where("kind IS NOT NULL").select(named.alias("name"), "path", F.col("kind").alias("project_type"))


def by_path(files: DataFrame) -> DataFrame:
    return files.orderBy(paths.by_path(), "path")


def capped_edges(edges: DataFrame, most: int = rules.MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """(edges up to the limit in order of seq, one error row if there were more)."""
    more = edges.groupBy().agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast("string").alias("path"), F.lit("The number of edges is at its limit.").alias("message"))
    return cap(edges, ["seq"], most), more
