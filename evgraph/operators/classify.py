"""What a repository is: flags from its files and facts, then a cascade in which the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import paths
from ..rules import when_chain

#: Markers by file name, with the language they show.
MARKERS = {
    "csproj": "C#", "sln": "C#", "tsconfig.json": "TypeScript", "package.json": "JavaScript", "pom.xml": "Java", "build.gradle": "Java", "build.gradle.kts": "Java", "requirements.txt": "Python",
    "pyproject.toml": "Python", "setup.py": "Python", "pipfile": "Python", "go.mod": "Go", "composer.json": "PHP", "cargo.toml": "Rust",
}
FRAMEWORKS = ("next", "react", "express", "vue", "angular")


def flags(files: DataFrame, projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row an analysis: what its files (root and one level below; folders and views at any depth), facts and relations show. files: analysis_id, path, content (text)."""
    shallow = files.where((F.size(paths.segments(F.col("path"))) <= 2) & ~rules.in_ignored_directory(F.col("path"), rules.IGNORED_CLASSIFIER))
    name, ending = F.lower(paths.file_name(F.col("path"))), paths.extension(F.col("path"))
    manifest = name == "package.json"
    language = when_chain([(name.endswith(f".{m}") if m in ("csproj", "sln") else name == m, v) for m, v in MARKERS.items()])
    said = [F.bool_or(manifest & F.lower("content").contains(f'"{w}' if w != "angular" else "angular")).alias(w) for w in FRAMEWORKS]
    by_file = shallow.groupBy("analysis_id").agg(
        F.array_sort(F.collect_set(language)).alias("languages"), F.count_if(ending == "csproj").alias("n_csproj"), F.count_if(manifest).alias("n_npm"), F.bool_or(name.isin("pom.xml", "build.gradle", "build.gradle.kts")).alias("java"),
        F.bool_or(language == "Python").alias("python"), F.bool_or(language == "Go").alias("go"), F.bool_or(language == "PHP").alias("php"), F.bool_or(language == "Rust").alias("rust"),
        F.bool_or(ending.isin("csproj", "sln")).alias("dotnet"), *said,
    )
    low = F.lower("path")
    deep = files.groupBy("analysis_id").agg(
        F.bool_or(low.rlike(r"(^|/)(app|pages)/")).alias("routes"), F.count_if(low.endswith(".cshtml") | low.endswith(".razor")).alias("n_razor"),
        F.bool_or(low.rlike("(^|/)areas/")).alias("areas"), F.bool_or(low.rlike("(^|/)wwwroot/")).alias("wwwroot"),
    )
    what = nodes.groupBy("analysis_id").agg(
        F.count_if(F.col("type") == "Endpoint").alias("n_endpoints"), F.bool_or((F.col("type") == "Class") & F.col("name").endswith("Controller")).alias("controllers"), F.bool_or(F.col("name").endswith("DbContext") | F.col("name").endswith("Context")).alias("context"),
        F.count_if(F.col("type").isin("Class", "Interface") & F.lower("name").endswith("viewcomponent")).alias("n_view_components"), F.count_if(F.col("type") == "DatabaseEntity").alias("n_entities"), F.bool_or((F.col("type") == "Class") & (F.col("name") == "Program")).alias("program"), F.bool_or(F.lower("name").contains("library")).alias("library"),
    )
    how = edges.groupBy("analysis_id").agg(
        F.bool_or((F.col("type") == "DependsOn") & F.col("source_id").startswith("project:") & F.col("target_id").startswith("project:")).alias("references"), F.bool_or(F.col("type").isin("Implements", "Inherits", "Calls")).alias("relations")
    )
    counted = projects.groupBy("analysis_id").agg(F.count("*").alias("n_projects"))
    out = by_file
    for part in (deep, what, how, counted):
        out = out.join(part, "analysis_id", "full")
    numbers = ["n_csproj", "n_npm", "n_endpoints", "n_entities", "n_projects", "n_razor", "n_view_components"]
    booleans = [c for c, t in out.dtypes if t == "boolean"]
    out = out.fillna(0, numbers).fillna(False, booleans).withColumn("mvc", (F.col("n_razor") > 0) | F.col("areas") | (F.col("n_view_components") > 0))
    return out.withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))


def decide(flagged: DataFrame) -> DataFrame:
    """flags with repository_type and confidence."""
    f = F.col
    third = f("references") | f("relations") | (f("n_projects") > 1)
    front = f("next") | f("react") | f("vue") | f("angular")
    endpoints = f("n_endpoints") > 0
    nothing = (F.size("languages") == 0) & ~endpoints & ~f("controllers") & ~third
    cascade = [
        (nothing, ("Unsupported", F.lit("Unknown"))),
        (((f("n_csproj") > 1) | (f("n_npm") > 1) | ((f("n_csproj") > 0) & (f("n_npm") > 0))) & (f("n_projects") > 1), ("Monorepo", F.when(f("references"), "High").otherwise("Medium"))),
        ((endpoints & ~front) | f("controllers"), ("ApiBackend", F.when(endpoints & f("controllers") & f("context"), "High").otherwise("Medium"))),
        (front | (f("routes") & (f("n_npm") > 0)), ("Frontend", F.when(f("routes") & (f("next") | f("react")), "High").otherwise("Medium"))),
        (f("express"), ("ApiBackend", F.lit("Medium"))),
        (f("java") | f("python") | f("go") | f("php") | f("rust"), ("ApiBackend", F.lit("High"))),
        (f("program") & ~f("controllers") & ~endpoints & (f("n_csproj") > 0), ("Cli", F.when(third, "High").otherwise("Medium"))),
        (f("library") | (f("n_csproj") > 0), ("Library", F.when(third, "Medium").otherwise("Low"))),
    ]
    kind, sure = F.lit("Unsupported"), F.when(F.size("languages") == 0, "Unknown").otherwise("Low")
    for test, (value, confidence) in reversed(cascade):
        kind, sure = F.when(test, value).otherwise(kind), F.when(test, confidence).otherwise(sure)
    return flagged.withColumn("repository_type", kind).withColumn("confidence", sure)
