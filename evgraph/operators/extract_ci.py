"""Jobs of CI workflows: GitHub, GitLab and Azure YAML, Jenkins stages, and what stands for files without jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines
from ..rules import any_of, when_chain
from .ci_yaml import Job, jobs_of

#: Known triggers, and the words of each job role, in order.
TRIGGERS = "push pull_request workflow_dispatch schedule release merge_group".split()
ROLES = {
    "Rollback": "rollback revert fail", "Communication": "notify slack email teams discord announce", "Deploy": "deploy prod staging k8s ecs cluster",
    "Package": "docker image package artifact publish governance draft sign", "Test": "test lint sonar scan verify check analyze audit security",
}
MOST_FILES, MOST_STEPS = 3, 5


def is_workflow(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(^|/)\.github/workflows/[^/]*\.ya?ml$") | p.rlike(r"(^|/)(\.gitlab-ci\.yml|azure-pipelines\.yml|jenkinsfile)$")


def role(name: Column) -> Column:
    low = F.lower(name)
    tests = [(any_of([low.contains(w) for w in words.split()]) | (F.lit(kind == "Deploy") & low.contains("release") & ~low.contains("draft")), kind) for kind, words in ROLES.items()]
    return when_chain(tests, "Build")


def workflow_files(files: DataFrame) -> DataFrame:
    """The first three workflow files of each analysis, by path."""
    ranked = files.where(is_workflow(F.col("path"))).withColumn("_n", F.row_number().over(Window.partitionBy("analysis_id").orderBy("path")))
    return ranked.where(F.col("_n") <= MOST_FILES).drop("_n")


def triggers(text: Column) -> Column:
    found = F.filter(F.array(*map(F.lit, TRIGGERS)), lambda name: F.exists(lines(text), lambda x: F.rlike(x, F.concat(F.lit(r"^(\s{2,4}|on:\s*\[?.*\b)"), name, F.lit(r"\b")))))
    return F.when(F.size(found) > 0, F.array_join(found, " / ")).otherwise(F.lit("push / pull_request"))


def jobs(files: DataFrame) -> DataFrame:
    """analysis_id, path, workflow, trigger, job, seq, line, runs_on, needs (array), n_steps, role of each job.

    GitHub jobs need what they name; GitLab and Azure jobs that name nothing need the jobs of the stage before. A file without jobs has one, build.
    """
    yaml = workflow_files(files).where(F.lower("path").rlike(r"\.ya?ml$"))
    schema = pa.schema([("analysis_id", pa.string()), ("path", pa.string()), ("job", pa.string()), ("seq", pa.int32()), ("line", pa.int32()), ("runs_on", pa.string()), ("needs", pa.list_(pa.string())), ("n_steps", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for analysis, path, text in zip(*(b.column(c).to_pylist() for c in ("analysis_id", "path", "content")), strict=True):
                found = jobs_of(path, text or "") or [Job("build", 1)]
                rows += [(analysis, path, x.name, k, x.line, x.runs_on, x.needs, min(x.n_steps, MOST_STEPS)) for k, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    types = "analysis_id string, path string, job string, seq int, line int, runs_on string, needs array<string>, n_steps int"
    found = yaml.select("analysis_id", "path", "content").mapInArrow(read, types)
    named = F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^name:\s*['\"]?([^'\"\n]+)", 1), F.lit("")), paths.stem(F.col("path")))
    said = yaml.select(F.col("analysis_id").alias("_a"), F.col("path").alias("_p"), named.alias("workflow"), triggers(F.col("content")).alias("trigger"))
    met = found.join(said, (found["analysis_id"] == F.col("_a")) & (found["path"] == F.col("_p")))
    return met.select("analysis_id", "path", "workflow", "trigger", "job", "seq", "line", "runs_on", "needs", "n_steps", role(F.col("job")).alias("role")).unionByName(jenkins(files))


def jenkins(files: DataFrame) -> DataFrame:
    """Stages of Jenkinsfiles: each needs the one before it."""
    chosen = workflow_files(files).where(F.lower(paths.file_name(F.col("path"))) == "jenkinsfile")
    stages = F.regexp_extract_all("content", F.lit(r"stage\s*\(\s*['\"]([^'\"]+)['\"]"), 1)
    found = chosen.select("analysis_id", "path", stages.alias("_all"), F.posexplode(stages).alias("seq", "job"))
    needs = F.when(F.col("seq") > 0, F.array(F.get("_all", F.col("seq") - 1))).otherwise(F.array().cast("array<string>"))
    return found.select("analysis_id", "path", F.lit("Jenkins").alias("workflow"), F.lit("push / pull_request").alias("trigger"), "job", "seq", F.lit(1).alias("line"), F.lit("").alias("runs_on"), needs.alias("needs"), F.lit(0).alias("n_steps"), role(F.col("job")).alias("role"))
