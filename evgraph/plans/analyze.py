"""From a repository's files to tables, and from a question to an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import embed
from ..operators import extract_ci, extract_cs, extract_manifest, extract_ts, grounding, mapper, resolve, retrieval, scan
from ..sources.files import settle, with_text


def facts(files: DataFrame, analysis_id: str) -> dict[str, DataFrame]:
    """Scan and extraction of one repository's files (path, size, content as bytes)."""
    kept, errors = scan.sources(files)
    text = settle(with_text(kept).withColumn("analysis_id", F.lit(analysis_id)), "files")
    projects = scan.projects(files).withColumn("analysis_id", F.lit(analysis_id))
    manifests = with_text(files.where(F.lower("path").rlike(r"(\.csproj|package\.json)$"))).withColumn("analysis_id", F.lit(analysis_id))
    npm, bad = extract_manifest.npm(manifests)
    cs = settle(extract_cs.facts(text), "cs-facts")
    issues = errors.withColumn("analysis_id", F.lit(analysis_id)).unionByName(bad).unionByName(cs.where("fact = 'error'").select("analysis_id", "path", F.col("detail").alias("message")))
    return {
        "files": text, "projects": projects, "npm": npm, "csproj": extract_manifest.csproj(manifests), "cs": cs, "ts": settle(extract_ts.facts(text), "ts-facts"), "issues": issues,
        "ci": extract_ci.jobs(with_text(files).withColumn("analysis_id", F.lit(analysis_id))),
    }


def graph(found: dict[str, DataFrame], most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    nodes, edges = resolve.graph([resolve.manifests(found["projects"], found["npm"], found["csproj"]), resolve.csharp(found["cs"]), resolve.typescript(found["ts"])])
    return nodes, scan.capped_edges(edges, most_edges)[0] if most_edges else edges


def analyze(files: DataFrame, analysis_id: str, repository_id: str = "") -> dict[str, DataFrame]:
    """All tables of an analysis, its nodes and edges."""
    found = facts(files, analysis_id)
    nodes, edges = graph(found)
    nodes, edges = settle(nodes, "nodes"), settle(edges, "edges")
    analysis = files.sparkSession.createDataFrame([(analysis_id, repository_id, "Completed", "Completed")], "id string, repository_id string, status string, current_stage string")
    # The tables share evidence and chunks; each is written once, so that later queries start from rows.
    made = mapper.tables(analysis, found["files"], found["projects"], nodes, edges, found["issues"])
    made = {name: settle(df, name.replace("_", "-")) for name, df in made.items()}
    return made | {"nodes": nodes, "edges": edges, "ci_jobs": settle(found["ci"], "ci-jobs"), "files": found["files"].select("analysis_id", "path", "content")}


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = retrieval.TOP, dimension: int = retrieval.DIMENSION) -> DataFrame:
    """The k chunks nearest to each question (question_id, analysis_id, question), within its analysis."""
    vectors = chunks.withColumn("embedding", embed(F.col("content"), dimension))
    asked = questions.select(F.col("question_id").alias("query_id"), "analysis_id", embed(F.col("question"), dimension).alias("query"))
    near = retrieval.top_k_each(vectors, asked, k, ["analysis_id"])
    return near.join(chunks.drop("distance"), "id").withColumnRenamed("query_id", "answer_id").withColumn("similarity", 1 - F.col("distance"))


def prompt_context(found: DataFrame) -> DataFrame:
    """answer_id and the context of its chunks, nearest first."""
    part = F.concat_ws("\n", F.concat(F.lit("File: "), "file_path"), F.concat(F.lit("Symbol: "), F.coalesce("symbol", F.lit("-"))), F.concat(F.lit("Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.format_string("Similarity: %.2f", "similarity"), "content")
    ranked = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("text")))).alias("parts"))
    return ranked.select("answer_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("context"))


def offline_answer(context: DataFrame) -> DataFrame:
    """What answers without a model: the files of the context, or a refusal."""
    files = F.array_distinct(F.regexp_extract_all("context", F.lit(r"(?m)^File: (.+)$"), 1))
    return context.select("answer_id", F.when(F.size(files) > 0, F.concat(F.lit("The evidence is in "), F.array_join(files, ", "), F.lit("."))).otherwise(F.lit(grounding.REFUSAL)).alias("answer"))


def ask(chunks: DataFrame, questions: DataFrame, answer: Callable[[DataFrame], DataFrame] = offline_answer, k: int = retrieval.TOP, dimension: int = retrieval.DIMENSION) -> DataFrame:
    """Validated answers to all questions at once."""
    found = retrieve(chunks, questions, k, dimension).persist()
    answers = questions.select(F.col("question_id").alias("answer_id")).join(answer(prompt_context(found)), "answer_id", "left")
    return grounding.validate(answers.fillna({"answer": grounding.REFUSAL}), found)
