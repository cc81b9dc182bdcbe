"""Answers held against retrieved evidence: claims, citations, statuses and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as t
from ..functions.scores import clamp, percent_text
from ..rules import any_of

#: The answer that stands for a refusal, and the mark of an unsupported claim.
REFUSAL = "Insufficient evidence in the analyzed repository."
UNCERTAIN = "[Uncertain - unsupported by retrieved evidence]: "


def claims(answers: DataFrame) -> DataFrame:
    """answer_id, at, claim, files, names: the sentences of each answer and what they refer to."""
    spread = answers.select("answer_id", F.posexplode(t.sentences(F.col("answer"))).alias("at", "claim"))
    return spread.select("answer_id", "at", "claim", t.file_references(F.col("claim")).alias("files"), t.identifiers(F.col("claim")).alias("names"))


def check_claims(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, at, claim, missing, supported. chunks: answer_id, file_path, symbol, content.

    A claim is unsupported if a file it names matches no chunk's file, or else a name stands in no chunk's
    symbol or content; a claim that names nothing is supported. A chunk meets only claims of its answer.
    """
    refs = claims(answers)
    each = refs.select(
        "answer_id",
        "at",
        F.explode(
            F.concat(
                F.transform("files", lambda f, i: F.struct(F.lit(0).alias("kind"), i.alias("i"), f.alias("ref"))),
                F.transform("names", lambda n, i: F.struct(F.lit(1).alias("kind"), i.alias("i"), n.alias("ref"))),
            )
        ).alias("r"),
    ).select("answer_id", "at", "r.*")
    known = chunks.select(F.col("answer_id").alias("_answer"), "file_path", "symbol", "content")
    met = (F.col("kind") == 0) & t.file_matches(F.col("ref"), F.coalesce("file_path", F.lit("")))
    met = met | (F.col("kind") == 1) & (F.lower(F.coalesce("symbol", F.lit(""))).contains(F.lower("ref")) | F.coalesce("content", F.lit("")).contains(F.col("ref")))
    lost = each.join(known, (F.col("answer_id") == F.col("_answer")) & met, "left_anti")
    first = lost.groupBy("answer_id", "at").agg(F.min_by("ref", F.struct("kind", "i")).alias("missing"))
    return refs.select("answer_id", "at", "claim").join(first, ["answer_id", "at"], "left").withColumn("supported", F.col("missing").isNull())


def check_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations with verified: a chunk of the answer has the file and, if one is named, the symbol."""
    known = chunks.select(F.col("answer_id").alias("_answer"), F.col("file_path").alias("_file"), F.col("symbol").alias("_symbol"), F.col("content").alias("_content"))
    named = F.coalesce(F.col("symbol"), F.lit("")) == ""
    holds = F.lower(F.coalesce("_symbol", F.lit(""))).contains(F.lower("symbol")) | F.coalesce("_content", F.lit("")).contains(F.col("symbol"))
    on = (F.col("answer_id") == F.col("_answer")) & t.file_matches(F.col("file_path"), F.col("_file")) & (named | holds)
    good = citations.join(known, on, "left_semi").withColumn("verified", F.lit(True))
    return good.unionByName(citations.join(known, on, "left_anti").withColumn("verified", F.lit(False)))


def evidence(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, file, symbol, start_line, end_line, reason: every chunk, and the verified citations that none of them or no earlier citation stands for.

    chunks also hold chunk_index, start_line, end_line, confidence and similarity, citations seq, start_line, end_line and reason.
    Files that match have one name, whatever their folders, so what stands for a citation is found by equal keys; null lines are equal.
    """
    key = ["answer_id", "_name", "start_line", "end_line"]
    name = F.lower(paths.file_name(paths.normal(F.col("file_path"))))
    score = F.concat(F.lit("Grounded from chunk "), F.col("chunk_index").cast("string"), F.lit(" (similarity: "), percent_text(F.col("similarity")), F.lit(", confidence: "), F.format_string("%.2f", "confidence"), F.lit(")"))
    given = chunks.select("answer_id", "file_path", "symbol", "start_line", "end_line", score.alias("reason"))
    good = check_citations(citations, chunks).where("verified").withColumn("_name", name)
    first = good.groupBy(*key).agg(F.min_by(F.struct("file_path", "symbol", "reason"), F.struct("seq", "file_path", "symbol", "reason")).alias("x")).select(*key, "x.*")
    known = given.select(name.alias("_name"), "answer_id", "start_line", "end_line").distinct().toDF("_n", "_a", "_b", "_e")
    same = (F.col("answer_id") == F.col("_a")) & (F.col("_name") == F.col("_n")) & F.col("start_line").eqNullSafe(F.col("_b")) & F.col("end_line").eqNullSafe(F.col("_e"))
    return given.unionByName(first.join(known, same, "left_anti").drop("_name")).withColumnRenamed("file_path", "file")


def status(answer: Column, n_chunks: Column, n_claims: Column, n_failed: Column, n_rejected: Column) -> Column:
    blank = F.coalesce(F.trim(answer), F.lit("")) == ""
    return (
        F.when(blank | (n_chunks == 0), "InsufficientEvidence")
        .when((n_failed == 0) & (n_rejected == 0), "FullySupported")
        .when((n_claims > 0) & (n_failed == n_claims), "Unsupported")
        .otherwise("PartiallySupported")
    )


def apply_policy(checked: DataFrame, action: str = "MarkUncertain") -> DataFrame:
    """answer_id and the answer's text after unsupported claims are marked, removed, or the whole is refused."""
    shown = F.when(F.col("supported"), F.col("claim"))
    if action == "MarkUncertain":
        shown = shown.otherwise(F.concat(F.lit(UNCERTAIN), F.col("claim")))
    grouped = checked.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("at", shown.alias("text")))).alias("parts"), F.bool_and("supported").alias("whole"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda x: x.isNotNull()), " ")
    return grouped.select("answer_id", (F.when(F.col("whole"), text).otherwise(F.lit(REFUSAL)) if action == "RejectIfAny" else text).alias("answer"))


def quality(static: Column, similarity: Column, n_chunks: Column) -> Column:
    coverage = F.when(n_chunks >= 3, 1.0).when(n_chunks == 2, 0.9).otherwise(0.8)
    return 0.40 * clamp(static) + 0.40 * clamp(similarity) + 0.20 * coverage


def grounded(state: Column, ratio: Column, rejected: Column) -> Column:
    partly = (0.5 + 0.4 * F.coalesce(ratio, F.lit(0.5))) * F.when(rejected, 0.9).otherwise(1.0)
    return F.when(state == "Unsupported", 0.0).when(state == "PartiallySupported", partly).when(state == "FullySupported", F.when(rejected, 0.85).otherwise(1.0)).otherwise(0.2)


def confidence(static: Column, similarity: Column, n_chunks: Column, state: Column, ratio: Column, rejected: Column, blank: Column | None = None) -> tuple[Column, Column]:
    """(score, level) of an answer; 0 and Unknown where blank holds: there is no question or no answer."""
    blank = F.lit(False) if blank is None else blank
    raw = clamp(quality(static, similarity, n_chunks) * grounded(state, ratio, rejected))
    limited = (state == "PartiallySupported") | rejected
    score = F.when(blank, F.lit(0.0)).when(n_chunks == 0, F.lit(0.1)).when(limited, F.least(raw, F.lit(0.7))).otherwise(raw)
    level = (
        F.when(blank, "Unknown")
        .when((n_chunks == 0) | (state == "Unsupported"), "Low")
        .when(limited, F.when(score >= 0.45, "Medium").otherwise("Low"))
        .when(score >= 0.75, "High")
        .when(score >= 0.45, "Medium")
        .otherwise("Low")
    )
    return score, level


def validate(answers: DataFrame, chunks: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """One row an answer: status, claims, failures, rejected citations, score and level. chunks also hold confidence and similarity.

    answers may hold question; where it or the answer is blank, the level is Unknown.
    """
    checked = check_claims(answers, chunks)
    by_claim = checked.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("supported")).alias("n_failed"))
    by_chunk = chunks.groupBy("answer_id").agg(F.count("*").alias("n_chunks"), F.avg(F.coalesce("confidence", F.lit(1.0))).alias("static"), F.avg("similarity").alias("similarity"))
    joined = answers.join(by_claim, "answer_id", "left").join(by_chunk, "answer_id", "left")
    if citations is not None:
        rejected = check_citations(citations, chunks).groupBy("answer_id").agg(F.count_if(~F.col("verified")).alias("n_rejected"))
        joined = joined.join(rejected, "answer_id", "left")
    else:
        joined = joined.withColumn("n_rejected", F.lit(0).cast("long"))
    joined = joined.fillna(0, ["n_claims", "n_failed", "n_chunks", "n_rejected"]).fillna(0.0, ["static", "similarity"])
    n = {c: F.col(c) for c in ("n_claims", "n_failed", "n_chunks", "n_rejected")}
    state = status(F.col("answer"), n["n_chunks"], n["n_claims"], n["n_failed"], n["n_rejected"])
    ratio = F.when(n["n_claims"] > 0, (n["n_claims"] - n["n_failed"]) / n["n_claims"])
    blank = any_of([F.coalesce(F.trim(c), F.lit("")) == "" for c in ("question", "answer") if c in answers.columns])
    score, level = confidence(F.col("static"), F.col("similarity"), n["n_chunks"], F.col("status"), ratio, n["n_rejected"] > 0, blank)
    held = joined.withColumn("status", state).withColumn("score", score).withColumn("level", level)
    refused = (F.col("status").isin("InsufficientEvidence", "Unsupported")) & ~((n["n_chunks"] == 0) & t.is_refusal(F.col("answer")))
    return held.withColumn("final_answer", F.when(refused, F.lit(REFUSAL)).otherwise(F.col("answer"))).select(
        "answer_id", "status", *n, F.bround("score", 6).alias("score"), "level", "final_answer"
    )
