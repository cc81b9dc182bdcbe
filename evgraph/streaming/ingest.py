"""Work items arrive as files; each micro-batch takes one, runs the analysis and writes its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import analyze
from ..sources.files import Sources, write_tables

WORK = "analysis_id string, repository_id string, type string, location string, folder string"


def queue(spark: SparkSession, folder: str, at_once: int = 1) -> DataFrame:
    """Work items in the order they arrive; as many files a batch as at_once."""
    return spark.readStream.schema(WORK).option("maxFilesPerTrigger", at_once).json(folder)


def run_one(spark: SparkSession, item: dict, root: str, sources: Sources) -> str:
    """Analyse one work item; the status it ends with. A failure is stored, not raised, so the queue goes on."""
    analysis = {"id": item["analysis_id"], "repository_id": item["repository_id"]}
    try:
        made = analyze(sources.read(spark, item), item["analysis_id"], item["repository_id"])
        write_tables({k: v for k, v in made.items() if k not in ("analyses", "nodes", "edges")}, root)
        state, message = "Completed", None
    except Exception as e:  # the contract: an item's failure is its status
        state, message = "Failed", str(e)[:500]
    row = spark.createDataFrame([(analysis["id"], analysis["repository_id"], state, message)], "id string, repository_id string, status string, error string")
    row.withColumn("analysis_id", F.col("id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{root}/analyses")
    return state


def start(spark: SparkSession, folder: str, root: str, checkpoint: str, sources: Sources | None = None, done: Callable[[str, str], None] | None = None) -> StreamingQuery:
    known = sources or Sources()

    def batch(items: DataFrame, _: int) -> None:
        for item in items.collect():  # work items, not data: at most at_once files of them
            state = run_one(spark, item.asDict(), root, known)
            if done:
                done(item["analysis_id"], state)

    return queue(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling windows; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
