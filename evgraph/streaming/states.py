"""The state of each job, kept over a stream of its events.

A state is what its events agree on whatever their order and however often they come: first and last time, the furthest stage, the first
end. So events that are late or doubled change nothing that they shouldn't. A job that has no end is timed out once the watermark has
passed its last event by a limit, and comes back if an event follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import first_per_key

#: The stages in order, and the ends.
STAGES = "Queued Acquiring Scanning StaticAnalysis Persisting Chunking Embedding Validation".split()
COMPLETED, FAILED, TIMED_OUT = "Completed", "Failed", "TimedOut"
CODES = (*STAGES, COMPLETED, FAILED)
OUT = "job string, status string, stage string, first_ts timestamp, last_ts timestamp, version long"
CHANGE = "job string, status string, stage string, first_us long, last_us long, version long"
STATE = "first_us long, last_us long, stage int, completed_us long, failed_us long, timed_out boolean, version long"
NEVER = (1 << 63) - 1


def _status(stage: int, completed: int, failed: int, timed_out: bool) -> str:
    if min(completed, failed) < NEVER:
        return FAILED if failed <= completed else COMPLETED
    return TIMED_OUT if timed_out else STAGES[stage] if stage >= 0 else STAGES[0]


def transitions(events: DataFrame, late: str = "1 hour", limit_seconds: int = 7 * 86_400) -> DataFrame:
    """A row for each change of a job's state. events: job, kind (a stage, Completed or Failed), ts; streaming.

    Kinds come as their places in CODES and times as microseconds, made natively: step runs once a job, on numbers only.
    """
    completes, fails = len(STAGES) + 1, len(STAGES) + 2

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (NEVER, -1, -1, NEVER, NEVER, False, 0)
        first, last, stage, completed, failed, timed_out, version = old
        if state.hasTimedOut:
            timed_out = True
        else:
            for rows in batches:
                us, code = rows["us"].to_numpy(), rows["code"].to_numpy()
                first, last = min(first, int(us.min())), max(last, int(us.max()))
                stage = max(stage, int(code[code < completes].max(initial=0)) - 1)
                completed = min(completed, int(us[code == completes].min(initial=NEVER)))
                failed = min(failed, int(us[code == fails].min(initial=NEVER)))
            timed_out = False
        new = (first, last, stage, completed, failed, timed_out)
        changed = new != tuple(old[:6])
        state.update((*new, version + changed))
        if min(completed, failed) == NEVER and not timed_out:
            due = last // 1000 + limit_seconds * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:  # it is due already
                new, version, changed = (*new[:5], True), version + changed, True
                state.update((*new, version + 1))
        if changed:
            yield pd.DataFrame({"job": [key[0]], "status": [_status(*new[2:6])], "stage": [STAGES[max(new[2], 0)]], "first_us": [new[0]], "last_us": [new[1]], "version": [version + 1]})

    code = F.coalesce(F.array_position(F.array(*map(F.lit, CODES)), F.col("kind")), F.lit(0)).cast("int")  # 0: none of them
    known = events.where("job IS NOT NULL AND ts IS NOT NULL").select("job", code.alias("code"), F.unix_micros("ts").alias("us"), "ts").withWatermark("ts", late)
    changes = known.groupBy("job").applyInPandasWithState(step, CHANGE, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return changes.select("job", "status", "stage", *(F.timestamp_micros(f"{x}_us").alias(f"{x}_ts") for x in ("first", "last")), "version")


def keep(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write every change below out, a folder a batch, so that a batch which is run again replaces its own rows."""

    def batch(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={k}")

    return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each job."""
    written = spark.read.schema(OUT).parquet(f"{out}/batch=*")
    return first_per_key(written, F.col("job"), ["version"], last=True).drop("version")
