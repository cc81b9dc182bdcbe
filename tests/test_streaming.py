"""The work queue: files of work items become tables."""

import json

from evgraph.operators import listing
from evgraph.sources.files import read_table
from evgraph.streaming.ingest import start, windowed_counts


def test_queue(spark, tmp_path):
    source = tmp_path / "repo"
    (source / "src").mkdir(parents=True)
    (source / "src" / "A.cs").write_text("namespace N;\npublic class A : IA { }\npublic interface IA { }\n")
    work = tmp_path / "work"
    work.mkdir()
    (work / "1.json").write_text(json.dumps({"analysis_id": "a1", "repository_id": "r", "type": "Directory", "location": str(source)}))
    (work / "2.json").write_text(json.dumps({"analysis_id": "a2", "repository_id": "r", "type": "Unknown", "location": "-"}))
    out, done = str(tmp_path / "tables"), {}
    start(spark, str(work), out, str(tmp_path / "cp"), done=done.__setitem__).awaitTermination(240)
    assert done == {"a1": "Completed", "a2": "Failed"}
    assert read_table(spark, out, "source_files", "a1").count() == 1
    assert {r["dependency_type"] for r in read_table(spark, out, "dependencies", "a1").collect()} >= {"Implements", "Contains"}
    analyses = read_table(spark, out, "analyses")
    listing.ensure_completed(analyses, "a1")
    for missing, error in (("a2", listing.AnalysisFailed), ("a3", listing.NotFound)):
        try:
            listing.ensure_completed(analyses, missing)
        except error:
            continue
        raise AssertionError(missing)


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM windows").first()["n"] == events.count()
