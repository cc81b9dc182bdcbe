"""Job states over a stream, cascades, as-of joins, CI trees and archive ranges against plain forms of themselves."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from evgraph.operators import cascade, ci_yaml, totals
from evgraph.sources import archive_source
from evgraph.streaming import states


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected_states(events, now, limit):
    out = {}
    for job in {e[0] for e in events if e[0] is not None}:
        own = [e for e in events if e[0] == job]
        done = min((t for _, k, t in own if k == "Completed"), default=None)
        failed = min((t for _, k, t in own if k == "Failed"), default=None)
        stage = states.STAGES[max([states.STAGES.index(k) for _, k, _ in own if k in states.STAGES], default=0)]
        last = max(t for *_, t in own)
        status = "Failed" if failed is not None and (done is None or failed <= done) else "Completed" if done is not None else "TimedOut" if last + limit <= now - 3600 else stage
        out[job] = (job, status, stage)
    return sorted(out.values())


def test_states_in_another_time_zone(spark, tmp_path):
    """A job is due by the time that passed, wherever the session is, and its times come back as they were."""
    zone, t0, day = spark.conf.get("spark.sql.session.timeZone"), 1_730_615_400, 86_400  # 01:30 the second time
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = spark.createDataFrame([("a", "Scanning", t0), ("b", "Queued", t0 + 7 * day)], "job string, kind string, s long").selectExpr("job", "kind", "timestamp_seconds(s) AS ts")
        events.coalesce(1).write.parquet(str(tmp_path / "in"))
        states.keep(states.transitions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
        got = states.current(spark, str(tmp_path / "out")).selectExpr("job", "status", "unix_seconds(first_ts)", "unix_seconds(last_ts)").collect()
        assert sorted(map(tuple, got)) == [("a", "Scanning", t0, t0), ("b", "Queued", t0 + 7 * day, t0 + 7 * day)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_states_survive_disorder_doubles_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    kinds = [*states.STAGES[:5], "Completed", "Failed", "Unknown"]
    events = [(f"j{rng.randrange(30)}", rng.choices(kinds, [6, 6, 6, 6, 6, 1, 1, 1])[0], rng.randrange(1_700_000_000, 1_700_000_000 + 20 * 86_400)) for _ in range(160)]
    events += rng.choices(events, k=20) + [(None, "Queued", 1_700_000_000)]
    limit = 3 * 86_400
    frame = lambda part: spark.createDataFrame(part, "job string, kind string, s long").select("job", "kind", F.timestamp_seconds("s").alias("ts"))
    read = lambda: spark.readStream.schema(frame(events).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: states.keep(states.transitions(read(), "400 days", limit), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    shuffled = rng.sample(events, len(events))
    frame(shuffled[:90]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    frame(shuffled[90:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # the second run goes on from the first one's checkpoint
    got = states.current(spark, str(tmp_path / "out")).select("job", "status", "stage")
    assert rows(got) == expected_states(events, 0, limit)  # the watermark stays behind all events: nothing is timed out


def test_jobs_without_an_end_time_out(spark, tmp_path):
    day, start = 86_400, 1_700_000_000
    events = [("old", "Scanning", start), ("done", "Completed", start), ("new", "Scanning", start + 30 * day)]
    frame = spark.createDataFrame(events, "job string, kind string, s long").select("job", "kind", F.timestamp_seconds("s").alias("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    states.keep(states.transitions(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "1 hour", 7 * day), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    assert rows(states.current(spark, str(tmp_path / "out")).select("job", "status", "stage")) == expected_states(events, start + 30 * day, 7 * day)


def test_cascade_takes_the_first_stage_that_knows(spark):
    projects = spark.createDataFrame([("a", "p1", "x/A.csproj", 2), ("a", "p2", "x/y/B.csproj", 3), ("a", "p3", "x/A.csproj", 1), ("a", "p4", "Root.csproj", 4), ("b", "q", "z/Q.csproj", 1)], "analysis_id string, project_id string, path string, seq int")
    files = [("a", "x/y/z/f.cs", None, "p2"), ("a", "X/A.CSPROJ", None, "p3"), ("a", "x/f.cs", "p1", "p1"), ("a", "x/f.cs", "none", "p3"), ("a", "f.cs", None, "p4"), ("b", "far/f.cs", None, "q"), ("c", "x/f.cs", "p1", None), ("a", "x/y/z/f.cs", None, "p2")]
    got = cascade.project_of_files(spark.createDataFrame([f[:3] for f in files], "analysis_id string, path string, project_ref string"), projects)
    assert rows(got) == sorted([(*f[:3], f[3]) for f in files], key=repr)


def test_as_of(spark):
    rng = random.Random(2)
    left = [(k, rng.choice((1, 1, 1, 2, None)), rng.randrange(0, 5_000)) for k in range(300)] + [(999, 3, None)]
    right = [(rng.choice((1, 1, 2, None)), rng.randrange(0, 5_000), k) for k in range(120)] + [(1, 700, 500), (1, 700, 501)]
    a = spark.createDataFrame(left, "id long, k int, s long").select("id", "k", F.timestamp_seconds("s").alias("t"))
    b = spark.createDataFrame(right, "k int, s long, v long").select("k", F.timestamp_seconds("s").alias("since"), "v")
    expected = sorted(((i, max(((s, v) for j, s, v in right if j == k and k is not None and t is not None and s <= t), default=(0, None))[1]) for i, k, t in left), key=repr)
    for width in (1, 50, 10_000):
        assert rows(totals.as_of(a, b, "k", "t", "since", ["v"], width).select("id", "v")) == expected


def test_levels_of_totals(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 6), ("y", 1, 7), (None, 1, 8)], "a string, b int, n int")
    assert rows(totals.rollup(df, ["a", "b"], n=F.sum("n"))) == sorted([("x", 1, 0, 5), ("x", 2, 0, 6), ("y", 1, 0, 7), (None, 1, 0, 8), ("x", None, 1, 11), ("y", None, 1, 7), (None, None, 1, 8), (None, None, 3, 26)], key=repr)
    assert rows(totals.grouping_sets(df, [["a"], ["b"]], ["a", "b"], n=F.sum("n"))) == sorted([("x", None, 1, 11), ("y", None, 1, 7), (None, None, 1, 8), (None, 1, 2, 20), (None, 2, 2, 6)], key=repr)


def test_ci_trees():
    tree = ci_yaml.read("a: &x\n  b: 'c # d'  # e\nf: *x\ng:\n- h\n-  i: 1\n   j: {k: [l, \"m, n\"], o: p}\n- - q\n  - r\ns: |\n  t: u\n  - v\nw: >-\n  x\n\n  y\n?: bad\n--- \nz: 2\n")
    assert tree["a"] == {"b": "c # d"} and tree["f"] is tree["a"] and tree["g"] == ["h", {"i": "1", "j": {"k": ["l", "m, n"], "o": "p"}}, ["q", "r"]]
    assert tree["s"] == "t: u\n- v" and tree["w"].split() == ["x", "y"] and tree.lines["g"] == 4
    assert ci_yaml.read("") is None and ci_yaml.read("# only") is None and ci_yaml.jobs_of("azure-pipelines.yml", "- x") == []
    loop = ci_yaml.jobs_of(".gitlab-ci.yml", ".a:\n  extends: .b\n.b:\n  extends: .a\njob:\n  extends: .a\n  script: x\n")
    assert [(j.name, j.n_steps) for j in loop] == [("job", 1)]


@pytest.mark.parametrize("text", ["- " * 20_000, "a:\n" * 20_000, "[" * 20_000, "{a: " * 20_000, "\n".join(" " * k + "a:" for k in range(2_000)), "\n".join("- " * k for k in range(300)), "a: &b\n  <<: *b\n", '"' * 5_000])
def test_broken_ci_files_are_read(text):
    for path in (".gitlab-ci.yml", "azure-pipelines.yml", ".github/workflows/a.yml"):
        ci_yaml.jobs_of(path, text)


def test_archives_are_read_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    entries = {f"d{k % 7}/f{k}.{'cs' if k % 3 else 'txt'}": bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for k in range(200)}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    (tmp_path / "big.zip").write_bytes(data.getvalue())
    df = archive_source.read_large_archives(spark, str(tmp_path), 4_000)
    assert df.rdd.getNumPartitions() > 5
    assert {r["path"]: bytes(r["content"]) for r in df.collect()} == entries
    some = archive_source.read_large_archives(spark, str(tmp_path / "big.zip"), 4_000).where(F.col("path").startswith("d1/") & F.col("path").endswith(".cs"))
    assert sorted(r["path"] for r in some.collect()) == sorted(p for p in entries if p.startswith("d1/") and p.endswith(".cs"))
    assert archive_source.read_large_archives(spark, str(tmp_path), content=False).where("content IS NOT NULL").count() == 0
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "y")
    (tmp_path / "none.zip").write_bytes(b"PK")
    found = {r["archive"]: r["problem"] for r in archive_source.read_large_archives(spark, str(tmp_path)).select("archive", "problem").distinct().collect()}
    assert found["big.zip"] is None and found["bad.zip"] and found["none.zip"]


def test_archives_beyond_the_limits_of_uploads(spark, tmp_path):
    names = [f"d/{k}.txt" for k in range(archive_source.MOST_ENTRIES + 5)]
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for n in names:
            z.writestr(n, n[::-1])
    assert [r["problem"] for r in archive_source.read_large_archives(spark, str(tmp_path)).collect()] == ["too many entries"]
    df = archive_source.read_large_archives(spark, str(tmp_path), 1, limited=False)
    assert 1 < df.rdd.getNumPartitions() <= archive_source.MOST_RANGES
    assert {r["path"]: bytes(r["content"]).decode() for r in df.collect()} == {n: n[::-1] for n in names}


def test_a_directory_of_more_entries_than_two_bytes_count(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for k in range(66_000):
            z.writestr(f"é{k}", "")
    reader = archive_source.ArchiveReader(str(tmp_path / "x.zip"), 1, True, *[float("inf")] * 3)
    parts = reader.partitions()
    assert [p for k in parts for b in reader.read(k) for p in b.column("path").to_pylist()] == [f"é{k}" for k in range(66_000)]
