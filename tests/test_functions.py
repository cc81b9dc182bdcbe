"""Column functions and extractors on small inputs."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from evgraph.functions import ids, paths, scores, text, vectors
from evgraph.operators import chunks, extract_ci, extract_manifest, extract_ts, graph, grounding, intervals, ordered, retrieval, scan
from evgraph.operators.cs_parser import combine_routes, depended_on, parse, unwrap
from evgraph.sources import files as sources


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("secret", ["Server=a;Pwd=hunter2;", 'ApiKey = "abc123"', "Authorization: Bearer sk-proj-abcdefgh", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "sk-abcdefghijkl", "Uid=root;"])
def test_secrets_are_masked(spark, secret):
    masked = one(spark, text.mask_secrets(F.col("t")), t=f"before {secret} after")
    assert "***MASKED***" in masked and masked.startswith("before") and masked.endswith("after")
    for gone in ("hunter2", "abc123", "sk-", "RSA", "root"):
        assert gone not in masked


def test_guid_is_that_of_sha256(spark):
    assert one(spark, ids.guid(F.col("k")), k="file:j:a.cs") == str(uuid.UUID(bytes_le=hashlib.sha256(b"file:j:a.cs").digest()[:16]))
    assert one(spark, ids.evidence_id(F.lit(""), F.lit("a"), F.lit(1), F.lit(2), F.lit("k"), F.lit(None))) is None


@pytest.mark.parametrize(("a", "b", "distance"), [([1.0, 2.0], [1.0, 2.0], 0), ([1.0, 2.0], [2.0, 4.0], 0), ([1.0, 0.0], [0.0, 1.0], 1), ([1.0, 0.0], [-1.0, 0.0], 2), ([0.0, 0.0], [1.0, 0.0], 1)])
def test_cosine_distance(spark, a, b, distance):
    assert one(spark, vectors.cosine_distance(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(distance, abs=1e-9)


def test_unequal_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="one length"):
        one(spark, vectors.cosine_distance(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0])


def test_embedding(spark):
    v = one(spark, vectors.embed(F.col("t"), 64), t="hello")
    assert len(v) == 64 and v[:32] == v[32:] and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    assert set(one(spark, vectors.embed(F.col("t"), 8), t="  ")) == {0.0}


def test_paths(spark):
    assert one(spark, paths.ancestors(F.lit("a/b/c.cs"))) == ["", "a", "a/b"]
    assert one(spark, paths.stem(F.lit("a/b.c.cs"))) == "b.c"
    assert one(spark, paths.unsafe(F.lit("a/../b")))


def test_scores(spark):
    assert one(spark, scores.share(F.lit(1), F.lit(8), 1)) == 12.5
    assert one(spark, scores.progress(F.lit("Nothing"), F.lit(False))) == 10
    with pytest.raises(Exception, match="out of range"):
        one(spark, scores.confidence(F.lit(1.5)))


def test_sentences_and_references(spark):
    assert one(spark, text.sentences(F.lit("One. Two is `Foo`! three.\nFour"))) == ["One.", "Two is `Foo`! three.", "Four"]
    assert one(spark, text.file_references(F.lit("see src/A.csproj and package.json."))) == ["src/A.csproj", "package.json"]
    assert one(spark, text.identifiers(F.lit("`Foo` `class` `ab`"))) == ["Foo"]


def test_packing_lines(spark):
    got = one(spark, chunks.pack_lines(F.lit("aa\nbb\ncccccccccccc\nd"), F.lit(5), 5))
    assert [(p["content"], p["start_line"], p["end_line"]) for p in got] == [("aa\nbb", 5, 6), ("ccccc", 7, 7), ("ccccc", 7, 7), ("cc", 7, 7), ("d", 8, 8)]


def test_typescript_facts(spark):
    code = "import a from 'x'\n/* one\nfunction no() {}\n*/\n// const no2 = () => 1\nexport const Card = () => <div/>\nexport interface Shape {}\nrouter.post('/a', f)\nfetch('/b')\n<Route path=\"/c\" element={<Home/>} />\n"
    rows = extract_ts.facts(spark.createDataFrame([("j", "src/a.tsx", code), ("j", "b.mjs", code)], "analysis_id string, path string, content string")).collect()
    got = {(r["fact"], r["kind"], r["name"], r["line"]) for r in rows}
    assert got == {("import", "module", "x", 1), ("symbol", "Component", "Card", 6), ("symbol", "Interface", "Shape", 7), ("route", "POST", "/a", 8), ("call", "GET", "/b", 9), ("route", "GET", "/c", 10)}


def test_manifests(spark):
    rows = [("j", "package.json", '{\n "dependencies": {"B": "1"},\n "devDependencies": {"a": "2"}\n}'), ("j", "x/package.json", "{no"), ("j", "A.csproj", "<Project>\n<PackageReference Include='P' Version='1'/>\n</Project>"), ("j", "B.csproj", "<Project>")]
    df = spark.createDataFrame(rows, "analysis_id string, path string, content string")
    npm, bad = extract_manifest.npm(df)
    assert [(r["section"], r["name"], r["line"]) for r in npm.orderBy("seq").collect()] == [("dependencies", "B", 2), ("devDependencies", "a", 3)]
    assert [r["path"] for r in bad.collect()] == ["x/package.json"]
    assert [(r["kind"], r["name"], r["version"], r["line"]) for r in extract_manifest.csproj(df).collect()] == [("package", "P", "1", 2)]


def test_ci_jobs(spark):
    yaml = "name: X\non:\n  push:\njobs:\n  test:\n    runs-on: u\n    steps:\n      - run: a\n  ship:\n    needs:\n      - test\n    runs-on: u\n"
    rows = [("j", ".github/workflows/a.yml", yaml), ("j", "Jenkinsfile", "stage('Build') {}\nstage('Deploy') {}"), ("j", ".gitlab-ci.yml", "x: 1")]
    got = {(r["job"], tuple(r["needs"]), r["role"]) for r in extract_ci.jobs(spark.createDataFrame(rows, "analysis_id string, path string, content string")).collect()}
    assert got == {("test", (), "Test"), ("ship", ("test",), "Build"), ("Build", (), "Build"), ("Deploy", ("Build",), "Deploy"), ("build", (), "Build")}


def test_csharp_parser():
    assert unwrap("IReadOnlyList<Dictionary<string, Foo.Bar?>>") == "Bar" and depended_on("Task") is None and depended_on("OrderStatus") is None and depended_on("List<Order>") == "Order"
    assert combine_routes("api/[controller]", "{id}", "OrdersController") == "/api/Orders/{id}" and combine_routes(None, None, "X") == "/"
    facts = parse('var app = b.Build();\napp.MapGet("/hi", () => 1); // app.MapPost("/no")\n')
    assert [(f.kind, f.name, f.target) for f in facts if f.fact == "endpoint"] == [("GET", "/hi", "MinimalApi:MapGet")]
    facts = parse("class C : DbContext { void M(B b) { b.Entity<Order>().HasMany<Line>(x => x.Lines).WithOne(x => x.Order).HasForeignKey(x => x.OrderId); } }")
    assert [(f.kind, f.name, f.target) for f in facts if f.fact == "relation"] == [("OneToMany", "Order", "Line")]


@pytest.mark.parametrize("broken", ["", "class {", "}}}}", "class A : ", 'x"', "public class B { void M( ", "namespace", "[", "class C<T", "interface"])
def test_broken_csharp_is_read(broken):
    parse(broken)


def test_scan_limits(spark):
    rows = [(f"{c}.cs", 100, b"x") for c in "abcdef"] + [("big.cs", 900, b"x"), ("secrets/k.cs", 1, b"x"), (".env", 1, b"x"), ("a.g.cs", 1, b"x")]
    df = spark.createDataFrame([(p, s, bytearray(c)) for p, s, c in rows], "path string, size long, content binary")
    kept, errors = scan.sources(df, most_files=5, most_file=500, most_all=10_000)
    assert sorted(r["path"] for r in kept.collect()) == ["a.cs", "b.cs", "c.cs", "d.cs", "e.cs"]
    assert {r["path"] for r in errors.collect()} == {"big.cs", "f.cs"}
    kept, _ = scan.sources(df, most_file=500, most_all=250)
    assert kept.count() == 2


def test_scan_of_files_with_one_path(spark):
    rows = [("a.cs", 100, b"x"), ("a.cs", 900, b"y"), ("a.cs", 200, b"z"), ("b.cs", 300, b"p"), ("b.cs", 300, b"q"), ("b.cs", 300, b"r"), ("c.cs", 1, b"x")]
    df = spark.createDataFrame([(p, s, bytearray(c)) for p, s, c in rows], "path string, size long, content binary")
    kept, errors = scan.sources(df, most_file=500)
    assert sorted((r["path"], r["size"]) for r in kept.collect()) == sorted((p, s) for p, s, _ in rows if s <= 500)
    assert [r["path"] for r in errors.collect()] == ["a.cs"]
    kept, errors = scan.sources(df, most_files=4, most_file=500)
    assert sorted((r["path"], r["size"]) for r in kept.collect()) == [("a.cs", 100), ("a.cs", 200), ("b.cs", 300), ("b.cs", 300)]
    assert len({bytes(r["content"]) for r in kept.collect()}) == 4
    assert sorted(r["path"] for r in errors.collect()) == ["a.cs", "b.cs"]


def test_archives(spark, tmp_path):
    import io
    import zipfile

    def packed(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "text")
        return bytearray(out.getvalue())

    df = spark.createDataFrame([("good.zip", packed("a.cs", "b/c.cs")), ("bad.zip", packed("../x")), ("no.zip", bytearray(b"nothing"))], "path string, content binary")
    rows = sources.read_archives(df).collect()
    assert {r["path"] for r in rows if r["archive"] == "good.zip"} == {"a.cs", "b/c.cs"}
    assert all(r["problem"] for r in rows if r["archive"] != "good.zip")
    urls = spark.createDataFrame([("https://host/a/b",), ("ftp://host/a",), ("https://host/a;rm",), ("",)], "u string").select(sources.url_problem(F.col("u")).isNull().alias("ok"))
    assert [r["ok"] for r in urls.collect()] == [True, False, False, False]


def test_directory_source(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.cs").write_text("class X {}")
    assert [(r["path"], r["size"]) for r in sources.read_directory(spark, str(tmp_path)).collect()] == [("a/b.cs", 10)]


def test_trace_and_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("c", "b", 2), ("c", "d", 3), ("x", "y", 4)], "source_id string, target_id string, seq long")
    assert [r["node"] for r in graph.trace(edges, "A", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert [r["node"] for r in graph.trace(edges, "a", "y").orderBy("step").collect()] == ["a", "y"]
    assert {r["node"]: (r["upstream"], r["downstream"]) for r in graph.neighbours(edges).collect()}["b"] == (["a", "c"], [])


def test_prefix_and_intervals(spark):
    files = spark.createDataFrame([("src/A/x.cs",), ("SRC/a/b/y.cs",), ("z.cs",)], "path string")
    roots = spark.createDataFrame([("", "root"), ("src/a", "p")], "root string, name string")
    assert {r["path"]: r["name"] for r in intervals.longest_prefix(files, "path", roots, "root", ["name"]).collect()} == {"src/A/x.cs": "p", "SRC/a/b/y.cs": "p", "z.cs": "root"}
    left = spark.createDataFrame([(1, 0, 10), (1, 25, 30)], "k int, a int, b int")
    right = spark.createDataFrame([(1, 5, 27), (1, 11, 24), (2, 0, 99)], "k int, c int, d int")
    whole = {tuple(r) for r in intervals.overlapping(left, right, ["k"], "a", "b", "c", "d").collect()}
    assert whole == {tuple(r) for r in intervals.overlapping_by_bin(left, right, ["k"], "a", "b", "c", "d", 7).select("k", "a", "b", "c", "d").collect()} and len(whole) == 2


def test_first_wins(spark):
    df = spark.createDataFrame([("A", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert {tuple(r) for r in ordered.first_per_key_ci(df, [F.col("k")], ["n"]).collect()} == {("a", 1), ("b", 3)}
    assert {tuple(r) for r in ordered.overflow(df.withColumn("g", F.lit(1)), ["g"], "k", ["n"], 1).collect()} == {(1, "a", 1), (1, "+2 more", 2)}


def test_embedding_outcome(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, "bad")], "id long, content string").coalesce(1)

    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[0.5, 0.5]] * len(texts)

    assert retrieval.outcome(retrieval.populate(rows, provider, 2, size=1)).first()["status"] == "PartialFailure"
    assert retrieval.outcome(retrieval.populate(rows, lambda t: [[1.0]] * len(t), 2)).first()["status"] == "CompleteFailure"
    assert retrieval.outcome(retrieval.populate(rows.where("id = 2"), provider, 2)).first()["status"] == "NoEligibleChunks"


def test_answers(spark):
    answers = spark.createDataFrame([("a", "It is in src/x.cs. The `Foo` runs."), ("b", "Only `Bar` here."), ("c", "   "), ("d", "There is no relevant evidence.")], "answer_id string, answer string")
    known = spark.createDataFrame([("a", "lib/src/x.cs", "Foo", "class Foo", 0.9, 0.8), ("b", "y.cs", None, "nothing", 0.9, 0.8)], "answer_id string, file_path string, symbol string, content string, confidence double, similarity double")
    got = {r["answer_id"]: r for r in grounding.validate(answers, known).collect()}
    assert [got[k]["status"] for k in "abcd"] == ["FullySupported", "Unsupported", "InsufficientEvidence", "InsufficientEvidence"]
    assert got["a"]["level"] == "High" and got["b"]["final_answer"] == grounding.REFUSAL and got["d"]["final_answer"].startswith("There is")
    cited = spark.createDataFrame([("a", "x.cs", "Foo"), ("a", "z.cs", None)], "answer_id string, file_path string, symbol string")
    assert {r["file_path"]: r["verified"] for r in grounding.check_citations(cited, known).collect()} == {"x.cs": True, "z.cs": False}
    asked = answers.withColumn("question", F.when(F.col("answer_id") == "d", " ").otherwise("What?"))
    levels = {r["answer_id"]: (r["level"], r["score"]) for r in grounding.validate(asked, known).collect()}
    assert levels["a"][0] == "High" and levels["c"] == levels["d"] == ("Unknown", 0.0) and got["c"]["level"] == "Unknown"
