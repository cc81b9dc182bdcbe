"""Mentions, running totals, paths and the API diagram against plain forms of themselves."""

import random
from collections import deque

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evgraph.operators import api_diagram, graph, mentions, ordered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mentions_meet_every_slice_and_pack(spark):
    rng = random.Random(1)
    names = ["".join(rng.choices("abIé<", k=rng.randint(1, 4))) for _ in range(60)]
    texts = [(f"g{k % 3}", k, "".join(rng.choices("abIé< ", k=rng.randint(0, 60)))) for k in range(80)] + [("g0", 900, None), (None, 901, "ab"), ("g9", 902, "ab"), ("g1", 3, "ab")]
    patterns = [(f"g{k % 3}", n) for k, n in enumerate(names)] + [("g0", ""), ("g0", None), ("g0", names[0])]
    t, p = spark.createDataFrame(texts, "g string, k long, t string"), spark.createDataFrame(patterns, "g string, p string")
    expected = sorted({(g, k, n) for g, k, x in texts for h, n in patterns if g is not None and g == h and n and x is not None and n in x}, key=repr)
    for most, chars in ((20_000, 16 << 20), (5, 200), (1, 1)):
        assert rows(mentions.containing(t, "k", "t", p, "p", "g", most=most, chars=chars)) == expected
    low = sorted({(g, k, n) for g, k, x in texts for h, n in patterns if g is not None and g == h and n and x is not None and n.lower() in x.lower()}, key=repr)
    assert rows(mentions.containing(t, "k", "t", p, "p", "g", ignore_case=True)) == low


def test_mentions_do_not_copy_the_text_for_each_pattern():
    names = pa.array([f"n{k}x" for k in range(500)])
    text = pa.table({"_g": ["g"], "_k": [1], "_t": [" ".join(names.to_pylist()) + " y" * 200_000]})  # copied for each, 200 MB
    before = pa.default_memory_pool().bytes_allocated()
    found = mentions.met((), text, pa.table({"_p": names, "_f": names}))
    assert found.num_rows == 500 and found.column_names == ["_g", "_k", "_p"]
    assert pa.default_memory_pool().max_memory() - before < 50 << 20


def test_forms_of_names(spark):
    t = spark.createDataFrame([("a", 1, "use IOrderService;"), ("a", 2, "<Cart/>"), ("a", 3, "nothing")], "analysis_id string, k long, t string")
    names = spark.createDataFrame([("a", "OrderService"), ("a", "Cart")], "analysis_id string, name string")
    forms = {"name": F.col("name"), "interface": F.concat(F.lit("I"), "name"), "tag": F.concat(F.lit("<"), "name")}
    assert rows(mentions.mentioned(t, "k", "t", names, "name", forms)) == [("a", 1, "OrderService", "interface"), ("a", 1, "OrderService", "name"), ("a", 2, "Cart", "name"), ("a", 2, "Cart", "tag")]


@pytest.mark.parametrize("grouped", [False, True])
def test_running_totals(spark, grouped):
    rng = random.Random(2)
    data = [(("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}") if rng.random() < 0.95 else None, rng.randrange(10_000), k, rng.randrange(9)) for k in range(700)]
    df = spark.createDataFrame(data, "g string, at long, id long, n long").repartition(7)
    group = ("g",) if grouped else ()
    got = ordered.running_totals(df, ["at", "id"], {"rank": F.lit(1), "total": F.col("n")}, group)
    seen, expected = {}, []
    for g, at, k, n in sorted(data, key=lambda r: (r[1], r[2])):
        rank, total = seen.get(g if grouped else 0, (0, 0))
        seen[g if grouped else 0] = (rank + 1, total + n)
        expected.append((g, at, k, n, rank + 1, total + n))
    assert rows(got) == sorted(expected, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[1 if grouped else 0]
    assert rows(ordered.running_totals(df.limit(0), ["at"], {"rank": F.lit(1)}, group)) == []


def test_ties_go_by_the_whole_row(spark):
    data = [(k % 20, 1, f"v{(k * 7919) % 997}", {"a": str(k % 13)}) for k in range(600)]
    df = spark.createDataFrame(data, "k long, seq int, v string, m map<string,string>")
    once = [rows(ordered.first_per_key(df.repartition(n), F.col("k"), ["seq"]).select("k", "v", F.col("m")["a"])) for n in (1, 5, 11)]
    assert once[0] == once[1] == once[2]
    assert [r[1] for r in once[0]] == [v for _, v in sorted((k, min(x[2] for x in data if x[0] == k)) for k in range(20))] or len(once[0]) == 20


def _walk(edges, start, goal):
    """The reference behaviour: breadth-first over the edges in their order, first parent wins."""
    seen, queue, back = {start}, deque([start]), {}
    while queue:
        at = queue.popleft()
        if at == goal:
            path = [at]
            while path[-1] in back:
                path.append(back[path[-1]])
            return path[::-1]
        for a, b, _ in edges:
            to = b if a == at else a if b == at else None
            if to is not None and to not in seen:
                seen.add(to)
                back[to] = at
                queue.append(to)
    return None


def test_paths_are_those_of_a_walk_in_edge_order(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", k) for k in range(22)] + [("x", "y", 100)]
    df = spark.createDataFrame(edges, "source_id string, target_id string, seq int")
    for start, goal in (("n0", "n1"), ("n2", "n13"), ("n5", "n5"), ("n3", "x"), ("n7", "n11")):
        found = graph.shortest_path(df, start.upper(), goal)
        assert (found and [n for n, _ in found]) == _walk(edges, start, goal)


def test_trace_gives_nodes_edges_and_each_evidence_once(spark):
    nodes = spark.createDataFrame([("A", "Start", 1), ("b", "Mid", 2), ("c", "End", 3), ("d", "Alone", 4), ("e", "End", 5)], "id string, name string, seq int")
    edges = spark.createDataFrame([("a", "B", 1, "f.cs", 1, 2, "x"), ("c", "b", 2, "f.cs", 1, 2, "x"), ("c", "b", 3, "g.cs", 1, 2, "y")], "source_id string, target_id string, seq int, file_path string, start_line int, end_line int, snippet string")
    found, on, walked, proof = graph.trace_with_evidence(nodes, edges, "START", "end")
    assert found and [r["id"] for r in on.orderBy("step").collect()] == ["A", "b", "c"]
    assert [r["seq"] for r in walked.orderBy("step").collect()] == [1, 2] and rows(proof) == [(0, "f.cs", 1, 2, "x")]
    found, on, walked, _ = graph.trace_with_evidence(nodes, edges, "a", "alone")
    assert not found and [r["id"] for r in on.orderBy("step").collect()] == ["A", "d"] and walked.count() == 0
    found, on, *_ = graph.trace_with_evidence(nodes, edges, "a", "nobody")
    assert not found and on.count() == 0


def test_api_layers_take_the_strongest_sign(spark):
    names = ["OrderController", "CartController", "MiscController", "OrderService", "CartManager", "LoneHandler", "OrderRepository", "LoneStore", "OddDao"]
    symbols = spark.createDataFrame([("a", n, "Class", f"src/{n}.cs") for n in names] + [("b", "OnlyService", "Class", "s.cs"), ("c", "AloneStore", "Class", "t.cs")], "analysis_id string, name string, type string, file_path string")
    text = {"OrderController": "IOrderService s; DbSet x", "OrderService": "var r = new OrderRepository(); _context.Go(); CartManager m"}
    files = spark.createDataFrame([("a", f"src/{n}.cs", text.get(n, "")) for n in names], "analysis_id string, path string, content string")
    endpoints = spark.createDataFrame([("a", "ordercontroller"), ("a", "PlainController"), ("a", None)], "analysis_id string, controller string")
    dependencies = spark.createDataFrame([("a", "class:misccontroller", "class:LONEHANDLER")], "analysis_id string, source_id string, target_id string")
    nodes, edges = api_diagram.api_architecture(symbols, files, endpoints, dependencies, spark.createDataFrame([("a",)], "analysis_id string"))
    ids = sorted(r["id"] for r in nodes.where("analysis_id = 'a'").collect())
    assert ids == sorted(["node-client-request", "node-database-layer", "ctrl-plaincontroller", *(f"ctrl-{n.lower()}" for n in names[:3]), *(f"svc-{n.lower()}" for n in names[3:6]), *(f"repo-{n.lower()}" for n in names[6:])])
    got = {(r["source_id"], r["target_id"], r["label"]) for r in edges.where("analysis_id = 'a'").collect()}
    assert ("ctrl-ordercontroller", "svc-orderservice", "Injects / Calls") in got and ("ctrl-misccontroller", "svc-lonehandler", "Injects / Calls") in got
    assert ("ctrl-cartcontroller", "svc-cartmanager", "Estimated Injects") in got and not any(t == "svc-cartmanager" and label == "Service Call" for _, t, label in got)
    assert ("svc-orderservice", "repo-orderrepository", "Accesses / Queries") in got and ("svc-lonehandler", "repo-lonestore", "Accesses") in got
    assert ("svc-cartmanager", "repo-odddao", "Accesses") in got and ("svc-orderservice", "svc-cartmanager", "Delegates") in got
    assert {("ctrl-ordercontroller", "node-database-layer", "Direct EF Core"), ("svc-orderservice", "node-database-layer", "EF Core / DbContext"), ("repo-odddao", "node-database-layer", "SQL / EF Core")} <= got
    other = {(r["source_id"], r["target_id"], r["label"]) for r in edges.where("analysis_id <> 'a'").collect()}
    assert other == {("node-client-request", "svc-onlyservice", "Service Call"), ("node-client-request", "repo-alonestore", "Accesses")}


def test_recall_of_cells(spark):
    from evgraph import diagram_queries, queries  # noqa: F401
    from evgraph.operators import ann

    got = queries.QUERIES["cosine_ivf_topk"](spark, "/root/testdata/sf0.001")
    exact = queries.QUERIES["cosine_matrix_topk"](spark, "/root/testdata/sf0.001")
    assert ann.recall(got, exact) >= 0.9


def test_query_blocks_are_bounded_whatever_the_ids(spark, monkeypatch):
    from evgraph.operators import retrieval

    rng = random.Random(8)
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(40)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [rng.random() for _ in range(4)]) for q in (1, 1, 1, 1, 2, 3, 3)], "query_id long, query array<double>")
    whole = rows(retrieval.top_k_each(vectors, asked, 3).select("query_id", F.round("distance", 9), "rank"))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 2)
    assert rows(retrieval.top_k_each(vectors, asked, 3).select("query_id", F.round("distance", 9), "rank")) == whole


def test_files_are_parsed_once_for_a_graph_and_by_many_tasks(spark, monkeypatch):
    from evgraph import fact_queries, queries  # noqa: F401
    from evgraph.operators import extract_cs

    made = []
    monkeypatch.setattr(extract_cs, "facts", lambda files, f=extract_cs.facts: made.append(f(files)) or made[-1])
    for name in ("graph_calls", "ef_edges"):
        edges = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "MapInArrow" not in edges._jdf.queryExecution().toString()
    assert all(df.rdd.getNumPartitions() > 4 for df in made)


def test_relations_are_made_of_shown_entities_only(spark, tmp_path):
    from evgraph import diagram_queries, queries  # noqa: F401

    spark.range(4000).selectExpr("id + 1 AS c_custkey", "CAST(0 AS BIGINT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.QUERIES["erd_diagram"](spark, str(tmp_path))
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString().split("source_k")[-1]
    first = sorted((f"E{k}" for k in range(1, 4001)))[:20]
    expected = {(f"e{x[1:]}", f"e{y[1:]}") for x in first for y in first if x < y and int(x[1:]) % 7 == int(y[1:]) % 7}
    assert {(r["source_id"], r["target_id"]) for r in found.collect()} == expected


def test_nearest_by_products_equal_the_plain_form(spark, monkeypatch):
    from evgraph.functions.vectors import cosine_distance
    from evgraph.operators import nearest, retrieval

    rng = random.Random(5)
    data = [(k, [rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(3)]) for k in range(300)] + [(900, [0.0] * 3), (901, [float("nan"), 1.0, 1.0]), (902, [1.0, None, 1.0]), (903, [float("inf"), 1.0, 1.0]), (904, None), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(data, "id long, embedding array<float>")
    asked = spark.createDataFrame([(k, [float(x or 0) for x in v]) for k, v in data[:40] + data[300:302]], "query_id long, query array<float>")
    plain = asked.crossJoin(vectors.where("embedding IS NOT NULL")).select("query_id", "id", cosine_distance(F.col("embedding"), F.col("query")).alias("d")).collect()
    of = {q: sorted(((r["d"], r["id"] is not None, r["id"]) for r in plain if r["query_id"] == q), key=lambda x: (x[0], x[1], x[2] or 0))[:4] for q in {r["query_id"] for r in plain}}
    expected = sorted(((q, i, n) for q, found in of.items() for n, (_, _, i) in enumerate(found, 1) if i not in (902,)), key=repr)
    for values, queries in ((4_000_000, 8192), (200, 7)):
        monkeypatch.setattr(retrieval, "VALUES", values)
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", queries)
        found = retrieval.top_k_each(vectors, asked, 4)
        assert rows(found.select("query_id", "id", "rank")) == expected
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    assert nearest.HITS > nearest.ROWS
