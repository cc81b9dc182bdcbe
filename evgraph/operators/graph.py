"""Walks over edges: neighbours and the shortest path between two nodes, with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import release, settle
from .ordered import first_per_key


def neighbours(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """node, upstream and downstream: sorted distinct neighbours of every node with an edge."""
    both = edges.select(F.col(target).alias("node"), F.col(source).alias("up"), F.lit(None).cast("string").alias("down")).unionByName(
        edges.select(F.col(source).alias("node"), F.lit(None).cast("string").alias("up"), F.col(target).alias("down"))
    )
    return both.groupBy("node").agg(F.array_sort(F.collect_set("up")).alias("upstream"), F.array_sort(F.collect_set("down")).alias("downstream"))


def degrees(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    ends = edges.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(target, F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.lower("source_id") == node.lower())


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.lower("target_id") == node.lower())


def resolve_node(nodes: DataFrame, asked: str) -> str | None:
    """The id of the first node (seq) whose id or name is what is asked for, ignoring case."""
    low = F.lit(asked.lower())
    found = nodes.where((F.lower("id") == low) | (F.lower("name") == low)).agg(F.min(F.struct("seq", "id")).alias("x")).first()["x"]
    return None if found is None else found["id"]


def _level(nodes: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def _adjacent(level: DataFrame, both: DataFrame) -> DataFrame:
    return level.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct()


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[tuple[str, object]] | None:
    """(node, seq of the edge that leads to it) along a shortest undirected path, ignoring case; None if there is none.

    A frontier grows from either end, the smaller one next, until they share a node; a node's neighbours lie in its own level or the two beside it, so
    a new level is held against two levels only. Of all shortest paths it is the one that a breadth-first walk over the edges in their order finds:
    at each step the first edge (seq) that leads to a node on a shortest path. What the driver sees are counts and the path.
    """
    spark = edges.sparkSession
    ends = (start.lower(), goal.lower())
    e = edges.select(F.lower("source_id").alias("u"), F.lower("target_id").alias("v"), "seq").where("u <> v")
    if ends[0] == ends[1]:
        return [(ends[0], None)]
    both = settle(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "seq")), "path-edges")
    written = [both]

    def keep(df: DataFrame) -> DataFrame:
        written.append(settle(df, "path-level"))
        return written[-1]

    sides, sizes, met = ([_level([ends[0]], spark)], [_level([ends[1]], spark)]), [1, 1], False
    try:
        while not met:
            k = int(sizes[1] < sizes[0])
            own = sides[k]
            new = _adjacent(own[-1], both)
            for level in own[-2:]:
                new = new.join(level, "node", "left_anti")
            own.append(keep(new))
            sizes[k] = own[-1].count()
            if not sizes[k]:
                return None
            met = own[-1].join(sides[1 - k][-1], "node", "left_semi").limit(1).count() > 0
        # Nodes of the forward levels that lie on a shortest path, from the meeting level back; those of the backward levels all do.
        ahead = [keep(sides[0][-1].join(sides[1][-1], "node", "left_semi"))]
        for level in reversed(sides[0][1:-1]):
            ahead.insert(0, keep(_adjacent(ahead[0], both).join(level, "node", "left_semi")))
        ahead = (ahead if len(sides[0]) > 1 else []) + list(reversed(sides[1][:-1]))
        path: list[tuple[str, object]] = [(ends[0], None)]
        for level in ahead:
            hop = both.where(F.col("u") == path[-1][0]).join(level, F.col("v") == F.col("node")).agg(F.min(F.struct("seq", "v")).alias("x")).first()["x"]
            path.append((hop["v"], hop["seq"]))
        return path
    finally:
        release(*written)


def trace(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """step and node of a shortest undirected path from start to goal, ignoring case; both ends alone if there is none."""
    path = shortest_path(edges, start, goal)
    nodes = [n for n, _ in path] if path else [start, goal]
    return edges.sparkSession.createDataFrame(list(enumerate(nodes)), "step int, node string")


def trace_with_evidence(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> tuple[bool, DataFrame, DataFrame, DataFrame]:
    """(found, nodes, edges, evidence) of a path between two nodes named by id or name.

    nodes: id, name, seq and more. edges: source_id, target_id, seq, file_path, start_line, end_line, snippet and more. Nodes and edges come with
    their step; the evidence of the edges is given once, at its first step. No path: the two end nodes; an end that is no node: nothing.
    """
    spark = nodes.sparkSession
    ends = [resolve_node(nodes, asked) for asked in (start, goal)]
    path = None if None in ends else shortest_path(edges, *ends)
    on = list(enumerate(path or [])) if path else [] if None in ends else [(k, (n.lower(), None)) for k, n in enumerate(ends)]
    steps = spark.createDataFrame([(k, n) for k, (n, _) in on], "_step int, _node string")
    own = first_per_key(nodes, F.lower("id"), ["seq"])
    shown = own.join(F.broadcast(steps), F.lower("id") == F.col("_node")).select(F.col("_step").alias("step"), *nodes.columns)
    seq_type = edges.schema["seq"].dataType.simpleString()
    hops = [(k, a[0], *b) for k, (a, b) in enumerate(zip(path, path[1:], strict=False))] if path else []
    taken = spark.createDataFrame(hops, f"_step int, _from string, _to string, _seq {seq_type}")
    low = F.lower("source_id"), F.lower("target_id")
    same = (F.col("seq") == F.col("_seq")) & (((low[0] == F.col("_from")) & (low[1] == F.col("_to"))) | ((low[0] == F.col("_to")) & (low[1] == F.col("_from"))))
    met = edges.join(F.broadcast(taken), same).select(F.col("_step").alias("step"), *edges.columns)  # a row a hop, so the path bounds both broadcasts
    walked = first_per_key(met, F.col("step"), ["seq"])
    proof = ("file_path", "start_line", "end_line", "snippet")
    evidence = walked.where("file_path IS NOT NULL").groupBy(*proof).agg(F.min("step").alias("step")).select("step", *proof)
    return path is not None, shown, walked, evidence


def trace_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """step, source_id, target_id and the other columns of the edges between a path's neighbours, in either direction: of each pair the first (seq)."""
    low = path.select("step", F.lower("node").alias("node"))
    hops = low.join(low.select((F.col("step") - 1).alias("step"), F.col("node").alias("next")), "step")
    ends = F.least(F.lower("source_id"), F.lower("target_id")), F.greatest(F.lower("source_id"), F.lower("target_id"))
    met = edges.withColumns({"_a": ends[0], "_b": ends[1]}).join(F.broadcast(hops), (F.col("_a") == F.least("node", "next")) & (F.col("_b") == F.greatest("node", "next")))
    return first_per_key(met.select("step", *edges.columns), F.col("step"), ["seq"])
