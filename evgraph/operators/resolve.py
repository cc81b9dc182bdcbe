"""Names to graph: alias table, edges with evidence, deduplication and the edge cap.

nodes: analysis_id, id, name, type, file_path, start_line, end_line, properties, seq.
edges: analysis_id, source_id, target_id, type, file_path, start_line, end_line, snippet, confidence, properties, seq.
Every lookup is an equi-join on (analysis_id, lower-case key); seq carries file, line and fact order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.files import settle
from .ordered import first_per_key

EXACT, HIGH, MEDIUM = 1.0, 0.85, 0.65
TYPE_KINDS = ("Class", "Interface", "Record", "Struct", "Enum")
NODE = "analysis_id string, id string, name string, type string, file_path string, start_line int, end_line int, properties map<string,string>, seq string"


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _seq(rank: int, path: Column, line: Column, n: Column) -> Column:
    """Order of a row: stage, file, line, fact; compared as text."""
    return F.concat_ws("|", F.lit(f"{rank:02d}"), F.upper(path), F.lpad(line.cast("string"), 8, "0"), F.lpad(n.cast("string"), 8, "0"))


def _node(df: DataFrame, node_id: Column, name: Column, kind: Column | str, seq: Column, path: Column | None = None, start: Column | None = None, end: Column | None = None, **properties: Column) -> DataFrame:
    pairs = [x for k, v in properties.items() for x in (F.lit(k), v)]
    return df.select(
        "analysis_id", node_id.alias("id"), name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (_none() if path is None else path).alias("file_path"),
        (_none("int") if start is None else start).alias("start_line"), (_none("int") if end is None else end).alias("end_line"),
        (F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None)).cast("map<string,string>").alias("properties"), seq.alias("seq"),
    )


def _edge(df: DataFrame, source: Column, target: Column, kind: Column | str, seq: Column, path: Column, start: Column, end: Column, snippet: Column, confidence: float, **properties: Column) -> DataFrame:
    pairs = [x for k, v in properties.items() for x in (F.lit(k), v)]
    return df.select(
        "analysis_id", source.alias("source_id"), target.alias("target_id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), path.alias("file_path"), start.alias("start_line"), end.alias("end_line"),
        snippet.alias("snippet"), F.lit(confidence).alias("confidence"), (F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None)).cast("map<string,string>").alias("properties"), seq.alias("seq"),
    )


def symbol_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), name)


def aliases(symbols: DataFrame) -> DataFrame:
    """analysis_id, path, key, id, is_type, seq: the names a symbol can be called by (id, name, container.name, with its namespace)."""
    one = F.col("name")
    inner = F.when(F.col("container").isNotNull(), F.concat_ws(".", "container", one))
    keys = F.array(F.col("id"), one, inner, F.when(F.col("namespace").isNotNull(), F.concat_ws(".", "namespace", one)), F.when(F.col("namespace").isNotNull() & inner.isNotNull(), F.concat_ws(".", F.col("namespace"), inner)))
    spread = symbols.select("analysis_id", "path", "id", F.col("kind").isin(*TYPE_KINDS).alias("is_type"), "seq", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
    return spread.withColumn("key", F.lower("key"))


def best_alias(table: DataFrame, by: list[str]) -> DataFrame:
    """One id a key: types before others, then the last; of those that tie the greatest id."""
    return table.groupBy(*by).agg(F.max(F.struct("is_type", "seq", "id")).alias("_best")).select(*by, "_best.id")


def settled_aliases(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best id of each key in a file and in the analysis, written once for all lookups."""
    table = aliases(symbols)
    local = best_alias(table, ["analysis_id", "path", "key"]).select(F.col("analysis_id").alias("_a"), F.col("path").alias("_p"), F.col("key").alias("_k"), F.col("id").alias("_local"))
    every = best_alias(table, ["analysis_id", "key"]).select(F.col("analysis_id").alias("_b"), F.col("key").alias("_m"), F.col("id").alias("_every"))
    return settle(local, "aliases-of-files"), settle(every, "aliases")


def look_up(df: DataFrame, key: Column, table: tuple[DataFrame, DataFrame], alias: str) -> DataFrame:
    """Adds the id of a key: of the same file first, else of the analysis."""
    local, every = table
    asked = df.withColumn("_key", F.lower(key))
    asked = asked.join(local, (asked["analysis_id"] == F.col("_a")) & (asked["path"] == F.col("_p")) & (F.col("_key") == F.col("_k")), "left")
    asked = asked.join(every, (asked["analysis_id"] == F.col("_b")) & (F.col("_key") == F.col("_m")), "left")
    return asked.withColumn(alias, F.coalesce("_local", "_every")).drop("_key", "_a", "_p", "_k", "_local", "_b", "_m", "_every")


def csharp(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of C# facts, with names resolved across files."""
    seq = _seq(20, F.col("path"), F.col("line"), F.col("seq"))
    facts = facts.withColumn("order", seq)
    symbols = facts.where("fact = 'symbol'").withColumn("id", symbol_id(F.col("kind"), F.col("name"))).select("analysis_id", "path", "kind", "name", "container", "namespace", "target", "detail", "line", "end_line", "id", F.col("order").alias("seq"))
    table = settled_aliases(symbols)
    at = (F.col("path"), F.col("line"), F.col("end_line"))
    nodes = [_node(symbols, F.col("id"), F.col("name"), F.col("kind"), F.col("seq"), *at, Namespace=F.col("namespace"), Container=F.col("container"), Modifiers=F.col("detail"))]
    sources = facts.select("analysis_id", "path").distinct()
    nodes.append(_node(sources, F.concat(F.lit("file:"), "path"), paths.file_name(F.col("path")), "File", F.concat(F.lit("19|"), F.upper("path")), F.col("path")))
    edges = []

    def edge(df: DataFrame, source: str, target: str, kind, confidence: float, text: Column, **properties: Column) -> None:
        good = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        edges.append(_edge(good, F.col(source), F.col(target), kind, F.col("order") if "order" in df.columns else F.col("seq"), *at, text, confidence, **properties))

    inside = look_up(symbols.where("container IS NOT NULL"), F.col("container"), table, "owner")
    edge(inside, "owner", "id", "Contains", EXACT, F.concat_ws(" ", F.lower("kind"), "name"))
    top = symbols.where("container IS NULL").withColumn("file", F.concat(F.lit("file:"), "path"))
    edge(top, "file", "id", "Contains", EXACT, F.concat_ws(" ", F.lower("kind"), "name"))
    pick = lambda name: facts.where(F.col("fact") == name)
    bases = look_up(look_up(pick("base"), F.col("name"), table, "s"), F.col("target"), table, "t")
    edge(bases, "s", "t", F.col("kind"), EXACT, F.concat_ws(" : ", "name", "target"))
    short = F.substring_index("name", ".", -1)
    called = look_up(look_up(pick("call"), F.col("name"), table, "s1").withColumn("_short", short), F.col("_short"), table, "s2").withColumn("s", F.coalesce("s1", "s2"))
    edge(look_up(called, F.col("target"), table, "t").where("s <> t"), "s", "t", "Calls", MEDIUM, F.col("detail"))
    depends = look_up(look_up(pick("dependency"), F.col("name"), table, "s"), F.col("target"), table, "t")
    edge(depends, "s", "t", "DependsOn", MEDIUM, F.concat_ws(" -> ", "name", "target"), Kind=F.col("kind"))
    route = F.concat(F.lit("endpoint:"), F.lower("kind"), F.lit(":"), F.col("name"))
    points = pick("endpoint").withColumn("id", route)
    nodes.append(_node(points, F.col("id"), F.concat_ws(" ", "kind", "name"), "Endpoint", F.col("order"), *at, HttpMethod=F.col("kind"), RouteTemplate=F.col("name"), HandlerSymbol=F.col("target")))
    handled = look_up(points.withColumn("_c", F.substring_index("target", ".", 1)), F.col("_c"), table, "c").withColumn("s", F.coalesce("c", F.concat(F.lit("file:"), "path")))
    edge(handled, "s", "id", "Exposes", EXACT, F.concat_ws(" ", "kind", "name"))
    entity = lambda name: F.concat(F.lit("entity:"), name)
    entities = pick("entity").withColumn("id", entity(F.col("name")))
    nodes.append(_node(entities, F.col("id"), F.col("name"), "DatabaseEntity", F.col("order"), *at, Table=F.col("target"), Keys=F.col("detail")))
    tabled = look_up(pick("dbset"), F.col("name"), table, "s").withColumn("t", entity(F.col("target")))
    nodes.append(_node(tabled, F.col("t"), F.col("target"), "DatabaseEntity", F.concat(F.lit("~"), F.col("order")), *at, Table=F.col("detail")))
    edge(tabled, "s", "t", "MapsTo", EXACT, F.concat_ws(" ", "target", "detail"))
    related = pick("relation").withColumn("s", entity(F.col("name")))
    # The dependent is named by a type or by a navigation, whose property tells the type.
    element = F.regexp_extract("target", r"(\w+)[\s>\[\]?]*$", 1)
    navigated = symbols.where("kind = 'Property'").groupBy(F.col("analysis_id").alias("_a"), F.lower("container").alias("_c"), F.lower("name").alias("_n")).agg(F.min_by(element, F.struct("seq", "target")).alias("_type"))
    related = related.join(navigated, (related["analysis_id"] == F.col("_a")) & (F.lower(related["name"]) == F.col("_c")) & (F.lower(related["target"]) == F.col("_n")), "left")
    edge(related.withColumn("t", entity(F.coalesce("_type", "target"))), "s", "t", "DependsOn", EXACT, F.concat_ws(" -> ", "name", "target"), Multiplicity=F.col("kind"), ForeignKey=F.col("detail"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def typescript(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of TypeScript and JavaScript facts."""
    facts = facts.withColumn("seq", _seq(30, F.col("path"), F.col("line"), F.lit(0)))
    at = (F.col("path"), F.col("line"), F.col("line"))
    file = F.concat(F.lit("file:"), "path")
    kind = F.when(F.col("kind") == "Type", "Struct").when(F.col("kind") == "Function", "Method").otherwise(F.col("kind"))
    symbols = facts.where("fact = 'symbol'").withColumn("node", kind).withColumn("id", symbol_id(F.col("node"), F.col("name")))
    imports, routes, calls = (facts.where(F.col("fact") == x) for x in ("import", "route", "call"))
    end = lambda df: df.withColumn("point", F.concat(F.lit("endpoint:"), F.lower("kind"), F.lit(":"), F.col("name")))
    routes, calls = end(routes), end(calls)
    sources = facts.select("analysis_id", "path").distinct()
    nodes = [
        _node(symbols, F.col("id"), F.col("name"), F.col("node"), F.col("seq"), *at, Exported=F.col("exported").cast("string")),
        _node(sources, file, paths.file_name(F.col("path")), "File", F.concat(F.lit("29|"), F.upper("path")), F.col("path")),
        _node(routes, F.col("point"), F.concat_ws(" ", "kind", "name"), "Endpoint", F.col("seq"), *at, HttpMethod=F.col("kind"), RouteTemplate=F.col("name"), HandlerSymbol=F.col("detail")),
        _node(calls, F.col("point"), F.concat_ws(" ", "kind", "name"), "Endpoint", F.concat(F.lit("~"), F.col("seq")), *at, HttpMethod=F.col("kind"), RouteTemplate=F.col("name")),
        _node(imports, F.concat(F.lit("module:"), "name"), F.col("name"), "Component", F.col("seq"), *at),
    ]
    components = symbols.where("node = 'Component'").select(F.col("analysis_id").alias("_a"), F.lower("name").alias("_n"), F.col("id").alias("_id")).dropDuplicates(["_a", "_n"])
    shown = routes.join(components, (routes["analysis_id"] == F.col("_a")) & (F.lower("detail") == F.col("_n")), "left").withColumn("s", F.coalesce("_id", file))
    holder = symbols.groupBy("analysis_id", "path", "line").agg(F.max("id").alias("_id")).withColumnsRenamed({"analysis_id": "_a", "path": "_p", "line": "_l"})
    called = calls.join(holder, (calls["analysis_id"] == F.col("_a")) & (calls["path"] == F.col("_p")) & (calls["line"] == F.col("_l")), "left").withColumn("s", F.coalesce("_id", file))
    edges = [
        _edge(symbols, file, F.col("id"), "Contains", F.col("seq"), *at, F.col("name"), EXACT),
        _edge(imports, file, F.concat(F.lit("module:"), "name"), "DependsOn", F.col("seq"), *at, F.col("name"), HIGH),
        _edge(shown, F.col("s"), F.col("point"), "Exposes", F.col("seq"), *at, F.concat_ws(" ", "kind", "name"), HIGH),
        _edge(called, F.col("s"), F.col("point"), "Calls", F.col("seq"), *at, F.concat_ws(" ", "kind", "name"), MEDIUM),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def manifests(projects: DataFrame, npm: DataFrame, csproj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of projects, their packages and references. projects: analysis_id, name, path, project_type."""
    own = projects.select(F.col("analysis_id").alias("_a"), F.col("path").alias("_p"), F.concat(F.lit("project:"), "name").alias("project"))
    packages = npm.select("analysis_id", "path", "line", "name", "version", F.lit("package").alias("kind"), F.col("seq").cast("int").alias("n")).unionByName(csproj.select("analysis_id", "path", "line", "name", "version", "kind", F.col("line").alias("n")))
    met = packages.join(own, (packages["analysis_id"] == F.col("_a")) & (packages["path"] == F.col("_p"))).withColumn("id", F.concat("kind", F.lit(":"), F.col("name"))).withColumn("seq", _seq(10, F.col("path"), F.col("line"), F.col("n")))
    roots = projects.select("analysis_id").distinct()
    repository = F.concat(F.lit("repo:"), "analysis_id")
    nodes = [
        _node(roots, repository, F.col("analysis_id"), "Repository", F.lit("00")),
        _node(projects, F.concat(F.lit("project:"), "name"), F.col("name"), "Project", F.concat(F.lit("01|"), F.upper("path")), F.col("path"), ProjectType=F.col("project_type")),
        _node(met.where("kind = 'package'"), F.col("id"), F.col("name"), "Component", F.col("seq"), F.col("path"), F.col("line"), F.col("line"), Version=F.col("version")),
    ]
    one = F.lit(1)
    edges = [
        _edge(projects, repository, F.concat(F.lit("project:"), "name"), "Contains", F.concat(F.lit("01|"), F.upper("path")), F.col("path"), one, one, F.col("name"), EXACT),
        _edge(met, F.col("project"), F.col("id"), "DependsOn", F.col("seq"), F.col("path"), F.col("line"), F.col("line"), F.concat_ws(" ", "name", "version"), EXACT, Version=F.col("version")),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def graph(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges, each once ignoring case: the first wins."""
    nodes = reduce(DataFrame.unionByName, (n for n, _ in parts))
    edges = reduce(DataFrame.unionByName, (e for _, e in parts))
    # A map can't be part of an ordering or a key; it is carried as entries.
    nodes = nodes.withColumn("properties", F.map_entries("properties"))
    edges = edges.withColumn("properties", F.map_entries("properties"))
    nodes = first_per_key(nodes, F.concat_ws("|", "analysis_id", F.lower("id")), ["seq"])
    edges = first_per_key(edges, F.concat_ws("|", F.col("analysis_id"), F.lower(F.concat_ws("->", "source_id", "type", "target_id"))), ["seq"])
    return nodes.withColumn("properties", F.map_from_entries("properties")), edges.withColumn("properties", F.map_from_entries("properties"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges one of whose ends is no node."""
    known = nodes.select("analysis_id", F.lower("id").alias("_id")).distinct()

    def lost(end: str) -> DataFrame:
        return edges.join(known, (edges["analysis_id"] == known["analysis_id"]) & (F.lower(end) == known["_id"]), "left_anti")

    return lost("source_id").unionByName(lost("target_id")).select("analysis_id", "source_id", "type", "target_id").distinct()
