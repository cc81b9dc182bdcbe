"""The architecture of a web API: client, controllers, services, repositories and database, layer by layer.

What a node calls is told by the strongest sign there is: its source text names the other or a recorded dependency leads there; else
a name that is alike; else whatever comes first. Each stage takes what the stages before it left over (an anti-join). Text and recorded
ids are searched by the automaton of mentions, for the names shown; alike names are compared among the few nodes that are shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import any_of
from ..sources.files import settle
from .layers import edge, first, first_like, side, stem
from .mentions import containing
from .ordered import first_per_key

#: Prefix of a layer's node ids, endings of its class names, how many are shown.
CONTROLLERS, SERVICES, REPOSITORIES = ("ctrl", ("Controller",), 16), ("svc", ("Service", "Manager", "Handler"), 16), ("repo", ("Repository", "Store", "Dao"), 10)
CLIENT, DATABASE = "node-client-request", "node-database-layer"
#: Words that show direct use of a data context.
CONTEXT_WORDS, FIELD_WORDS = ("DbContext", "DbSet"), ("_context",)
NODE = ("analysis_id", "id", "name", "category", "tier", "rank")


def _named(symbols: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    return symbols.where((F.col("type") == "Class") & any_of([F.col("name").endswith(e) for e in endings])).select("analysis_id", "name", "file_path")


def _layer(found: DataFrame, layer: tuple) -> tuple[DataFrame, DataFrame]:
    """(nodes shown, analysis_id and `more` of those not shown): names once ignoring case, in the order of names; one with a file goes before one without."""
    prefix, _, most = layer
    once = first_per_key(found.withColumn("_bare", F.col("file_path").isNull()), F.concat_ws("|", F.col("analysis_id"), F.lower("name")), ["_bare", "name", "file_path"])
    order = Window.partitionBy("analysis_id").orderBy(F.upper("name"), "name")
    ranked = once.withColumn("rank", F.row_number().over(order))
    shown = ranked.where(F.col("rank") <= most).select("analysis_id", F.concat(F.lit(f"{prefix}-"), F.lower("name")).alias("id"), "name", "file_path", "rank")
    return shown, once.groupBy("analysis_id").agg((F.count("*") - most).alias("more")).where("more > 0")


def has_database(symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """analysis_id of the analyses with a data context or an entity."""
    return symbols.where(F.col("name").endswith("DbContext")).select("analysis_id").unionByName(entities.select("analysis_id")).distinct()


def api_architecture(symbols: DataFrame, files: DataFrame, endpoints: DataFrame, dependencies: DataFrame, with_database: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). symbols: analysis_id, name, type, file_path. files: analysis_id, path, content. endpoints: analysis_id, controller. dependencies: analysis_id, source_id, target_id."""
    routed = endpoints.where("controller IS NOT NULL AND controller <> ''").select("analysis_id", F.col("controller").alias("name"), F.lit(None).cast("string").alias("file_path"))
    controllers, more_controllers = _layer(_named(symbols, CONTROLLERS[1]).unionByName(routed), CONTROLLERS)
    services, more_services = _layer(_named(symbols, SERVICES[1]), SERVICES)
    repositories, _ = _layer(_named(symbols, REPOSITORIES[1]), REPOSITORIES)
    # The nodes shown are read by every stage, so they are settled, as is what each stage finds: some ten rows an analysis.
    controllers, services, repositories = (settle(nodes, f"api-{name}") for nodes, name in ((controllers, "controllers"), (services, "services"), (repositories, "repositories")))
    callers, callees = controllers.unionByName(services), services.unionByName(repositories)

    # Signs: (analysis_id, path, name) by text; (analysis_id, from name, to name) by recorded ids, which are compared ignoring case.
    read = files.join(callers.select("analysis_id", F.col("file_path").alias("path")).distinct(), ["analysis_id", "path"], "left_semi")
    by_text = settle(containing(read, "path", "content", callees.select("analysis_id", "name"), "name"), "api-mentions")
    ids = dependencies.select("analysis_id", "source_id", "target_id").distinct()
    from_hits = containing(ids.select("analysis_id", "source_id").distinct(), "source_id", "source_id", callers.select("analysis_id", F.col("name").alias("l_name")), "l_name", ignore_case=True)
    to_hits = containing(ids.select("analysis_id", "target_id").distinct(), "target_id", "target_id", callees.select("analysis_id", F.col("name").alias("r_name")), "r_name", ignore_case=True)
    recorded = ids.join(from_hits, ["analysis_id", "source_id"]).join(to_hits, ["analysis_id", "target_id"]).select("analysis_id", "l_name", "r_name").distinct()
    recorded = settle(recorded, "api-recorded")
    uses = read.select("analysis_id", F.col("path").alias("l_file_path"), any_of([F.col("content").contains(w) for w in CONTEXT_WORDS]).alias("context"), any_of([F.col("content").contains(w) for w in FIELD_WORDS]).alias("field"))

    def direct(left: DataFrame, right: DataFrame, by_record: bool = True) -> DataFrame:
        a, b = side(left, "l"), side(right, "r")
        text = a.join(by_text.select("analysis_id", F.col("path").alias("l_file_path"), F.col("name").alias("r_name")), ["analysis_id", "l_file_path"]).join(b, ["analysis_id", "r_name"])
        found = text.select("analysis_id", "l_id", "r_id")
        if by_record:
            found = found.unionByName(recorded.join(a, ["analysis_id", "l_name"]).join(b, ["analysis_id", "r_name"]).select("analysis_id", "l_id", "r_id"))
        return found.distinct()

    c, s, r = ({m: side(nodes, m) for m in "lr"} for nodes in (controllers, services, repositories))
    database = with_database.select("analysis_id").distinct()
    roots = symbols.select("analysis_id").unionByName(endpoints.select("analysis_id")).distinct()

    calls = settle(direct(controllers, services), "api-calls")
    unserved = c["l"].join(calls, ["analysis_id", "l_id"], "left_anti")
    alike = F.lower("l_name").contains(stem("r_name", "Service")) | F.lower("r_name").contains(stem("l_name", "Controller"))
    guessed = settle(first_like(unserved, s["r"], alike).where("like_id IS NOT NULL").select("analysis_id", "l_id", F.col("like_id").alias("r_id")), "api-guessed")
    reached = calls.unionByName(guessed).select("analysis_id", F.col("r_id").alias("l_id")).distinct()
    idle = s["l"].join(reached, ["analysis_id", "l_id"], "left_anti")
    idle = first_like(idle, c["r"], F.col("r_id").contains(stem("l_name", "Service"))).join(first(controllers, "first_id"), "analysis_id", "left")

    queries = settle(direct(services, repositories), "api-queries")
    asked = queries.select("analysis_id", F.col("r_id").alias("l_id")).distinct()
    unasked = r["l"].join(asked, ["analysis_id", "l_id"], "left_anti")
    unasked = first_like(unasked, s["r"], F.col("r_id").contains(stem("l_name", "Repository", "Store"))).join(first(services, "first_id"), "analysis_id", "left")
    delegates = direct(services, services, by_record=False).where("l_id <> r_id")
    opened = lambda nodes, also: side(nodes, "l").join(uses, ["analysis_id", "l_file_path"]).join(database, "analysis_id", "left_semi").where(F.col("context") | (F.col("field") & F.lit(also)))
    nearest = F.coalesce("like_id", "first_id", F.lit(CLIENT))
    group = F.lit("group-controllers")
    edges = [
        edge(controllers, F.lit(CLIENT), "id", "HTTP Route", False), edge(more_controllers, F.lit(CLIENT), group, "", False), edge(calls, "l_id", "r_id", "Injects / Calls", True),
        edge(opened(controllers, False), "l_id", F.lit(DATABASE), "Direct EF Core", True), edge(guessed, "l_id", "r_id", "Estimated Injects", False), edge(idle, nearest, "l_id", "Service Call", False),
        edge(queries, "l_id", "r_id", "Accesses / Queries", True), edge(opened(services, True), "l_id", F.lit(DATABASE), "EF Core / DbContext", True), edge(delegates, "l_id", "r_id", "Delegates", True),
        edge(unasked, nearest, "l_id", "Accesses", False), edge(repositories.join(database, "analysis_id", "left_semi"), "id", F.lit(DATABASE), "SQL / EF Core", True),
    ]

    def fixed(df: DataFrame, node_id: str, name: Column, category: str, tier: int) -> DataFrame:
        return df.select("analysis_id", F.lit(node_id).alias("id"), name.alias("name"), F.lit(category).alias("category"), F.lit(tier).alias("tier"), F.lit(1).alias("rank"))

    layers = [nodes.select("analysis_id", "id", "name", F.lit(kind).alias("category"), F.lit(tier).alias("tier"), "rank") for nodes, kind, tier in ((controllers, "controller", 1), (services, "service", 2), (repositories, "repository", 3))]
    rest = lambda noun: F.concat(F.lit("+"), F.col("more").cast("string"), F.lit(f" {noun}"))
    extra = [
        fixed(roots, CLIENT, F.lit("HTTP Client / Request"), "gateway", 0), fixed(more_controllers, "group-controllers", rest("controllers"), "group", 1), fixed(more_services, "group-services", rest("services"), "group", 2),
        fixed(database, DATABASE, F.lit("Database"), "database", 4),
    ]
    return reduce(DataFrame.unionByName, [*layers, *extra]).select(*NODE), reduce(DataFrame.unionByName, edges)
