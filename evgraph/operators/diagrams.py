"""Diagrams and architecture graphs: nodes and edges per analysis, by joins with explicit orders and caps.

nodes: analysis_id, id, name, category, tier, rank. edges: analysis_id, source_id, target_id, label, state (confirmed or inferred).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import paths
from ..functions.text import slug
from ..rules import any_of, when_chain
from .api_diagram import api_architecture, has_database
from .graph import neighbours
from .mvc_diagram import diagram_kind, mvc_architecture
from .ordered import first_per_key_ci, overflow
from .page_diagram import frontend_map

#: Endings of symbol names that make architecture nodes, and words of front and back projects.
SUFFIXES = "Service Repository Handler Manager Client Controller Model VM Guard Strategy Policy".split()
EXCLUDED = ("AppService", "AppController")
FRONT, BACK = "ui front client web".split(), "api back server app".split()
#: Lanes by words of name and type, in order, and their icons.
LANES = (
    ("ui", "controller endpoint web ui frontend client"), ("policy", "guard strategy policy gate role"), ("data", "db database context repository entity prisma"),
    ("external", "external oauth google resend smtp redis kafka"),
)
#: Services outside, by a word of a symbol's name; the endings of symbols that guard, and names that call each other.
EXTERNAL = (("auth", "ext-google-oauth", "Google OAuth"), ("mail", "ext-email-provider", "Email Service (Resend/SMTP)"))
GUARDS, MODELS = ("Guard", "Strategy", "Policy"), ("Model", "VM")
PEERS = {"auth": ("authservice",), "user": ("usersservice", "userservice"), "mail": ("mailservice", "emailservice")}
PEER_CALLS = (("auth", "user", "Calls"), ("auth", "mail", "Dispatches Mail"), ("user", "mail", "Dispatches Mail"))
ICONS = {"ui": "window", "policy": "shield", "data": "db", "external": "cloud", "runtime": "code"}
NODE = ("analysis_id", "id", "name", "category", "tier", "rank")


def lane(name: Column) -> Column:
    low = F.lower(name)
    tests = [(any_of([low.contains(w) for w in words.split()]) & (F.lit(kind != "policy") | ~low.contains("service")), kind) for kind, words in LANES]
    return when_chain(tests, "runtime")


def icon(category: Column) -> Column:
    return when_chain([(category == k, v) for k, v in ICONS.items()], "grid")


def _capped(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))).where(F.col("rank") <= n)


def _as_nodes(df: DataFrame, node_id: Column, name: Column, category: str, tier: int, n: int) -> DataFrame:
    shown = df.select("analysis_id", node_id.alias("id"), name.alias("name"), F.lit(category).alias("category"), F.lit(tier).alias("tier")).distinct()
    return _capped(shown, n, [F.upper("name"), "id"]).select(*NODE)


def _edges(df: DataFrame, source: str, target: str, label: str, state: str = "inferred") -> DataFrame:
    return df.select("analysis_id", F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(label).alias("label"), F.lit(state).alias("state"))


def _once(edges: list[DataFrame]) -> DataFrame:
    """Edges once a pair, ignoring case: of the first list that has them."""
    every = reduce(DataFrame.unionByName, (e.withColumn("seq", F.lit(n)) for n, e in enumerate(edges)))
    return first_per_key_ci(every.where("source_id <> target_id"), [F.col("analysis_id"), F.col("source_id"), F.col("target_id")], ["seq", "label"]).drop("seq")


def architecture(nodes: DataFrame, edges: DataFrame, endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects, at most 12 controllers, 15 entities and 30 symbols by name, and how they are wired.

    nodes and edges are the graph's, endpoints the stored ones (analysis_id, controller).
    """
    kind = F.col("type")
    projects = _as_nodes(nodes.where(kind == "Project"), F.col("id"), F.col("name"), "project", 0, 1000)
    controllers = _as_nodes(endpoints.where("controller IS NOT NULL"), F.concat(F.lit("class:"), "controller"), F.col("controller"), "controller", 1, 12)
    named = any_of([F.col("name").endswith(s) for s in SUFFIXES]) & ~F.col("name").isin(*EXCLUDED) & ~F.col("name").endswith("Controller")
    symbols = _as_nodes(nodes.where(kind.isin("Class", "Interface") & named), F.col("id"), F.col("name"), "symbol", 2, 30)
    entities = _as_nodes(nodes.where(kind == "DatabaseEntity"), F.col("id"), F.col("name"), "entity", 3, 15)
    keyed = nodes.where(kind.isin("Class", "Interface") & named)
    external = [
        keyed.where(F.lower("name").contains(word)).select("analysis_id").distinct().select("analysis_id", F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit("external").alias("category"), F.lit(4).alias("tier"), F.lit(k + 2).alias("rank"))
        for k, (word, i, n) in enumerate(EXTERNAL)
    ]
    store = entities.select("analysis_id").distinct().select("analysis_id", F.lit("database").alias("id"), F.lit("Database").alias("name"), F.lit("store").alias("category"), F.lit(4).alias("tier"), F.lit(1).alias("rank"))
    every = reduce(DataFrame.unionByName, (projects, controllers, symbols, entities, store, *external))
    every = first_per_key_ci(every, [F.col("analysis_id"), F.col("id")], ["tier", "rank"])
    low = F.lower("name")
    front = projects.where(any_of([low.contains(w) for w in FRONT])).select("analysis_id", F.col("id").alias("f"))
    back = projects.where(any_of([low.contains(w) for w in BACK]) & ~any_of([low.contains(w) for w in FRONT])).select("analysis_id", F.col("id").alias("b"))
    host = back.groupBy("analysis_id").agg(F.min("b").alias("h"))
    requests = front.join(back, "analysis_id")
    hosted = controllers.join(host, "analysis_id")
    # A controller's stem or a symbol's that holds the other: both are cut to their stems, so the join stays within an analysis's few nodes.
    c = controllers.select("analysis_id", F.col("id").alias("c"), F.lower(F.regexp_replace("name", "Controller$", "")).alias("cs"), F.col("rank").alias("cr"))
    s = symbols.select("analysis_id", F.col("id").alias("s"), F.lower(F.regexp_replace(F.regexp_replace("name", "^I(?=[A-Z])", ""), "(" + "|".join(SUFFIXES) + ")$", "")).alias("ss"), F.col("rank").alias("sr"), F.col("name").alias("sn"))
    guarding = any_of([F.col("sn").endswith(g) for g in GUARDS])
    acting = s.where(~guarding)
    matched = c.join(acting, "analysis_id").where((F.length("ss") > 0) & (F.col("cs").contains(F.col("ss")) | F.col("ss").contains(F.col("cs"))))
    best = matched.groupBy("analysis_id", "c").agg(F.min_by("s", "sr").alias("s"))
    first = acting.groupBy("analysis_id").agg(F.min_by("s", "sr").alias("s"))
    fallback = c.join(best, ["analysis_id", "c"], "left_anti").join(first, "analysis_id")
    guarded = c.where("cr <= 4").join(s.where(guarding).select("analysis_id", F.col("s").alias("g")), "analysis_id")
    sent = best.unionByName(fallback.select(*best.columns)).join(s.select("analysis_id", "s", "sn"), ["analysis_id", "s"])
    modelled = any_of([F.col("sn").endswith(m) for m in MODELS])
    peers = {name: s.where(F.lower("sn").isin(*names)).groupBy("analysis_id").agg(F.min_by("s", "sr").alias(name)) for name, names in PEERS.items()}
    between = [_edges(peers[x].join(peers[y], "analysis_id"), x, y, label) for x, y, label in PEER_CALLS]
    for peer, (_, i, _), label in zip(("auth", "mail"), EXTERNAL, ("Verifies Token", "Sends Mail"), strict=True):
        between.append(_edges(peers[peer].withColumn("_x", F.lit(i)), peer, "_x", label))
    e = entities.select("analysis_id", F.col("id").alias("e"), F.lower("name").alias("es"), F.col("rank").alias("er"))
    near = s.join(e, "analysis_id").where((F.length("ss") > 0) & (F.col("ss").contains(F.col("es")) | F.col("es").contains(F.col("ss"))))
    total = e.groupBy("analysis_id").agg(F.count("*").alias("n"))
    left = s.join(near.select("analysis_id", "s").distinct(), ["analysis_id", "s"], "left_anti").where(F.col("sn").endswith("Repository")).join(total, "analysis_id")
    turned = left.withColumn("er", (F.col("sr") - 1) % F.col("n") + 1).join(e.select("analysis_id", "e", "er"), ["analysis_id", "er"])
    known = every.select("analysis_id", F.lower("id").alias("_id"))
    recorded = edges.join(known, (edges["analysis_id"] == known["analysis_id"]) & (F.lower("source_id") == F.col("_id")), "left_semi")
    recorded = recorded.join(known, (recorded["analysis_id"] == known["analysis_id"]) & (F.lower("target_id") == F.col("_id")), "left_semi")
    wired = [
        _edges(requests, "f", "b", "API Requests"), _edges(hosted, "h", "id", "REST API"), _edges(sent.where(~modelled), "c", "s", "Dispatches"), _edges(sent.where(modelled), "c", "s", "Uses Model"), *between, _edges(guarded, "c", "g", "Guarded by"),
        _edges(near, "s", "e", "Persists"), _edges(turned, "s", "e", "Persists"), _edges(entities.withColumn("d", F.lit("database")), "id", "d", "Stored in"),
        recorded.select("analysis_id", "source_id", "target_id", F.col("type").alias("label"), F.when(F.col("file_path").isNotNull(), "confirmed").otherwise("inferred").alias("state")),
    ]
    return every.select(*NODE), _once(wired)


def tiers(files: DataFrame, stack: str) -> tuple[DataFrame, DataFrame]:
    """Gateways, then the files of three tiers by path words; each node calls those of the next tier that is there, the last ones the database."""
    caps = [n for _, n in rules.TIERS[stack]]
    found = files.select("analysis_id", "path").distinct().withColumn("tier", rules.tier(F.col("path"), stack)).where("tier IS NOT NULL")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("analysis_id", "tier").orderBy(F.upper("path"), "path")))
    kept = ranked.where(F.col("rank") <= when_chain([(F.col("tier") == n, c) for n, c in enumerate(caps)]))
    base = F.regexp_replace(slug(paths.stem(F.col("path"))), "[^a-z0-9-]", "-")
    same = F.row_number().over(Window.partitionBy("analysis_id", base).orderBy("tier", "rank"))
    shown = kept.select("analysis_id", F.when(same > 1, F.concat(base, F.lit("-"), same.cast("string"))).otherwise(base).alias("id"), paths.stem(F.col("path")).alias("name"), F.lit("file").alias("category"), (F.col("tier") + 2).alias("tier"), "rank")
    roots = files.select("analysis_id").distinct()
    extra = [roots.select("analysis_id", F.lit(f"gateway-{g}").alias("id"), F.lit(g).alias("name"), F.lit("gateway").alias("category"), F.lit(n).alias("tier"), F.lit(1).alias("rank")) for n, g in enumerate(rules.GATEWAYS[stack])]
    extra.append(roots.select("analysis_id", F.lit("database").alias("id"), F.lit("Database").alias("name"), F.lit("store").alias("category"), F.lit(5).alias("tier"), F.lit(1).alias("rank")))
    every = reduce(DataFrame.unionByName, [shown, *extra])
    steps = every.select("analysis_id", "tier").distinct().withColumn("next", F.lead("tier").over(Window.partitionBy("analysis_id").orderBy("tier")))
    a = every.select("analysis_id", "tier", F.col("id").alias("source_id"), F.col("rank").alias("ar")).join(steps, ["analysis_id", "tier"])
    b = every.select("analysis_id", F.col("tier").alias("next"), F.col("id").alias("target_id"), F.col("rank").alias("br"))
    wide = every.groupBy("analysis_id", F.col("tier").alias("next")).agg(F.max("rank").alias("bn"))
    met = a.join(b, ["analysis_id", "next"]).join(wide, ["analysis_id", "next"])
    pair = F.when(F.col("tier") < 2, True).when(F.col("next") == 5, F.col("ar") <= 3).otherwise((F.col("ar") - 1) % F.col("bn") + 1 == F.col("br"))
    return every, met.where(pair).select("analysis_id", "source_id", "target_id", F.when(F.col("next") == 5, "queries").otherwise("calls").alias("label"), F.lit("inferred").alias("state"))


def endpoint_groups(endpoints: DataFrame, groups: int = 8, each: int = 4) -> DataFrame:
    """analysis_id, controller, method, route: the first groups by name, and of each the first endpoints by route."""
    named = endpoints.withColumn("controller", F.coalesce("controller", F.lit("Api")))
    rank = F.dense_rank().over(Window.partitionBy("analysis_id").orderBy(F.upper("controller")))
    within = F.row_number().over(Window.partitionBy("analysis_id", "controller").orderBy("route", "method"))
    return named.withColumn("_g", rank).withColumn("_n", within).where((F.col("_g") <= groups) & (F.col("_n") <= each)).select("analysis_id", "controller", "method", "route")


def endpoints(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controllers and their grouped endpoints."""
    grouped = endpoint_groups(stored).withColumn("group", F.concat(F.lit("group:"), "controller")).withColumn("id", F.concat_ws(" ", "method", "route"))
    every = _as_nodes(grouped, F.col("group"), F.col("controller"), "controller", 0, 8).unionByName(_as_nodes(grouped, F.col("id"), F.col("id"), "endpoint", 1, 25))
    return every, _once([_edges(grouped, "group", "id", "exposes", "confirmed")])


def stack_of(languages: list[str], has_mvc: bool = False) -> str | None:
    """The tier table of a repository's languages; None for C#, which has facts of its own."""
    known = (("Java", "spring"), ("Kotlin", "spring"), ("Python", "python"), ("Go", "go"), ("PHP", "php"))
    found = next((stack for language, stack in known if language in languages), None)
    return found or (None if "C#" in languages or has_mvc else "universal")


def controller_summary(endpoints: DataFrame, groups: int = 12) -> DataFrame:
    """Endpoints of each controller: how many, and the first route with its method."""
    first = F.min_by(F.struct("route", "method"), F.struct("route", "method"))
    grouped = endpoints.where("controller IS NOT NULL").groupBy("analysis_id", "controller").agg(F.count("*").alias("n"), first.alias("first"))
    return _capped(grouped, groups, ["controller"]).select("analysis_id", "controller", "n", "first.route", "first.method")


def erd_entities(entities: DataFrame, n: int = 20) -> DataFrame:
    """The entities that a diagram shows: the first n of each analysis by name."""
    return _capped(entities, n, ["name", "id"]).select("analysis_id", "id", "name", F.lit("entity").alias("category"), F.lit(0).alias("tier"), "rank")


def erd(entities: DataFrame, relations: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    shown = erd_entities(entities, n)
    kept = relations.join(shown.select(F.col("id").alias("source_entity_id")), "source_entity_id", "left_semi").join(shown.select(F.col("id").alias("target_entity_id")), "target_entity_id", "left_semi")
    return shown, kept.select("analysis_id", F.col("source_entity_id").alias("source_id"), F.col("target_entity_id").alias("target_id"), F.col("relationship_type").alias("label"), F.when(F.col("evidence_id").isNotNull(), "confirmed").otherwise("inferred").alias("state"))


def monorepo(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    projects = _as_nodes(nodes.where("type = 'Project'"), F.col("id"), F.col("name"), "project", 0, 1000)
    references = edges.where(F.col("source_id").startswith("project:") & F.col("target_id").startswith("project:"))
    recorded = _edges(references, "source_id", "target_id", "references", "confirmed")
    none = projects.join(references.select("analysis_id").distinct(), "analysis_id", "left_anti")
    guess = none.groupBy("analysis_id").agg(F.min_by("id", "rank").alias("s"), F.max_by("id", "rank").alias("t"))
    return projects, _once([recorded, _edges(guess, "s", "t", "related")])


def hierarchy(nodes: DataFrame, edges: DataFrame, shown: int = 12) -> tuple[DataFrame, DataFrame]:
    """Types, the first by name, the rest as '+k more'; inheritance between them, or a chain in order if there is none."""
    types = _capped(nodes.where(F.col("type").isin("Class", "Interface", "Record", "Struct")).select("analysis_id", "id", "name", F.lit("type").alias("category"), F.lit(0).alias("tier")), 30, [F.upper("name"), "id"])
    more = overflow(types, ["analysis_id"], "id", ["rank"], shown).where("size > 1 OR label LIKE '+%'").select("analysis_id", F.lit("more").alias("id"), F.col("label").alias("name"), F.lit("group").alias("category"), F.lit(1).alias("tier"), F.lit(1).alias("rank"))
    kept = types.where(F.col("rank") <= shown)
    ids = kept.select("analysis_id", F.col("id").alias("_id"))
    real = edges.where(F.col("type").isin("Inherits", "Implements"))
    for end in ("source_id", "target_id"):
        real = real.join(ids, (real["analysis_id"] == ids["analysis_id"]) & (real[end] == ids["_id"]), "left_semi")
    bare = kept.join(real.select("analysis_id").distinct(), "analysis_id", "left_anti")
    chained = bare.withColumn("n", F.lead("id").over(Window.partitionBy("analysis_id").orderBy("rank"))).where("n IS NOT NULL")
    found = real.select("analysis_id", "source_id", "target_id", F.lower("type").alias("label"), F.lit("confirmed").alias("state"))
    return kept.select(*NODE).unionByName(more), _once([found, _edges(chained, "id", "n", "related")])


def call_flow(nodes: DataFrame, n: int = 8) -> tuple[DataFrame, DataFrame]:
    entry = nodes.select("analysis_id").distinct().select("analysis_id", F.lit("program").alias("id"), F.lit("Program.Main").alias("name"), F.lit("entry").alias("category"), F.lit(0).alias("tier"), F.lit(1).alias("rank"))
    commands = _as_nodes(nodes.where(F.col("type").isin("Class", "Method") & ~F.col("name").isin("Program", "Main")), F.col("id"), F.col("name"), "command", 1, n)
    return entry.unionByName(commands), _edges(commands.withColumn("s", F.lit("program")), "s", "id", "invokes")


def dependencies(nodes: DataFrame, edges: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Projects and their first packages by name, once ignoring case; a package no edge reaches hangs on a project chosen by hash."""
    modules = _as_nodes(nodes.where("type = 'Project'"), F.col("id"), F.col("name"), "module", 0, 1000)
    packages = first_per_key_ci(nodes.where(F.col("id").startswith("package:")).select("analysis_id", "id", "name", "seq"), [F.col("analysis_id"), F.col("name")], ["seq"])
    packages = _as_nodes(packages, F.col("id"), F.col("name"), "package", 1, n)
    ids = packages.select("analysis_id", F.lower("id").alias("_id"))
    recorded = edges.where("type = 'DependsOn'").join(ids, (edges["analysis_id"] == ids["analysis_id"]) & (F.lower("target_id") == F.col("_id")), "left_semi")
    free = packages.join(recorded.select("analysis_id", F.lower("target_id").alias("_t")).distinct(), (packages["analysis_id"] == recorded["analysis_id"]) & (F.lower("id") == F.col("_t")), "left_anti")
    count = modules.groupBy("analysis_id").agg(F.max("rank").alias("m"))
    hung = free.join(count, "analysis_id").withColumn("rank", F.pmod(F.xxhash64("name"), F.col("m")).cast("int") + 1).join(modules.select("analysis_id", "rank", F.col("id").alias("s")), ["analysis_id", "rank"])
    return modules.unionByName(packages), _once([_edges(recorded, "source_id", "target_id", "depends on", "confirmed"), _edges(hung, "s", "id", "depends on")])


def workflow(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triggers and jobs; 'needs' edges, or from the trigger for jobs that need nothing."""
    named = jobs.withColumn("id", F.concat_ws("/", "path", "job")).withColumn("start", F.concat(F.lit("trigger:"), "path"))
    starts = _as_nodes(named, F.col("start"), F.col("trigger"), "trigger", 0, 100)
    works = _as_nodes(named, F.col("id"), F.col("job"), "job", 1, 1000)
    needed = named.select("analysis_id", "path", "id", F.explode("needs").alias("n")).withColumn("s", F.concat_ws("/", "path", "n"))
    return starts.unionByName(works), _once([_edges(needed, "s", "id", "needs", "confirmed"), _edges(named.where(F.size("needs") == 0), "start", "id", "starts", "confirmed")])


def detail_cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the sorted names of what points at them and what they point at."""
    keyed = edges.select(F.concat_ws("|", "analysis_id", "source_id").alias("source_id"), F.concat_ws("|", "analysis_id", "target_id").alias("target_id"))
    near = neighbours(keyed)
    strip = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^[^|]*\|", ""))
    met = nodes.withColumn("_k", F.concat_ws("|", "analysis_id", "id")).join(near, F.col("_k") == F.col("node"), "left")
    return met.select(*nodes.columns, strip(F.col("upstream")).alias("upstream"), strip(F.col("downstream")).alias("downstream"))


def dispatch(kind: str, made: dict[str, DataFrame], stack: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The diagram of a kind from an analysis's tables; None where what it shows wasn't detected."""
    nodes, edges = made["nodes"], made["edges"]
    if kind == "architecture":
        if stack:
            return tiers(made["source_files"], stack)
        kind = diagram_kind(made["source_files"].select("analysis_id", "language"), made["source_files"], nodes).first()
        if kind is None or kind["kind"] not in ("mvc", "api"):
            return tiers(made["source_files"], kind["kind"] if kind else "universal")
        if kind["kind"] == "mvc":
            return mvc_architecture(nodes, made["source_files"])
        return api_architecture(nodes, made["files"], made["api_endpoints"], made["dependencies"], has_database(nodes, made["database_entities"]))
    if kind == "endpoints":
        return endpoints(made["api_endpoints"])
    if kind == "erd":
        return erd(made["database_entities"], made["database_relationships"]) if made["database_entities"].limit(1).count() else None
    if kind in ("route_map", "component_tree", "external_api"):
        return frontend_map(made["files"])
    if kind == "workflow":
        return workflow(made["ci_jobs"]) if made["ci_jobs"].limit(1).count() else None
    known = {"system_overview": lambda: monorepo(nodes, edges), "namespace_class": lambda: hierarchy(nodes, edges), "hierarchy": lambda: hierarchy(nodes, edges), "call_flow": lambda: call_flow(nodes), "dependencies": lambda: dependencies(nodes, edges)}
    if kind not in known:
        raise ValueError(f"no diagram {kind}")
    return known[kind]()
