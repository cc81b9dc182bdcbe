"""The architecture of a server-rendered web application, and which architecture diagram an analysis gets.

A fixed frame of requests, middleware, views and stores holds the controllers and view components that are there; what belonged to one sample
shop only (labels, an assumed component) is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import when_chain
from .layers import edge
from .ordered import first_per_key

#: Ids, names and kinds of the frame, by tier.
CLIENT, ROUTING, MIDDLEWARE, VIEWS, STATIC, SESSION, CONTEXT, STORE = "node-client-browser node-mvc-routing node-cookie-auth node-razor-views node-static-files node-session-store node-dbcontext node-database-sql".split()
FRAME = (
    (CLIENT, "HTTP Client / Browser", "gateway", 0), (ROUTING, "ASP.NET Core Routing", "gateway", 1), (MIDDLEWARE, "Cookie Auth & Middleware", "gateway", 1), (VIEWS, "Razor Views (.cshtml)", "component", 4), (STATIC, "Static Files (wwwroot)", "component", 4),
    (SESSION, "Session Store", "database", 5), (STORE, "SQL Server Database", "database", 6),
)
#: Edges within the frame, with whether they are confirmed.
FRAME_EDGES = ((CLIENT, ROUTING, "HTTP Request", False), (ROUTING, MIDDLEWARE, "Pipeline Auth", False), (VIEWS, CLIENT, "HTML Response", True), (STATIC, CLIENT, "CSS / JS / Images", True), (CONTEXT, STORE, "SQL / EF Core", True))
#: How many controllers lead to the views and to the data context.
MOST_VIEWED, MOST_STORED = 4, 5
NODE = ("analysis_id", "id", "name", "category", "tier", "rank")
LANGUAGE_STACKS = (("spring", ("Java", "Kotlin")), ("python", ("Python",)), ("go", ("Go",)), ("php", ("PHP",)))


def is_view(path: Column) -> Column:
    return path.endswith(".cshtml") | path.endswith(".razor") | path.contains("Views/") | path.contains("Areas/")


def diagram_kind(languages: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """analysis_id and kind: the first of spring, python, go, php by language, mvc by views, api by controllers, else universal.

    languages: analysis_id, language. files: analysis_id, path. symbols: analysis_id, name.
    """
    known = [F.bool_or(F.col("language").isin(*names)).alias(stack) for stack, names in LANGUAGE_STACKS]
    said = languages.groupBy("analysis_id").agg(*known)
    seen = files.groupBy("analysis_id").agg(F.bool_or(is_view(F.col("path"))).alias("views"))
    named = symbols.groupBy("analysis_id").agg(F.bool_or(F.col("name").endswith("ViewComponent")).alias("components"), F.bool_or(F.col("name").endswith("Controller")).alias("controllers"))
    met = seen.join(said, "analysis_id", "full").join(named, "analysis_id", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return met.select("analysis_id", when_chain([*((yes(s), s) for s, _ in LANGUAGE_STACKS), (yes("views") | yes("components"), "mvc"), (yes("controllers"), "api")], "universal").alias("kind"))


def mvc_architecture(symbols: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the analyses in roots (analysis_id). symbols: analysis_id, name, type, file_path."""
    classes = first_per_key(symbols.where("type = 'Class'").join(roots.select("analysis_id").distinct(), "analysis_id", "left_semi"), F.struct("analysis_id", F.lower("name")), ["name", "file_path"])
    order = Window.partitionBy("analysis_id").orderBy(F.desc("admin"), F.upper("name"), "name")
    inside = F.lower(F.coalesce("file_path", F.lit(""))).contains("areas/") | F.lower("name").contains("admin")
    controllers = classes.where(F.col("name").endswith("Controller")).withColumn("admin", inside).withColumn("rank", F.row_number().over(order)).withColumn("id", F.concat(F.lit("ctrl-"), F.lower("name")))
    plain = Window.partitionBy("analysis_id").orderBy(F.upper("name"), "name")
    components = classes.where(F.col("name").endswith("ViewComponent")).withColumn("rank", F.row_number().over(plain)).withColumn("id", F.concat(F.lit("vc-"), F.lower("name")))
    contexts = classes.where(F.col("name").endswith("Context")).groupBy("analysis_id").agg(F.min_by("name", F.struct(F.upper("name"), "name")).alias("context"))
    all_roots = roots.select("analysis_id").distinct()
    frame = [all_roots.select("analysis_id", F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(k).alias("category"), F.lit(t).alias("tier"), F.lit(1).alias("rank")) for i, n, k, t in FRAME]
    store = all_roots.join(contexts, "analysis_id", "left").select("analysis_id", F.lit(CONTEXT).alias("id"), F.concat(F.coalesce("context", F.lit("DbContext")), F.lit(" (EF Core)")).alias("name"), F.lit("database").alias("category"), F.lit(5).alias("tier"), F.lit(2).alias("rank"))
    shown = [df.select("analysis_id", "id", "name", F.lit(kind).alias("category"), F.lit(tier).alias("tier"), "rank") for df, kind, tier in ((controllers, "controller", 2), (components, "component", 3))]
    route = F.concat(F.lit("Route: /"), F.when(F.col("name") == "HomeController", "").otherwise(F.regexp_replace("name", "Controller", "")))
    cart = controllers.where(F.col("id").contains("cart")).groupBy("analysis_id").agg(F.min_by("id", "rank").alias("id"))
    edges = [edge(all_roots, F.lit(a), F.lit(b), label, sure) for a, b, label, sure in FRAME_EDGES] + [
        edge(controllers.where("admin"), F.lit(MIDDLEWARE), "id", "Route: /admin [Admin Role]", True), edge(controllers.where("NOT admin"), F.lit(ROUTING), "id", route, True),
        edge(controllers.where(F.col("rank") <= MOST_VIEWED), "id", F.lit(VIEWS), "Returns View(Model)", True), edge(components, "id", F.lit(VIEWS), "Renders in _Layout", True), edge(cart, "id", F.lit(SESSION), "Get / Set Session", True),
        edge(controllers.where(F.col("rank") <= MOST_STORED), "id", F.lit(CONTEXT), "Direct DbContext", True), edge(components, "id", F.lit(CONTEXT), "Queries Data", True),
    ]
    return reduce(DataFrame.unionByName, [*frame, store, *shown]).select(*NODE), reduce(DataFrame.unionByName, edges)
