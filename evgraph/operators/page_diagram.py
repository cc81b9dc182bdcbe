"""The map of a frontend: pages, components, hooks and the API they call, from files alone.

A page or component renders what its text names, by name or by path and inside longer words too; what nobody names hangs on the first page or component.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import any_of
from ..sources.files import settle
from .layers import edge, first
from .mentions import mentioned

#: Folders of pages, components and hooks, how many are shown, and words that show a call.
PAGES, COMPONENTS, HOOKS = ("page", "app pages", 15), ("comp", "components features", 16), ("hook", "hooks services api", 10)
COMPONENT_CALLS = "fetch( axios apiClient analysisGateway useQuery useMutation".split()
HOOK_CALLS = "fetch( axios apiClient analysisGateway useQuery apiRequest http".split()
API = "node-external-api"
NODE = ("analysis_id", "id", "name", "category", "tier", "rank")


def _files_below(files: DataFrame, layer: tuple[str, str, int]) -> DataFrame:
    """analysis_id, id, name, path and rank of the first files, by path, with one of the folders on their path; a second one of a name has its number in its id."""
    prefix, folders, most = layer
    inside = any_of([F.concat(F.lit("/"), "path").contains(f"/{f}/") for f in folders.split()])
    order = Window.partitionBy("analysis_id").orderBy(F.upper("path"), "path")
    shown = files.where(inside).select("analysis_id", "path").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    named = shown.withColumn("name", paths.stem(F.col("path")))
    same = F.row_number().over(Window.partitionBy("analysis_id", "name").orderBy("rank"))
    return named.withColumn("_same", same).select("analysis_id", F.concat_ws("-", F.lit(prefix), "name", F.when(F.col("_same") > 1, F.col("_same").cast("string"))).alias("id"), "name", "path", "rank")


def frontend_map(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). files: analysis_id, path, content."""
    pages, components, hooks = (settle(_files_below(files, layer), "pages-of") for layer in (PAGES, COMPONENTS, HOOKS))
    users = pages.unionByName(components)
    read = files.join(users.unionByName(hooks).select("analysis_id", "path").distinct(), ["analysis_id", "path"], "left_semi").select("analysis_id", "path", "content")
    named = components.unionByName(hooks).select("analysis_id", F.col("path").alias("target_path"), "name").distinct()
    hits = settle(mentioned(read, "path", "content", named, "target_path", {"name": F.col("name"), "path": F.col("target_path")}).select("analysis_id", "path", "target_path").distinct(), "page-mentions")

    def names(left: DataFrame, right: DataFrame) -> DataFrame:
        met = hits.join(left.select("analysis_id", "path", F.col("id").alias("l_id")), ["analysis_id", "path"]).join(right.select("analysis_id", F.col("path").alias("target_path"), F.col("id").alias("r_id")), ["analysis_id", "target_path"])
        return met.where(F.lower("path") != F.lower("target_path"))

    def calls(nodes: DataFrame, words: list[str]) -> DataFrame:
        return nodes.join(read.where(any_of([F.col("content").contains(w) for w in words])).select("analysis_id", "path"), ["analysis_id", "path"], "left_semi")

    # A page that is a component's file as well names itself no more than another does.
    renders, parts, uses = names(pages, components), names(components, components), names(components, hooks)
    callers = calls(components, COMPONENT_CALLS).unionByName(calls(hooks, HOOK_CALLS))
    shown = renders.unionByName(parts).select("analysis_id", F.col("r_id").alias("id")).distinct()
    unseen = components.join(shown, ["analysis_id", "id"], "left_anti").join(first(pages, "page"), "analysis_id")
    unused = hooks.join(uses.select("analysis_id", F.col("r_id").alias("id")).distinct(), ["analysis_id", "id"], "left_anti")
    unused = unused.join(first(components, "comp"), "analysis_id", "left").join(first(pages, "page"), "analysis_id", "left").withColumn("user", F.coalesce("comp", "page")).where("user IS NOT NULL")
    every = reduce(DataFrame.unionByName, (n.select("analysis_id", F.lit(k).alias("kind"), "id", "rank") for k, n in enumerate((hooks, components, pages))))
    silent = every.join(callers.select("analysis_id").distinct(), "analysis_id", "left_anti").groupBy("analysis_id").agg(F.min_by("id", F.struct("kind", "rank")).alias("id"))
    edges = [
        edge(renders, "l_id", "r_id", "Renders", True), edge(parts, "l_id", "r_id", "Sub-Component", True), edge(uses, "l_id", "r_id", "Uses Hook", True), edge(callers, "id", F.lit(API), "HTTP / REST", True),
        edge(unseen, "page", "id", "Page Component", False), edge(unused, "user", "id", "Uses Hook", False), edge(silent, "id", F.lit(API), "HTTP / REST", False),
    ]
    kinds = ((pages, "route", 0, "path"), (components, "component", 1, "name"), (hooks, "hook", 2, "name"))
    nodes = [n.select("analysis_id", "id", F.col(label).alias("name"), F.lit(kind).alias("category"), F.lit(tier).alias("tier"), "rank") for n, kind, tier, label in kinds]
    api = files.select("analysis_id").distinct().select("analysis_id", F.lit(API).alias("id"), F.lit("Backend / External API").alias("name"), F.lit("external_api").alias("category"), F.lit(3).alias("tier"), F.lit(1).alias("rank"))
    return reduce(DataFrame.unionByName, [*nodes, api]).select(*NODE), reduce(DataFrame.unionByName, edges).distinct()
