"""What a repository's modules import: projects and key modules, external packages, and who uses which.

A package belongs to the first module whose source text names it, else to the first one of a kind that its name speaks of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rules import any_of, when_chain
from ..sources.files import settle
from .layers import edge, first_like, pick, side
from .mentions import mentioned
from .ordered import first_per_key

#: Endings of the modules of each kind, in order; how many are shown of a kind, of other types if there are none, and of packages.
KINDS = (("controller", ("Controller", "Route")), ("service", ("Service", "Handler", "Manager")), ("repository", ("Model", "Entity", "Repository", "Schema")))
MOST, MOST_OTHERS, MOST_PACKAGES = 6, 8, 10
#: Words of a package's name, in order, and of the modules that they lead to: kinds and words of names.
TOPICS = (("web", "express route api http"), ("data", "mongo sql db entityframework"), ("access", "auth jwt bcrypt security"))
LEADS = {"web": (("controller",), ()), "data": (("repository",), ("model",)), "access": (("service",), ("user", "auth")), "other": (("service",), ())}
CORE = "mod-core-app"
NODE = ("analysis_id", "id", "name", "category", "tier", "rank")


def _first_rows(df: DataFrame, most: int, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("analysis_id").orderBy(*order))).where(F.col("_n") <= most)


def modules(projects: DataFrame, symbols: DataFrame) -> DataFrame:
    """analysis_id, id, name, category, file_path and place: projects where there are several, then six of each kind by name, or eight of any type, or one for the whole."""
    several = projects.withColumn("_all", F.count("*").over(Window.partitionBy("analysis_id"))).where("_all > 1")
    shown = [several.select("analysis_id", F.concat(F.lit("proj-"), "id").alias("id"), "name", F.lit("project").alias("category"), F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("_kind"), F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.upper("name"), "id")).alias("_n"))]
    types = first_per_key(symbols.where(F.col("type").isin("Class", "Interface")), F.struct("analysis_id", F.lower("name")), ["name", "file_path"])
    own = (F.concat(F.lit("mod-"), F.lower("name")).alias("id"), "name")
    ends = lambda endings: any_of([F.col("name").endswith(e) for e in endings])
    for k, (kind, endings) in enumerate(KINDS):
        shown.append(_first_rows(types.where(ends(endings)), MOST, F.upper("name"), "name").select("analysis_id", *own, F.lit(kind).alias("category"), "file_path", F.lit(k + 1).alias("_kind"), "_n"))
    keyed = types.where(ends([e for _, endings in KINDS for e in endings])).select("analysis_id").distinct()
    others = _first_rows(types.join(keyed, "analysis_id", "left_anti"), MOST_OTHERS, F.upper("name"), "name")
    shown.append(others.select("analysis_id", *own, F.lit("service").alias("category"), "file_path", F.lit(2).alias("_kind"), "_n"))
    every = reduce(DataFrame.unionByName, shown)
    roots = projects.select("analysis_id").unionByName(symbols.select("analysis_id")).distinct()
    core = roots.join(every.select("analysis_id").distinct(), "analysis_id", "left_anti").select("analysis_id", F.lit(CORE).alias("id"), F.lit("Application").alias("name"), F.lit("project").alias("category"), F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("_kind"), F.lit(1).alias("_n"))
    order = Window.partitionBy("analysis_id").orderBy("_kind", "_n")
    return every.unionByName(core).withColumn("rank", F.row_number().over(order)).drop("_n")


def package_map(projects: DataFrame, symbols: DataFrame, files: DataFrame, packages: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). projects: analysis_id, id, name. symbols: analysis_id, name, type, file_path. files: analysis_id, path, content. packages: analysis_id, name, seq. dependencies: analysis_id, source_id, target_id, type."""
    inner = settle(modules(projects, symbols), "package-modules")
    once = first_per_key(packages, F.struct("analysis_id", F.lower("name")), ["seq"])
    package_id = F.concat(F.lit("pkg-"), F.replace(F.replace(F.lower("name"), F.lit("/"), F.lit("-")), F.lit("@"), F.lit("")))
    outer = settle(_first_rows(once, MOST_PACKAGES, "seq", "name").select("analysis_id", package_id.alias("id"), "name", F.col("_n").alias("rank")), "package-names")

    # Recorded dependencies between nodes that are shown, by id or, ignoring case, by name.
    known = inner.select("analysis_id", "id", "name").unionByName(outer.select("analysis_id", "id", "name"))
    keys = first_per_key(known.select("analysis_id", "id", F.explode(F.array(F.struct(F.lit(0).alias("how"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("how"), F.col("id").alias("key")))).alias("_x")).select("analysis_id", "id", "_x.how", "_x.key"), F.struct("analysis_id", "key"), ["how", "id"]).drop("how")

    def ends(df: DataFrame, end: str) -> DataFrame:
        for name, key in (("_by_name", F.lower(end)), ("_by_id", F.col(end))):
            df = df.withColumn("_key", key).join(keys.select("analysis_id", F.col("key").alias("_key"), F.col("id").alias(name)), ["analysis_id", "_key"], "left").drop("_key")
        return df.withColumn(f"_{end}", F.coalesce("_by_name", "_by_id")).drop("_by_name", "_by_id")

    recorded = ends(ends(dependencies, "source_id"), "target_id").where("_source_id IS NOT NULL AND _target_id IS NOT NULL AND _source_id <> _target_id")
    recorded = edge(recorded, "_source_id", "_target_id", F.col("type"), True).withColumn("_order", F.lit(0))

    # A package's module: by text, else by topic.
    read = files.join(inner.select("analysis_id", F.col("file_path").alias("path")).distinct(), ["analysis_id", "path"], "left_semi")
    hits = mentioned(read, "path", "content", outer, "name", {"name": F.col("name"), "last": F.substring_index("name", ".", -1)})
    by_text = hits.join(inner.select("analysis_id", F.col("file_path").alias("path"), F.col("id").alias("caller"), "rank"), ["analysis_id", "path"]).groupBy("analysis_id", "name").agg(F.min_by("caller", "rank").alias("caller"))
    low = F.lower("name")
    topic = when_chain([(any_of([low.contains(w) for w in words.split()]), t) for t, words in TOPICS], "other")
    leads = [
        inner.where(F.col("category").isin(*kinds) | any_of([F.lower("name").contains(w) for w in words] or [F.lit(False)])).groupBy("analysis_id").agg(F.min_by("id", "rank").alias("lead")).withColumn("topic", F.lit(t)) for t, (kinds, words) in LEADS.items()
    ]
    ranked = inner.groupBy("analysis_id").agg(F.min_by("id", "rank").alias("first"), F.max_by("id", "rank").alias("last"))
    left = outer.join(by_text, ["analysis_id", "name"], "left_anti").withColumn("topic", topic)
    guessed = left.join(reduce(DataFrame.unionByName, leads), ["analysis_id", "topic"], "left").join(ranked, "analysis_id")
    guessed = guessed.withColumn("caller", F.coalesce("lead", F.when(F.col("topic") == "data", F.col("last")).otherwise(F.col("first"))))
    found = outer.join(by_text, ["analysis_id", "name"]).select("analysis_id", "id", "caller").unionByName(guessed.select("analysis_id", "id", "caller"))
    imports = edge(found, "caller", "id", "imports", True).withColumn("_order", F.lit(1))

    # Controllers lead to a model or service of their name, else to one by hash.
    targets = inner.where(F.col("category").isin("repository", "service"))
    targets = targets.withColumn("rank", F.row_number().over(Window.partitionBy("analysis_id").orderBy("_kind", "rank")))
    bare = lambda c, *words: reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), words, F.lower(c))
    alike = bare("r_name", "model", "service").contains(bare("l_name", "controller", "route"))
    lead = first_like(side(inner.where("category = 'controller'"), "l"), side(targets, "r"), alike)
    counted = targets.groupBy("analysis_id").agg(F.max("rank").alias("_n"))
    dealt = lead.join(counted, "analysis_id").withColumn("rank", pick(F.col("l_id"), F.col("_n"))).join(targets.select("analysis_id", "rank", F.col("id").alias("_other")), ["analysis_id", "rank"])
    between = edge(dealt, "l_id", F.coalesce("like_id", "_other"), "references", True).withColumn("_order", F.lit(2))

    every = recorded.unionByName(imports).unionByName(between).where("source_id <> target_id")
    edges = first_per_key(every, F.struct("analysis_id", F.lower("source_id"), F.lower("target_id")), ["_order", "label"]).drop("_order")
    tier = F.when(F.col("category") == "project", 0).otherwise(1)
    nodes = inner.select("analysis_id", "id", "name", "category", tier.alias("tier"), "rank").unionByName(outer.select("analysis_id", "id", "name", F.lit("package").alias("category"), F.lit(2).alias("tier"), "rank"))
    return nodes.select(*NODE), edges
