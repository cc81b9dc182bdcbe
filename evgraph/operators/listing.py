"""The query API: gates, filters, pages, details and lookups over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST = 50, 100
#: Names of a language and the path ending that also stands for it.
LANGUAGES = {"c#": ("cs", ("c#", "csharp", "cs")), "typescript": ("ts", ("typescript", "ts")), "javascript": ("js", ("javascript", "js"))}


class NotFound(LookupError):
    """No such analysis or row (404)."""


class NotReady(RuntimeError):
    """The analysis has not completed (409)."""


class AnalysisFailed(RuntimeError):
    """The analysis failed (409)."""


def ensure_completed(analyses: DataFrame, analysis_id: str) -> None:
    """One row is read: the status of the analysis."""
    row = analyses.where(F.col("id") == analysis_id).select("status").first()
    if row is None:
        raise NotFound(analysis_id)
    if row["status"] == "Failed":
        raise AnalysisFailed(analysis_id)
    if row["status"] != "Completed":
        raise NotReady(analysis_id)


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(1, page), min(max(size, 1), MOST)


def page_of(df: DataFrame, order: list, page: int = 1, size: int = PAGE) -> DataFrame:
    """One page in a total order: a top-k within each task, so nothing is sorted whole."""
    page, size = clamp_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_counts(df: DataFrame, page: int = 1, size: int = PAGE) -> DataFrame:
    page, size = clamp_page(page, size)
    return df.agg(F.count("*").alias("total_count")).select("total_count", F.lit(page).alias("page"), F.lit(size).alias("page_size"), F.ceil(F.col("total_count") / size).alias("total_pages"))


def has_text(column: str | Column, text: str | None) -> Column:
    """Contains, ignoring case; no text matches all."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lit(True) if not text else F.lower(c).contains(text.lower())


def of_language(language: Column, path: Column, wanted: str | None) -> Column:
    if not wanted:
        return F.lit(True)
    for ending, names in LANGUAGES.values():
        if wanted.lower() in names:
            return F.lower(language).isin(*names) | F.lower(path).endswith(f".{ending}")
    return (F.lower(language) == wanted.lower()) | F.lower(path).endswith(f".{wanted.lower()}")


def of_kind(column: str, wanted: str | None, known: tuple[str, ...]) -> Column:
    """A filter on an enumeration, ignoring case; a name that isn't one of it is ignored."""
    names = {k.lower(): k for k in known}
    return F.lit(True) if not wanted or wanted.lower() not in names else F.col(column) == names[wanted.lower()]


def in_direction(source: Column, target: Column, node: Column, direction: str) -> Column:
    if direction == "outbound":
        return source == node
    return target == node if direction == "inbound" else (source == node) | (target == node)


def with_names(df: DataFrame, ids: str, names: DataFrame, id_column: str, name_column: str, alias: str) -> DataFrame:
    """Adds a name by id; without one the id itself."""
    looked = names.select(F.col(id_column).alias("_id"), F.col(name_column).alias("_name"))
    return df.join(looked, F.col(ids) == F.col("_id"), "left").withColumn(alias, F.coalesce("_name", F.col(ids).cast("string"))).drop("_id", "_name")


def with_children(parents: DataFrame, children: DataFrame, on: Column, keys: list[str], fields: list[str], alias: str) -> DataFrame:
    """Parents with the list of their children, sorted by the children's fields; empty without any."""
    grouped = parents.join(children, on, "left").groupBy(*keys)
    child = F.struct(*fields)
    return grouped.agg(F.array_sort(F.collect_list(F.when(F.col(fields[0]).isNotNull(), child))).alias(alias))


def touching(edges: DataFrame, nodes: DataFrame, source: str, target: str, node: str) -> DataFrame:
    """Edges with each of their end nodes that is asked for: two equi-joins in place of one join with OR."""
    by_source = edges.join(nodes.select(F.col(node).alias("node")), F.col(source) == F.col("node"))
    by_target = edges.join(nodes.select(F.col(node).alias("node")), F.col(target) == F.col("node"))
    return by_source.unionByName(by_target).dropDuplicates()


def first_by_cascade(df: DataFrame, lookups: list[tuple[Column, DataFrame, str, str]], alias: str) -> DataFrame:
    """The first lookup (key, table, key column, value column) that has a value."""
    values = []
    for n, (key, table, key_column, value_column) in enumerate(lookups):
        side = table.select(F.col(key_column).alias(f"_k{n}"), F.col(value_column).alias(f"_v{n}"))
        df = df.join(side, key == F.col(f"_k{n}"), "left")
        values.append(f"_v{n}")
    return df.withColumn(alias, F.coalesce(*values)).drop(*(f"_{x}{n}" for n in range(len(lookups)) for x in "kv"))
