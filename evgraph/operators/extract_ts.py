"""Facts of TypeScript and JavaScript files, line by line, in built-in expressions.

Rows: analysis_id, path, line, fact, kind, name, detail, exported. fact is one of import, route, call, symbol.
Only the block-comment state looks beyond a line; it is a fold over a file's lines, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import lines

#: Objects whose methods are calls of an API, objects that take routes, and verbs.
CLIENTS, ROUTERS, VERBS = "axios|apiClient|api|http|client", "app|router", "get|post|put|delete|patch"

IMPORT = r"""^\s*import\b(?:.*?\bfrom\s*)?\s*['"]([^'"]+)['"]"""
REACT_ROUTE = r"""(?i)<Route\b[^>]*\bpath\s*=\s*\{?['"]([^'"]+)['"]"""
ROUTE_ELEMENT = r"(?i)\b(?:element\s*=\s*\{\s*<|component\s*=\s*\{\s*)([A-Za-z_]\w*)"
EXPRESS = rf"""(?i)\b(?:{ROUTERS})\.({VERBS})\s*\(\s*['"`]([^'"`]+)['"`]"""
CLIENT_CALL = rf"""(?i)\b(?:{CLIENTS})\.({VERBS})\s*(?:<[^>]*>)?\s*\(\s*['"`]([^'"`]+)['"`]"""
FETCH = r"""(?i)\bfetch\s*\(\s*['"`]([^'"`]+)['"`]"""
TYPE = r"^\s*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(interface|class|type|enum)\s+([A-Za-z_$][\w$]*)"
FUNCTION = r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*[(<]"
ARROW = r"^\s*(export\s+)?(?:default\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"
FACT = "struct<fact: string, kind: string, name: string, detail: string, exported: boolean>"


def code_lines(text: Column) -> Column:
    """Array of (no, line) without comment lines. A line that opens a block is skipped, and so is the one that closes it.

    The fold keeps a letter a line (i: in a block or the one that opens or closes it), not the lines.
    """

    def step(state: Column, line: Column) -> Column:
        opens, closes = F.ltrim(line).startswith("/*"), line.contains("*/")
        inside = F.when(state["inside"], ~closes).otherwise(opens & ~closes)
        return F.struct(inside.alias("inside"), F.concat(state["marks"], F.when(state["inside"] | opens, "i").otherwise("-")).alias("marks"))

    marks = F.split(F.aggregate(lines(text), F.struct(F.lit(False).alias("inside"), F.lit("").alias("marks")), step, lambda s: s["marks"]), "")
    numbered = F.transform(lines(text), lambda line, i: F.struct((i + 1).cast("int").alias("no"), line.alias("line")))
    marked = F.zip_with(numbered, marks, lambda x, m: F.struct(x["no"].alias("no"), x["line"].alias("line"), m.alias("mark")))
    kept = F.filter(marked, lambda x: (x["mark"] == "-") & ~F.ltrim(x["line"]).startswith("//"))
    return F.transform(kept, lambda x: F.struct(x["no"].alias("no"), x["line"].alias("line")))


def _fact(fact: str, kind: Column | str, name: Column, detail: Column | None = None, exported: Column | None = None) -> Column:
    return F.struct(
        F.lit(fact).alias("fact"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        name.alias("name"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
        (F.lit(None).cast("boolean") if exported is None else exported).alias("exported"),
    )


def _line_facts(line: Column, path: Column) -> Column:
    get = lambda pattern, group=1: F.regexp_extract(line, pattern, group)
    has = lambda pattern: line.rlike(pattern)
    jsx = paths.extension(path).isin("tsx", "jsx")
    kind_of = lambda name: F.when(jsx & name.rlike("^[A-Z]"), "Component").otherwise("Function")
    none = F.lit(None).cast(FACT)
    react = F.when(has(REACT_ROUTE), _fact("route", F.lit("GET"), get(REACT_ROUTE), F.nullif(get(ROUTE_ELEMENT), F.lit(""))))
    express = F.when(has(EXPRESS), _fact("route", F.upper(get(EXPRESS)), get(EXPRESS, 2), F.concat(paths.stem(path), F.lit("."), F.upper(get(EXPRESS)))))
    call = F.when(has(CLIENT_CALL), _fact("call", F.upper(get(CLIENT_CALL)), get(CLIENT_CALL, 2))).when(has(FETCH), _fact("call", "GET", get(FETCH)))
    declared = F.when(has(TYPE), _fact("symbol", F.initcap(get(TYPE, 2)), get(TYPE, 3), None, get(TYPE, 1) != ""))
    function = F.when(has(FUNCTION), _fact("symbol", kind_of(get(FUNCTION, 2)), get(FUNCTION, 2), None, get(FUNCTION) != ""))
    arrow = F.when(has(ARROW), _fact("symbol", kind_of(get(ARROW, 2)), get(ARROW, 2), None, get(ARROW) != ""))
    symbol = F.coalesce(declared, function, arrow, none)
    found = F.array(F.coalesce(react, none), F.coalesce(express, none), F.coalesce(call, none), symbol)
    return F.when(has(IMPORT), F.array(_fact("import", "module", get(IMPORT)))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def facts(files: DataFrame) -> DataFrame:
    """files: analysis_id, path, content. .mjs and .cjs files have no facts."""
    chosen = files.where(paths.extension(F.col("path")).isin("ts", "tsx", "js", "jsx"))
    spread = chosen.select("analysis_id", "path", F.explode(code_lines(F.col("content"))).alias("l"))
    found = spread.select("analysis_id", "path", F.col("l.no").alias("line"), F.explode(_line_facts(F.col("l.line"), F.col("path"))).alias("f"))
    return found.select("analysis_id", "path", "line", "f.*")
