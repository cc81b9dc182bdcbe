"""Queries of facts, graphs, chunks, answers and diagrams over files and rows made from the test tables, with independent SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import chunks, classify, diagrams, extract_cs, graph, grounding, mapper, resolve, scan
from .queries import _EDGES, _MASKED, place_edges, query, table
from .sources import files as sources

JOB = "job"


def text_of(*parts: str | Column) -> Column:
    """Text put together from literals and numbers."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# C# files: a controller for each supplier, an interface and a data context for each nation, routes of a program for each region


def controllers(spark, d) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    code = text_of(
        'namespace App;\n\n[ApiController]\n[Route("api/[controller]")]\npublic class S', s, "Controller : ControllerBase\n{\n    private readonly INation", n, " _nation", s, ";\n    public S", s, "Controller(INation", n, " nation) { }\n"
        '    [HttpGet("{id}")]\n    public object Find', s, "()\n    {\n        return _nation.Go", n, "();\n    }\n    [HttpPost]\n    public void Add", s, "() { _nation.Go", n, "(); }\n}\n",
    )
    return table(spark, d, "supplier").select(F.lit(JOB).alias("analysis_id"), text_of("src/S", s, "Controller.cs").alias("path"), code.alias("content"))


def interfaces(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.lit(JOB).alias("analysis_id"), text_of("src/INation", n, ".cs").alias("path"), text_of("namespace App;\npublic interface INation", n, "\n{\n    object Go", n, "();\n}\n").alias("content"))


def contexts(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    code = text_of(
        "namespace Data;\npublic class Ctx", n, " : DbContext\n{\n    public DbSet<Buyer", n, "> Buyers { get; set; }\n    public DbSet<Sale", n, "> Sales { get; set; }\n    protected override void OnModelCreating(ModelBuilder b)\n    {\n        b.Entity<Buyer", n,
        '>().HasMany(x => x.Purchases).WithOne(o => o.By).HasForeignKey(o => o.BuyerId);\n    }\n}\n[Table("buyers_', n, '")]\npublic class Buyer', n, "\n{\n    [Key] public int Code { get; set; }\n    public ICollection<Sale", n,
        "> Purchases { get; set; }\n}\npublic class Sale", n, "\n{\n    public int Id { get; set; }\n    public Buyer", n, " By { get; set; }\n}\n",
    )
    return table(spark, d, "nation").select(F.lit(JOB).alias("analysis_id"), text_of("data/Ctx", n, ".cs").alias("path"), code.alias("content"))


def programs(spark, d) -> DataFrame:
    r = F.col("r_regionkey")
    code = text_of("var app = builder.Build();\napp.MapGet(\"/r/", r, "/items\", () => 1);\napp.MapDelete(\"r", r, "/\", (int id) => id);\n")
    return table(spark, d, "region").select(F.lit(JOB).alias("analysis_id"), text_of("src/Program", r, ".cs").alias("path"), code.alias("content"))


@query("""
SELECT 'src/S' || s_suppkey || 'Controller.cs' AS path, 'Class' AS kind, 'S' || s_suppkey || 'Controller' AS name, '' AS container, 5 AS line, 16 AS end_line FROM supplier
UNION ALL SELECT 'src/S' || s_suppkey || 'Controller.cs', 'Field', '_nation' || s_suppkey, 'S' || s_suppkey || 'Controller', 7, 7 FROM supplier
UNION ALL SELECT 'src/S' || s_suppkey || 'Controller.cs', 'Method', 'S' || s_suppkey || 'Controller..ctor', 'S' || s_suppkey || 'Controller', 8, 8 FROM supplier
UNION ALL SELECT 'src/S' || s_suppkey || 'Controller.cs', 'Method', 'Find' || s_suppkey, 'S' || s_suppkey || 'Controller', 10, 13 FROM supplier
UNION ALL SELECT 'src/S' || s_suppkey || 'Controller.cs', 'Method', 'Add' || s_suppkey, 'S' || s_suppkey || 'Controller', 15, 15 FROM supplier
UNION ALL SELECT 'src/INation' || n_nationkey || '.cs', 'Interface', 'INation' || n_nationkey, '', 2, 5 FROM nation UNION ALL SELECT 'src/INation' || n_nationkey || '.cs', 'Method', 'Go' || n_nationkey, 'INation' || n_nationkey, 4, 4 FROM nation
""")
def csharp_symbols(spark, d):
    found = extract_cs.facts(controllers(spark, d).union(interfaces(spark, d))).where("fact = 'symbol'")
    return found.select("path", "kind", "name", F.coalesce("container", F.lit("")).alias("container"), "line", "end_line")


@query("""
SELECT 'GET' AS method, '/api/S' || s_suppkey || '/{id}' AS route, 'S' || s_suppkey || 'Controller.Find' || s_suppkey AS handler, 10 AS line FROM supplier
UNION ALL SELECT 'POST', '/api/S' || s_suppkey, 'S' || s_suppkey || 'Controller.Add' || s_suppkey, 15 FROM supplier
UNION ALL SELECT 'GET', '/r/' || r_regionkey || '/items', 'MinimalApi:MapGet', 2 FROM region UNION ALL SELECT 'DELETE', '/r' || r_regionkey, 'MinimalApi:MapDelete', 3 FROM region
""")
def csharp_endpoints(spark, d):
    found = extract_cs.facts(controllers(spark, d).union(programs(spark, d))).where("fact = 'endpoint'")
    return found.select(F.col("kind").alias("method"), F.col("name").alias("route"), F.col("target").alias("handler"), "line")


@query("""
SELECT 'S' || s_suppkey || 'Controller' AS name, 'field' AS kind, 'INation' || s_nationkey AS target, 7 AS line FROM supplier UNION ALL SELECT 'S' || s_suppkey || 'Controller', 'constructor', 'INation' || s_nationkey, 8 FROM supplier
""")
def csharp_dependencies(spark, d):
    return extract_cs.facts(controllers(spark, d)).where("fact = 'dependency'").select("name", "kind", "target", "line")


@query("""
SELECT 'context' AS fact, 'Ctx' || n_nationkey AS name, '' AS target, '' AS detail FROM nation UNION ALL SELECT 'dbset', 'Ctx' || n_nationkey, 'Buyer' || n_nationkey, 'Buyers' FROM nation UNION ALL SELECT 'dbset', 'Ctx' || n_nationkey, 'Sale' || n_nationkey, 'Sales' FROM nation
UNION ALL SELECT 'entity', 'Buyer' || n_nationkey, 'buyers_' || n_nationkey, 'Code' FROM nation UNION ALL SELECT 'entity', 'Sale' || n_nationkey, 'Sale' || n_nationkey, 'Id' FROM nation
UNION ALL SELECT 'relation', 'Buyer' || n_nationkey, 'Purchases', 'BuyerId' FROM nation
""")
def ef_model(spark, d):
    found = extract_cs.facts(contexts(spark, d)).where("fact IN ('context', 'dbset', 'entity', 'relation')")
    return found.select("fact", "name", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("detail", F.lit("")).alias("detail"))


@query("""
SELECT 'MapsTo' AS type, 'class:Ctx' || n_nationkey AS source_id, 'entity:Buyer' || n_nationkey AS target_id, '' AS multiplicity FROM nation UNION ALL SELECT 'MapsTo', 'class:Ctx' || n_nationkey, 'entity:Sale' || n_nationkey, '' FROM nation
UNION ALL SELECT 'DependsOn', 'entity:Buyer' || n_nationkey, 'entity:Sale' || n_nationkey, 'OneToMany BuyerId' FROM nation
""")
def ef_edges(spark, d):
    """Tables of contexts and relations of entities; a relation's navigation is resolved by its property's element type."""
    _, edges = resolve.graph([resolve.csharp(sources.settle(extract_cs.facts(contexts(spark, d)), "cs-facts"))])
    p = F.col("properties")
    kept = edges.where((F.col("type") == "MapsTo") | F.col("source_id").startswith("entity:"))
    return kept.select("type", "source_id", "target_id", F.coalesce(F.concat_ws(" ", p["Multiplicity"], p["ForeignKey"]), F.lit("")).alias("multiplicity"))


@query("""
WITH s AS (SELECT 'class:S' || s_suppkey || 'Controller' AS c, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT 'Calls' AS type, 'method:Find' || k AS source_id, 'method:Go' || n AS target_id FROM s UNION ALL SELECT 'Calls', 'method:Add' || k, 'method:Go' || n FROM s
UNION ALL SELECT 'Contains', c, 'method:Find' || k FROM s UNION ALL SELECT 'Contains', c, 'method:Add' || k FROM s UNION ALL SELECT 'Contains', c, 'field:_nation' || k FROM s UNION ALL SELECT 'Contains', c, 'method:S' || k || 'Controller..ctor' FROM s
UNION ALL SELECT 'Contains', 'file:src/S' || k || 'Controller.cs', c FROM s UNION ALL SELECT 'Exposes', c, 'endpoint:get:/api/S' || k || '/{id}' FROM s UNION ALL SELECT 'Exposes', c, 'endpoint:post:/api/S' || k FROM s
UNION ALL SELECT 'DependsOn', c, 'interface:INation' || n FROM s
UNION ALL SELECT 'Contains', 'interface:INation' || n_nationkey, 'method:Go' || n_nationkey FROM nation UNION ALL SELECT 'Contains', 'file:src/INation' || n_nationkey || '.cs', 'interface:INation' || n_nationkey FROM nation
""")
def graph_calls(spark, d):
    """All edges of the controllers and interfaces: members, calls, endpoints and dependencies (a field's and a constructor's are one)."""
    _, edges = resolve.graph([resolve.csharp(sources.settle(extract_cs.facts(controllers(spark, d).union(interfaces(spark, d))), "cs-facts"))])
    return edges.select("type", "source_id", "target_id")


@query("""
SELECT coalesce(controller, '') AS controller, count(*) AS n, min(route) AS first_route FROM (SELECT 'S' || s_suppkey || 'Controller' AS controller, '/api/S' || s_suppkey || '/{id}' AS route FROM supplier
UNION ALL SELECT 'S' || s_suppkey || 'Controller', '/api/S' || s_suppkey FROM supplier) GROUP BY 1 ORDER BY controller LIMIT 12
""")
def endpoint_groups(spark, d):
    """The first twelve controllers with their endpoints, as the endpoints diagram groups them."""
    found = extract_cs.facts(controllers(spark, d)).where("fact = 'endpoint'")
    listed = found.select("analysis_id", F.substring_index("target", ".", 1).alias("controller"), F.col("kind").alias("method"), F.col("name").alias("route"))
    return diagrams.controller_summary(listed).select("controller", F.col("n").cast("long").alias("n"), F.col("route").alias("first_route"))


# Evidence, chunks


@query("""
WITH e AS (SELECT 'f' || l_suppkey || '.cs' AS file_path, l_orderkey * 10 + l_linenumber AS k, greatest(l_linenumber - 1, 1) AS b, greatest(greatest(l_linenumber - 1, 1), CAST(l_quantity AS INT) % 9) AS f,
CASE l_returnflag WHEN 'A' THEN 'Route' WHEN 'N' THEN 'Database' ELSE CASE l_linestatus WHEN 'O' THEN 'Invocation' ELSE 'Dependency' END END AS t FROM lineitem)
SELECT file_path, CAST(b AS INT) AS start_line, CAST(f AS INT) AS end_line, arg_min(t, (k, t)) AS evidence_type, 'n' || min(k) AS symbol FROM e GROUP BY file_path, b, f
""")
def evidence_rows(spark, d):
    """One evidence for each file and span of edges that line items stand for: the first edge's."""
    n, quantity = F.col("l_linenumber"), F.col("l_quantity").cast("int") % 9
    k = F.col("l_orderkey") * 10 + n
    kind = F.when(F.col("l_returnflag") == "A", "Exposes").when(F.col("l_returnflag") == "N", "MapsTo").when(F.col("l_linestatus") == "O", "Calls").otherwise("DependsOn")
    edges = table(spark, d, "lineitem").select(
        F.lit(JOB).alias("analysis_id"), text_of("f", F.col("l_suppkey"), ".cs").alias("file_path"), text_of("n", k).alias("target_id"), kind.alias("type"), (n - 1).cast("int").alias("start_line"), quantity.alias("end_line"), F.lit("x").alias("snippet"),
        F.lit(1.0).alias("confidence"), F.lpad(k.cast("string"), 12, "0").alias("seq"),
    )
    return mapper.evidences(edges).select("file_path", "start_line", "end_line", "evidence_type", "symbol")


def packed_sql(spans: str, keys: str) -> str:
    """SQL that packs the lines of spans (keys, first line, text) into pieces: a walk over line numbers, all spans at once."""
    on = " AND ".join(f"l.{k} = w.{k}" for k in keys.split(", "))
    listed = ", ".join(f"l.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE span AS ({spans}),
    l AS (SELECT {keys}, first_line, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS no FROM span),
    w AS (SELECT {keys}, 0 AS no, -1::BIGINT AS first_piece, -1::BIGINT AS piece, NULL::BIGINT AS open FROM span
      UNION ALL SELECT {listed}, l.no,
        CASE WHEN length(line) <= 2000 AND open + 1 + length(line) <= 2000 THEN piece ELSE piece + 1 END,
        CASE WHEN length(line) > 2000 THEN piece + (length(line) + 1999) // 2000 WHEN open + 1 + length(line) <= 2000 THEN piece ELSE piece + 1 END,
        CASE WHEN length(line) > 2000 THEN NULL WHEN open + 1 + length(line) <= 2000 THEN open + 1 + length(line) ELSE length(line) END
      FROM w JOIN l ON {on} AND l.no = w.no + 1),
    cut AS (SELECT {listed}, l.first_line + l.no - 1 AS ln, l.no, unnest(range(w.first_piece, w.piece + 1)) AS piece, w.first_piece, l.line FROM w JOIN l ON {on} AND l.no = w.no),
    piece AS (SELECT {keys}, CAST(piece AS INT) AS piece, CAST(min(ln) AS INT) AS start_line, CAST(max(ln) AS INT) AS end_line,
      string_agg(CASE WHEN length(line) > 2000 THEN substr(line, CAST((piece - first_piece) * 2000 + 1 AS BIGINT), 2000) ELSE line END, chr(10) ORDER BY no) AS text FROM cut GROUP BY {keys}, piece)"""


@query(packed_sql("SELECT doc_id, 1 AS first_line, text FROM documents", "doc_id") + " SELECT doc_id, piece, start_line, end_line, CAST(length(text) AS INT) AS chars FROM piece")
def line_pack(spark, d):
    return chunks.packed(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "piece", "start_line", "end_line", F.length("content").alias("chars"))


_CHUNK_FILES = r"""SELECT doc_id, 'a' || doc_id % 7 AS analysis_id, CASE doc_id % 3 WHEN 0 THEN 'docs/D' || doc_id || '.md' WHEN 1 THEN 'src/s' || doc_id || '.cs' ELSE 'etc/w' || doc_id || '.json' END AS path,
regexp_replace(text, '(?m)^(The|Der|La|Le) ', '## \1 ', 'g') AS text FROM documents"""


def _chunk_files(spark, d):
    k, n = F.col("doc_id") % 3, F.col("doc_id")
    path = F.when(k == 0, text_of("docs/D", n, ".md")).when(k == 1, text_of("src/s", n, ".cs")).otherwise(text_of("etc/w", n, ".json"))
    return table(spark, d, "documents").select("doc_id", text_of("a", n % 7).alias("analysis_id"), path.alias("path"), F.regexp_replace("text", r"(?m)^(The|Der|La|Le) ", r"## $1 ").alias("content"))


_CHUNK_SPANS = rf"""SELECT analysis_id, path, span, span_end, symbol, base, first_line, text FROM (
WITH f AS ({_CHUNK_FILES}), l AS (SELECT *, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS no, len(regexp_split_to_array(text, '\r\n|\r|\n')) AS total FROM f),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*#{{1,6}}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM l WHERE doc_id % 3 = 0)
SELECT analysis_id, path, min(no) AS span, max(no) AS span_end, CASE WHEN regexp_matches(arg_min(line, no), '^\s*#{{1,6}}\s') THEN trim(arg_min(line, no)) END AS symbol, 1.0 AS base, min(no) AS first_line, string_agg(line, chr(10) ORDER BY no) AS text FROM g GROUP BY analysis_id, path, part
UNION ALL SELECT analysis_id, path, 1, 2, 'Head', 0.85, 1, string_agg(line, chr(10) ORDER BY no) FROM l WHERE doc_id % 3 = 1 AND no <= 2 GROUP BY analysis_id, path
UNION ALL SELECT analysis_id, path, 2, 40, 'Body', 0.85, 2, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (no >= 2 AND no <= 40), '') FROM l WHERE doc_id % 3 = 1 GROUP BY analysis_id, path
UNION ALL SELECT analysis_id, path, 1, any_value(total), NULL, 1.0, 1, string_agg(line, chr(10) ORDER BY no) FROM l WHERE doc_id % 3 = 2 GROUP BY analysis_id, path)"""


@query(
    packed_sql(f"SELECT *, row_number() OVER () AS k FROM ({_CHUNK_SPANS})", "k")
    + f""", c AS (SELECT s.analysis_id, s.path, s.span, s.span_end, s.symbol, s.base, p.piece, p.start_line, p.end_line, {_MASKED.replace("regexp_replace(text", "regexp_replace(p.text")} AS content FROM piece p JOIN span s USING (k) WHERE trim(p.text) <> ''),
    ev AS (SELECT 'a' || doc_id % 7 AS analysis_id, path, unnest([1, 2, 30]) AS b, unnest([1, 6, 31]) AS f, unnest([0.5, 0.9, 0.1]) AS confidence FROM ({_CHUNK_FILES}))
    SELECT c.analysis_id, CAST(row_number() OVER (PARTITION BY c.analysis_id ORDER BY upper(c.path), c.path, c.span, c.span_end, c.symbol NULLS FIRST, c.piece, c.start_line) - 1 AS INT) AS chunk_index, c.path AS file_path, coalesce(c.symbol, '') AS symbol,
    c.start_line, c.end_line, CAST(greatest(1, length(c.content) // 4) AS INT) AS token_count, CAST(count(ev.b) AS INT) AS n_evidence, round(coalesce(avg(ev.confidence), any_value(c.base)), 6) AS confidence, sha256(c.content) AS sha
    FROM c LEFT JOIN ev ON c.analysis_id = ev.analysis_id AND c.path = ev.path AND c.start_line <= ev.f AND c.end_line >= ev.b GROUP BY c.analysis_id, c.path, c.span, c.span_end, c.symbol, c.piece, c.start_line, c.end_line, c.content"""
)
def chunks_generate(spark, d):
    """Chunks of documents as sections, of code as symbols and of other files whole; packed, masked, numbered and tied to the evidence that overlaps them."""
    made = _chunk_files(spark, d)
    code = made.where("doc_id % 3 = 1")
    span = lambda name, b, f: code.select("analysis_id", "path", F.lit(name).alias("name"), F.lit("Method").alias("kind"), F.lit(b).alias("start_line"), F.lit(f).alias("end_line"))
    spans = F.explode(F.array(*(F.struct(F.lit(b).alias("start_line"), F.lit(f).alias("end_line"), F.lit(c).alias("confidence")) for b, f, c in ((1, 1, 0.5), (2, 6, 0.9), (30, 31, 0.1))))).alias("s")
    proof = made.select("analysis_id", F.upper("path").alias("file_path"), spans).select("analysis_id", F.concat_ws("-", "file_path", "s.start_line").alias("id"), "file_path", "s.*")
    found = chunks.generate(made.select("analysis_id", "path", "content"), span("Head", 1, 2).union(span("Body", 2, 40)), proof)
    return found.select(
        "analysis_id", "chunk_index", "file_path", F.coalesce("symbol", F.lit("")).alias("symbol"), "start_line", "end_line", "token_count", F.size("evidence_ids").alias("n_evidence"), F.round("confidence", 6).alias("confidence"), F.sha2("content", 256).alias("sha")
    )


# Paths


def path_sql(start: str, goal: str) -> str:
    """SQL of f (each node's first step and parent) and p (the way back from the goal)."""
    return f"""
WITH RECURSIVE x AS (SELECT source_id AS u, target_id AS v, seq FROM (SELECT 'supplier:' || s_suppkey AS source_id, 'nation:' || s_nationkey AS target_id, s_suppkey * 3 AS seq FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, n_nationkey * 3 + 1 FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, c_custkey * 3 + 2 FROM customer)),
e AS (SELECT u, v, seq FROM x UNION ALL SELECT v, u, seq FROM x),
w AS (SELECT 0 AS step, '{start}' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT any_value(w.step) + 1, e.v, arg_min(e.u, e.seq) FROM w JOIN e ON e.u = w.node WHERE w.step < 6 GROUP BY e.v),
f AS (SELECT node, min(step) AS step, CASE WHEN min(step) > 0 THEN arg_min(parent, step) END AS parent FROM w GROUP BY node),
p AS (SELECT step, node, parent FROM f WHERE node = '{goal}' UNION ALL SELECT f.step, f.node, f.parent FROM p JOIN f ON f.node = p.parent)"""


@query(path_sql("supplier:3", "customer:1") + """
SELECT CAST(step AS INT) AS step, node FROM p UNION ALL SELECT 0, 'Supplier:3' WHERE NOT EXISTS (SELECT 1 FROM p) UNION ALL SELECT 1, 'CUSTOMER:1' WHERE NOT EXISTS (SELECT 1 FROM p)""")
def trace_path(spark, d):
    """Both ends alone where no edges lead from one to the other."""
    return graph.trace(place_edges(spark, d), "Supplier:3", "CUSTOMER:1")


@query(path_sql("supplier:0", "customer:0") + " SELECT CAST(step AS INT) AS step, node FROM p UNION ALL SELECT 0, 'supplier:0' WHERE NOT EXISTS (SELECT 1 FROM p) UNION ALL SELECT 1, 'customer:0' WHERE NOT EXISTS (SELECT 1 FROM p)")
def trace_customer(spark, d):
    return graph.trace(place_edges(spark, d), "supplier:0", "customer:0")


@query(path_sql("nation:0", "nation:5") + ", h AS (SELECT p.step, p.parent AS a, p.node AS b FROM p WHERE p.parent IS NOT NULL) SELECT CAST(h.step - 1 AS INT) AS step, x.u AS source_id, x.v AS target_id FROM h JOIN x ON (x.u = h.a AND x.v = h.b) OR (x.u = h.b AND x.v = h.a)")
def trace_hops(spark, d):
    """The edges along a path, as they are recorded."""
    edges = place_edges(spark, d)
    return graph.trace_edges(edges, graph.trace(edges, "nation:0", "nation:5")).select("step", "source_id", "target_id")


@query(f"WITH e AS ({_EDGES}) SELECT 'outgoing' AS way, source_id, target_id FROM e WHERE lower(source_id) = 'nation:7' UNION ALL SELECT 'incoming', source_id, target_id FROM e WHERE lower(target_id) = 'nation:7'")
def touching_edges(spark, d):
    edges = place_edges(spark, d).drop("seq")
    return graph.outgoing(edges, "Nation:7").select(F.lit("outgoing").alias("way"), "*").union(graph.incoming(edges, "NATION:7").select(F.lit("incoming").alias("way"), "*"))


# Answers held against evidence


_WORDS = "', '".join(
    "true false null string int bool void async await task var let const class interface record struct enum public private protected internal static readonly override virtual get set init return new this base if else foreach "
    "while try catch finally throw using namespace import export from default select where post put delete patch api".split()
)
_CLAIMS = rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
a AS (SELECT conv_id || '-' || turn AS answer_id, text || ' See `' || regexp_extract(text, '([A-Za-z]{{3,}})', 1) || '` in notes.md. Also `Absent' || turn || '` matters.' AS answer FROM t WHERE role = 'assistant'),
c AS (SELECT conv_id || '-' || (turn + CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS answer_id, role AS symbol, text AS content FROM t),
l AS (SELECT answer_id, unnest(regexp_split_to_array(answer, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(answer, '\r\n|\r|\n'), 1) AS i FROM a),
m AS (SELECT answer_id, i, string_split(regexp_replace(regexp_replace(line, '([.!?])\s+([A-Z0-9`"''])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9`"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS x FROM l),
s AS (SELECT answer_id, i, unnest(x) AS claim, generate_subscripts(x, 1) AS j FROM m),
n AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i, j) - 1 AS pos, trim(claim) AS claim FROM s WHERE trim(claim) <> ''),
r AS (SELECT answer_id, pos, 0 AS kind, unnest(refs) AS ref, generate_subscripts(refs, 1) AS i FROM (SELECT answer_id, pos, regexp_extract_all(claim, '(?i)([a-z0-9_./\\-]+\.(?:csproj|cs|ts|json|js|xml|sln|sql|md|yml|yaml))\b', 1) AS refs FROM n)
 UNION ALL SELECT answer_id, pos, 1, ref, i FROM (SELECT answer_id, pos, unnest(refs) AS ref, generate_subscripts(refs, 1) AS i FROM (SELECT answer_id, pos, regexp_extract_all(claim, '`([A-Za-z_][A-Za-z0-9_]{{2,}})`', 1) AS refs FROM n)) WHERE lower(ref) NOT IN ('{_WORDS}')),
lost AS (SELECT answer_id, pos, arg_min(ref, (kind, i)) AS missing FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.answer_id = r.answer_id AND CASE WHEN kind = 0
 THEN lower(ref) = 'docs/notes.md' OR ends_with('docs/notes.md', '/' || lower(ref)) OR ends_with(lower(ref), '/docs/notes.md') OR regexp_extract(lower(ref), '([^/\\]*)$', 1) = 'notes.md' ELSE contains(lower(symbol), lower(ref)) OR contains(content, ref) END) GROUP BY answer_id, pos),
k AS (SELECT n.answer_id, n.pos, n.claim, lost.missing FROM n LEFT JOIN lost USING (answer_id, pos))
"""


def _answers(spark, d):
    """Assistants' turns as answers that cite what the user's turn before them says, with both turns as chunks."""
    turns = table(spark, d, "conversations")
    said = turns.where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.concat(F.col("text"), F.lit(" See `"), F.regexp_extract("text", r"([A-Za-z]{3,})", 1), F.lit("` in notes.md. Also `Absent"), F.col("turn").cast("string"), F.lit("` matters.")).alias("answer")
    )
    chunk = turns.select(F.concat_ws("-", "conv_id", F.col("turn") + F.when(F.col("role") == "user", 1).otherwise(0)).alias("answer_id"), F.lit("docs/notes.md").alias("file_path"), F.col("role").alias("symbol"), F.col("text").alias("content"))
    return said, chunk.withColumn("confidence", F.lit(0.85)).withColumn("similarity", F.lit(0.7))


@query(_CLAIMS + "SELECT answer_id, CAST(pos AS INT) AS \"at\", claim, coalesce(missing, '') AS missing, missing IS NULL AS supported FROM k")
def check_claims(spark, d):
    return grounding.check_claims(*_answers(spark, d)).withColumn("missing", F.coalesce("missing", F.lit("")))


@query(
    _CLAIMS
    + """, q AS (SELECT a.answer_id, a.answer, (SELECT count(*) FROM k WHERE k.answer_id = a.answer_id) AS n_claims, (SELECT count(*) FROM k WHERE k.answer_id = a.answer_id AND missing IS NOT NULL) AS n_failed, (SELECT count(*) FROM c WHERE c.answer_id = a.answer_id) AS n_chunks FROM a),
s2 AS (SELECT *, CASE WHEN trim(answer) = '' OR n_chunks = 0 THEN 'InsufficientEvidence' WHEN n_failed = 0 THEN 'FullySupported' WHEN n_claims > 0 AND n_failed = n_claims THEN 'Unsupported' ELSE 'PartiallySupported' END AS status FROM q),
s3 AS (SELECT *, (0.4 * 0.85 + 0.4 * 0.7 + 0.2 * CASE WHEN n_chunks >= 3 THEN 1.0 WHEN n_chunks = 2 THEN 0.9 ELSE 0.8 END) * CASE status WHEN 'Unsupported' THEN 0.0 WHEN 'PartiallySupported' THEN 0.5 + 0.4 * (n_claims - n_failed) / n_claims WHEN 'FullySupported' THEN 1.0 ELSE 0.2 END AS raw FROM s2),
s4 AS (SELECT *, CASE WHEN n_chunks = 0 THEN 0.1 WHEN status = 'PartiallySupported' THEN least(raw, 0.7) ELSE raw END AS sc FROM s3)
SELECT answer_id, status, n_claims, n_failed, n_chunks, 0 AS n_rejected, round(sc, 6) AS score, CASE WHEN n_chunks = 0 OR status = 'Unsupported' THEN 'Low' WHEN status = 'PartiallySupported' THEN CASE WHEN sc >= 0.45 THEN 'Medium' ELSE 'Low' END WHEN sc >= 0.75 THEN 'High' WHEN sc >= 0.45 THEN 'Medium' ELSE 'Low' END AS level,
CASE WHEN status IN ('InsufficientEvidence', 'Unsupported') THEN 'Insufficient evidence in the analyzed repository.' ELSE answer END AS final_answer FROM s4"""
)
def validate_claims(spark, d):
    return grounding.validate(*_answers(spark, d))


@query(_CLAIMS + "SELECT answer_id, string_agg(CASE WHEN missing IS NULL THEN claim ELSE '[Uncertain - unsupported by retrieved evidence]: ' || claim END, ' ' ORDER BY pos) AS answer FROM k GROUP BY answer_id")
def uncertain_answers(spark, d):
    return grounding.apply_policy(grounding.check_claims(*_answers(spark, d)))


@query(_CLAIMS + "SELECT answer_id, CASE WHEN bool_and(missing IS NULL) THEN string_agg(claim, ' ' ORDER BY pos) ELSE 'Insufficient evidence in the analyzed repository.' END AS answer FROM k GROUP BY answer_id")
def refused_answers(spark, d):
    return grounding.apply_policy(grounding.check_claims(*_answers(spark, d)), "RejectIfAny")


@query(_CLAIMS + "SELECT answer_id, coalesce(string_agg(claim, ' ' ORDER BY pos) FILTER (missing IS NULL), '') AS answer FROM k GROUP BY answer_id")
def trimmed_answers(spark, d):
    return grounding.apply_policy(grounding.check_claims(*_answers(spark, d)), "RemoveClaim")


@query("""
WITH s AS (SELECT 'a' || s_suppkey AS answer_id, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT answer_id, 'src/S' || k || '.cs' AS file, 'S' || k AS symbol, 1 AS start_line, CAST(n + 1 AS INT) AS end_line, 'Grounded from chunk 0 (similarity: 80%, confidence: 0.95)' AS reason FROM s
UNION ALL SELECT answer_id, 'lib/Util.cs', 'Util', 5, 9, 'Grounded from chunk 1 (similarity: 35%, confidence: 0.50)' FROM s UNION ALL SELECT answer_id, 'app/util.cs', NULL, 5, 10, 'second' FROM s WHERE k % 2 = 1
UNION ALL SELECT answer_id, 'x\\UTIL.CS', 'Go', 5, 10, 'third' FROM s WHERE k % 2 = 0 AND k % 3 = 0 UNION ALL SELECT answer_id, 'Util.cs', 'util', NULL, NULL, 'fifth' FROM s
""")
def answer_evidence(spark, d):
    """Two chunks of each supplier's answer, and citations that repeat one, repeat each other, name what isn't there or are new."""
    k, own = F.col("s_suppkey"), text_of("a", F.col("s_suppkey")).alias("answer_id")
    rows = table(spark, d, "supplier")
    last = (F.col("s_nationkey") + 1).cast("int")
    given = F.array(
        F.struct(F.lit(0).alias("chunk_index"), text_of("src/S", k, ".cs").alias("file_path"), text_of("S", k).alias("symbol"), F.lit("class").alias("content"), F.lit(1).alias("start_line"), last.alias("end_line"), F.lit(0.8).alias("similarity"), F.lit(0.95).alias("confidence")),
        F.struct(F.lit(1).alias("chunk_index"), F.lit("lib/Util.cs").alias("file_path"), F.lit("Util").alias("symbol"), F.when(k % 3 == 0, "void Go()").otherwise("void go()").alias("content"), F.lit(5).alias("start_line"), F.lit(9).alias("end_line"), F.lit(0.35).alias("similarity"), F.lit(0.5).alias("confidence")),
    )

    def cited(seq: int, file: Column, symbol: str | None, begin: int | None, end: Column, reason: str) -> Column:
        return F.struct(F.lit(seq).alias("seq"), file.alias("file_path"), F.lit(symbol).cast("string").alias("symbol"), F.lit(begin).cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(reason).alias("reason"))

    said = F.array(
        cited(1, text_of("S", k, ".cs"), "", 1, last, "first"), cited(2, F.lit("app/util.cs"), None, 5, 9 + k % 2, "second"), cited(3, F.lit("x\\UTIL.CS"), "Go", 5, F.lit(10), "third"),
        cited(4, F.lit("gone.cs"), None, 1, F.lit(2), "fourth"), cited(5, F.lit("Util.cs"), "util", None, F.lit(None), "fifth"),
    )
    chunk, citation = (rows.select(own, F.explode(x).alias("x")).select("answer_id", "x.*") for x in (given, said))
    return grounding.evidence(chunk, citation)


@query("""
WITH e AS (SELECT event_id, event_id % 7 = 0 OR event_id % 5 = 0 AS blank, event_id % 4 AS n, 0.4 * 0.9 + 0.4 * 0.6 + 0.2 * CASE WHEN event_id % 4 >= 3 THEN 1.0 WHEN event_id % 4 = 2 THEN 0.9 ELSE 0.8 END AS sc FROM events)
SELECT event_id, CASE WHEN blank THEN 0 WHEN n = 0 THEN 0.1 ELSE round(sc, 6) END AS score, CASE WHEN blank THEN 'Unknown' WHEN n = 0 THEN 'Low' WHEN sc >= 0.75 THEN 'High' ELSE 'Medium' END AS level FROM e
""")
def unknown_confidence(spark, d):
    """No confidence is stated where there is no question or no answer, whatever the evidence."""
    e, n = F.col("event_id"), F.col("event_id") % 4
    score, level = grounding.confidence(F.lit(0.9), F.lit(0.6), n, F.when(n == 0, "InsufficientEvidence").otherwise("FullySupported"), F.lit(1.0), F.lit(False), (e % 7 == 0) | (e % 5 == 0))
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("score"), level.alias("level"))


# Intake


@query(r"""
WITH u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://git.example.org/o' || page_id || '/r.git' WHEN 1 THEN 'ftp://git.example.org/o/r' WHEN 2 THEN url || ';rm' WHEN 3 THEN '  ' WHEN 4 THEN ' HTTP://h_1:8080/a%20b/c/ ' WHEN 5 THEN '-https://x/y' ELSE 'https://host' END AS u FROM pages),
v AS (SELECT page_id, trim(u) AS u FROM u)
SELECT page_id, CASE WHEN u = '' THEN 'The address is empty.' WHEN regexp_matches(u, '[ \n\r;&|`$]') OR starts_with(u, '-') THEN 'The address has characters that aren''t allowed.' WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'The address is not http or https.'
WHEN NOT regexp_matches(u, '(?i)^https?://[a-z0-9_.-]+(:[0-9]+)?/[a-z0-9_.%/-]+?(\.git)?/?$') THEN 'The address is not a repository''s.' ELSE '' END AS problem, CASE WHEN page_id % 7 = 0 THEN 'r' ELSE '' END AS name FROM v
""")
def url_validation(spark, d):
    k = F.col("page_id") % 7
    url = F.when(k == 0, text_of("https://git.example.org/o", F.col("page_id"), "/r.git")).when(k == 1, "ftp://git.example.org/o/r").when(k == 2, F.concat("url", F.lit(";rm"))).when(k == 3, "  ").when(k == 4, " HTTP://h_1:8080/a%20b/c/ ").when(k == 5, "-https://x/y").otherwise("https://host")
    return table(spark, d, "pages").select("page_id", F.coalesce(sources.url_problem(url), F.lit("")).alias("problem"), F.when(k == 0, sources.repository_name(url)).otherwise("").alias("name"))


def zipped(rows: DataFrame) -> DataFrame:
    """path and content of an archive for each row (path, a, b, bad): two entries; bad ones aren't archives, or leave their folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for a, b, bad in zip(*(x.column(c).to_pylist() for c in ("a", "b", "bad")), strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("src/a.txt", a)
                    z.writestr("../b.txt" if bad == 2 else "src/sub\\b.txt", b)
                out.append(b"no archive at all, but long enough" if bad == 1 else data.getvalue())
            yield pa.RecordBatch.from_arrays([x.column("path"), pa.array(out, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(pack, "path string, content binary")


@query("""
SELECT 'n' || n_nationkey || '.zip' AS archive, 'src/a.txt' AS path, strlen(n_name) AS size, sha256(n_name) AS hash, false AS refused FROM nation WHERE n_nationkey % 5 NOT IN (1, 2)
UNION ALL SELECT 'n' || n_nationkey || '.zip', 'src/sub/b.txt', strlen('region ' || n_regionkey), sha256('region ' || n_regionkey), false FROM nation WHERE n_nationkey % 5 NOT IN (1, 2)
UNION ALL SELECT 'n' || n_nationkey || '.zip', '', 0, '', true FROM nation WHERE n_nationkey % 5 IN (1, 2)
""")
def archive_entries(spark, d):
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(text_of("n", n, ".zip").alias("path"), F.col("n_name").alias("a"), text_of("region ", F.col("n_regionkey")).alias("b"), (n % 5).alias("bad"))
    found = sources.read_archives(zipped(rows))
    return found.select("archive", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("hash"), F.col("problem").isNotNull().alias("refused"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'There is no archive.' WHEN 1 THEN 'The archive is empty.' WHEN 2 THEN 'The archive is too small.' WHEN 3 THEN 'The file is not a zip archive.' ELSE '' END AS problem FROM nation
""")
def archive_validation(spark, d):
    k = F.col("n_nationkey") % 5
    content = F.when(k == 1, F.lit("")).when(k == 2, F.lit("PK")).when(k == 3, F.lit("RK\x03\x04 and more than enough")).when(k == 4, F.lit("PK\x03\x04 and more than enough")).cast("binary")
    rows = table(spark, d, "nation").select("n_nationkey", content.alias("content"))
    return rows.select("n_nationkey", F.coalesce(sources.archive_problem(F.col("content"), F.length("content")), F.lit("")).alias("problem"))


@query("""
WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/a' || doc_id || '.cs' WHEN 1 THEN 'vendor/b.js' WHEN 2 THEN 'img/c.PNG' WHEN 3 THEN 'lib/d' || doc_id || '.lock' WHEN 4 THEN 'web/e.min.js' ELSE 'db/f' || doc_id || '.sqlite' END AS path, text FROM documents)
SELECT doc_id, path, sha256(text) AS hash, CASE doc_id % 6 WHEN 0 THEN 'C#' ELSE 'Unknown' END AS language FROM f WHERE doc_id % 6 IN (0, 3, 5) AND strlen(text) <= 30000
""")
def ingest_files(spark, d):
    """The ingest scan keeps endings that the analysis has no use for, but not archives, media and minified files."""
    n, k = F.col("doc_id"), F.col("doc_id") % 6
    path = F.when(k == 0, text_of("src/a", n, ".cs")).when(k == 1, "vendor/b.js").when(k == 2, "img/c.PNG").when(k == 3, text_of("lib/d", n, ".lock")).when(k == 4, "web/e.min.js").otherwise(text_of("db/f", n, ".sqlite"))
    files = table(spark, d, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))
    return scan.ingest(files, most=30_000).select("doc_id", "path", "hash", "language")


@query("""
SELECT s_suppkey, name, path, project_type, language FROM (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier) s, LATERAL (SELECT CASE k WHEN 0 THEN 'App' || s_suppkey WHEN 1 THEN 'web' || s_suppkey WHEN 2 THEN 'py' || s_suppkey END AS name,
CASE k WHEN 0 THEN 'src/App' || s_suppkey || '.csproj' WHEN 1 THEN 'web' || s_suppkey || '/package.json' WHEN 2 THEN 'x/py' || s_suppkey || '/pyproject.toml' END AS path, CASE k WHEN 0 THEN 'CSharp' WHEN 1 THEN 'Node' WHEN 2 THEN 'Python' END AS project_type,
CASE k WHEN 0 THEN 'csharp' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' END AS language) p WHERE k < 3
""")
def manifest_projects(spark, d):
    n, k = F.col("s_suppkey"), F.col("s_suppkey") % 4
    path = F.when(k == 0, text_of("src/App", n, ".csproj")).when(k == 1, text_of("web", n, "/package.json")).when(k == 2, text_of("x/py", n, "/pyproject.toml")).otherwise(text_of("node_modules/m", n, "/package.json"))
    found = scan.projects(table(spark, d, "supplier").select(path.alias("path")))
    return found.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("s_suppkey"), "name", "path", "project_type", "language")


# Classification and diagrams


@query("""
SELECT 'a' || c_custkey AS analysis_id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'C#,JavaScript' ELSE 'JavaScript' END ELSE CASE WHEN c_custkey % 3 = 0 THEN 'C#,Go' ELSE 'Go' END END AS languages,
CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_csproj, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_npm, c_custkey % 2 = 0 AND c_custkey % 5 = 0 AS react, c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AS express, false AS java, c_custkey % 2 = 1 AS go, c_custkey % 7 = 0 AS routes FROM customer
""")
def layer1_flags(spark, d):
    """Markers in the root and one level below; deeper manifests and those in ignored folders don't count."""
    n = F.col("c_custkey")
    even = n % 2 == 0
    made = F.array(
        F.struct(F.when(even, "package.json").otherwise("go.mod").alias("path"), F.when(n % 5 == 0, '{"dependencies": {"react": "1"}}').otherwise('{"dependencies": {"express": "1"}}').alias("content")),
        F.struct(F.when(n % 3 == 0, "Core/Core.csproj").otherwise("notes.txt").alias("path"), F.lit("<Project />").alias("content")),
        F.struct(F.lit("a/b/pom.xml").alias("path"), F.lit("").alias("content")), F.struct(F.lit("vendor/Cargo.toml").alias("path"), F.lit("").alias("content")),
        F.struct(F.when(n % 7 == 0, "web/pages/x.tsx").otherwise("web/x.tsx").alias("path"), F.lit("").alias("content")),
    )
    files = table(spark, d, "customer").select(text_of("a", n).alias("analysis_id"), F.explode(made).alias("f")).select("analysis_id", "f.*")
    nodes = spark.createDataFrame([], "analysis_id string, type string, name string")
    edges = spark.createDataFrame([], "analysis_id string, type string, source_id string, target_id string")
    flags = classify.flags(files, spark.createDataFrame([], "analysis_id string"), nodes, edges)
    return flags.select("analysis_id", F.array_join("languages", ",").alias("languages"), F.col("n_csproj").cast("int").alias("n_csproj"), F.col("n_npm").cast("int").alias("n_npm"), "react", "express", "java", "go", "routes")


@query("""
SELECT 'a' || c_custkey AS analysis_id, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_razor, c_custkey % 5 = 0 AS areas, c_custkey % 7 = 0 AS wwwroot, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS n_view_components,
c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0 AS mvc FROM customer
""")
def layer2_flags(spark, d):
    """Views, areas, view components and static folders at any depth; names that only hold such words don't count."""
    n = F.col("c_custkey")
    chosen = lambda m, yes, no: F.when(n % m == 0, yes).otherwise(no)
    made = F.array(
        chosen(2, "src/Web/Views/Home/Index.CSHTML", "src/cshtml.txt"), chosen(3, "Pages.razor", "razor"), chosen(5, "src/Web/areas/Admin/a.cs", "src/MyAreas/a.cs"), chosen(7, "wwwroot/site.css", "src/wwwroot"),
    )
    files = table(spark, d, "customer").select(text_of("a", n).alias("analysis_id"), F.explode(made).alias("path"), F.lit("").alias("content"))
    nodes = table(spark, d, "customer").select(text_of("a", n).alias("analysis_id"), chosen(13, "Method", "Class").alias("type"), chosen(11, "CartViewComponent", "ViewComponentBase").alias("name"))
    nodes = nodes.withColumn("type", F.when(F.col("name") == "CartViewComponent", "Class").otherwise(F.col("type")))
    edges = spark.createDataFrame([], "analysis_id string, type string, source_id string, target_id string")
    flags = classify.flags(files, spark.createDataFrame([], "analysis_id string"), nodes, edges)
    return flags.select("analysis_id", F.col("n_razor").cast("int").alias("n_razor"), "areas", "wwwroot", F.col("n_view_components").cast("int").alias("n_view_components"), "mvc")


_TIER_FILES = """SELECT p_brand AS analysis_id, CASE p_partkey % 5 WHEN 0 THEN 'h/handler' || p_partkey || '.go' WHEN 1 THEN 's/service' || p_partkey || '.go' WHEN 2 THEN 'x/usecase' || p_partkey || '.go' WHEN 3 THEN 'd/storage' || p_partkey || '.go' ELSE 'z/misc.go' END AS path FROM part"""


def _tier_files(spark, d):
    n, k = F.col("p_partkey"), F.col("p_partkey") % 5
    path = F.when(k == 0, text_of("h/handler", n, ".go")).when(k == 1, text_of("s/service", n, ".go")).when(k == 2, text_of("x/usecase", n, ".go")).when(k == 3, text_of("d/storage", n, ".go")).otherwise("z/misc.go")
    return table(spark, d, "part").select(F.col("p_brand").alias("analysis_id"), path.alias("path"))


_TIERS = f"""WITH f AS (SELECT DISTINCT * FROM ({_TIER_FILES})), t AS (SELECT *, CASE WHEN contains(path, 'handler') THEN 2 WHEN contains(path, 'service') OR contains(path, 'usecase') THEN 3 WHEN contains(path, 'storage') THEN 4 END AS tier FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, tier ORDER BY upper(path), path) AS rank, regexp_extract(path, '([^/]*)[.]go$', 1) AS name FROM t WHERE tier IS NOT NULL),
n AS (SELECT analysis_id, name AS id, tier, rank FROM r WHERE rank <= CASE tier WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 4 END UNION ALL SELECT DISTINCT analysis_id, 'gateway-client', 0, 1 FROM f UNION ALL SELECT DISTINCT analysis_id, 'gateway-router', 1, 1 FROM f UNION ALL SELECT DISTINCT analysis_id, 'database', 5, 1 FROM f)"""


@query(_TIERS + " SELECT analysis_id, id, CAST(tier AS INT) AS tier, CAST(rank AS INT) AS rank FROM n")
def tier_diagram(spark, d):
    return diagrams.tiers(_tier_files(spark, d), "go")[0].select("analysis_id", "id", "tier", F.col("rank").cast("int").alias("rank"))


@query(
    _TIERS
    + """, s AS (SELECT analysis_id, tier, lead(tier) OVER (PARTITION BY analysis_id ORDER BY tier) AS next FROM (SELECT DISTINCT analysis_id, tier FROM n)), w AS (SELECT analysis_id, tier, max(rank) AS m FROM n GROUP BY ALL)
SELECT a.analysis_id, a.id AS source_id, b.id AS target_id, CASE WHEN s.next = 5 THEN 'queries' ELSE 'calls' END AS label FROM n a JOIN s ON a.analysis_id = s.analysis_id AND a.tier = s.tier JOIN n b ON b.analysis_id = a.analysis_id AND b.tier = s.next JOIN w ON w.analysis_id = a.analysis_id AND w.tier = s.next
WHERE a.tier < 2 OR (s.next = 5 AND a.rank <= 3) OR (a.tier >= 2 AND s.next <> 5 AND (a.rank - 1) % w.m + 1 = b.rank)"""
)
def tier_edges(spark, d):
    return diagrams.tiers(_tier_files(spark, d), "go")[1].select("analysis_id", "source_id", "target_id", "label")


@query("""
WITH p AS (SELECT DISTINCT s_nationkey AS a, 'package:lib' || s_suppkey % 12 AS id, 'lib' || s_suppkey % 12 AS name FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY upper(name), id) AS k FROM p)
SELECT 'a' || a AS analysis_id, 'project:P' || a AS source_id, id AS target_id, 'depends on' AS label, 'confirmed' AS state FROM r WHERE k <= 10
""")
def dependency_diagram(spark, d):
    """Each nation's project and its first ten packages by name, each with one recorded edge."""
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 12).alias("k")).distinct()
    analysis = text_of("a", F.col("a")).alias("analysis_id")
    packages = own.select(analysis, text_of("package:lib", F.col("k")).alias("id"), text_of("lib", F.col("k")).alias("name"), F.lit("Component").alias("type"), F.lpad(F.col("k").cast("string"), 3, "0").alias("seq"))
    projects = own.select(analysis, text_of("project:P", F.col("a")).alias("id"), text_of("P", F.col("a")).alias("name"), F.lit("Project").alias("type"), F.lit("").alias("seq")).distinct()
    edges = own.select(analysis, text_of("project:P", F.col("a")).alias("source_id"), text_of("package:lib", F.col("k")).alias("target_id"), F.lit("DependsOn").alias("type"))
    return diagrams.dependencies(packages.union(projects), edges)[1].select("analysis_id", "source_id", "target_id", "label", "state")


_ARCH = """WITH k AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), c AS (SELECT r, n, 'class:Shop' || n || 'Controller' AS id, 'shop' || n AS stem, row_number() OVER (PARTITION BY r ORDER BY upper('Shop' || n || 'Controller')) AS rank FROM k),
s AS (SELECT r, n, 'class:Shop' || n || 'Service' AS id, 'shop' || n AS stem, 'Service' AS kind FROM k WHERE n % 2 = 0 UNION ALL SELECT r, n, 'class:Book' || n || 'Repository', 'book' || n, 'Repository' FROM k WHERE n % 2 = 1),
sr AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY upper(substr(id, 7)), id) AS rank FROM s), e AS (SELECT r, n, 'entity:Book' || n AS id, 'book' || n AS stem FROM k WHERE n % 4 <> 3), er AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY upper(substr(id, 8)), id) AS rank, count(*) OVER (PARTITION BY r) AS total FROM e),
b AS (SELECT c.r, c.id AS cid, arg_min(sr.id, sr.rank) AS sid FROM c JOIN sr ON c.r = sr.r AND (contains(c.stem, sr.stem) OR contains(sr.stem, c.stem)) GROUP BY ALL), f AS (SELECT r, arg_min(id, rank) AS sid FROM sr GROUP BY r),
p AS (SELECT sr.r, sr.id AS sid, er.id AS eid FROM sr JOIN er ON sr.r = er.r AND (contains(sr.stem, er.stem) OR contains(er.stem, sr.stem))),
x AS (SELECT r, 'project:web-ui' AS source_id, 'project:shop-api' AS target_id, 'API Requests' AS label FROM (SELECT DISTINCT r FROM k) UNION ALL SELECT r, 'project:shop-api', id, 'REST API' FROM c WHERE rank <= 12 UNION ALL SELECT r, cid, sid, 'Dispatches' FROM b
UNION ALL SELECT c.r, c.id, f.sid, 'Dispatches' FROM c JOIN f USING (r) WHERE c.id NOT IN (SELECT cid FROM b) UNION ALL SELECT r, sid, eid, 'Persists' FROM p
UNION ALL SELECT sr.r, sr.id, er.id, 'Persists' FROM sr JOIN er ON sr.r = er.r AND er.rank = (sr.rank - 1) % er.total + 1 WHERE sr.kind = 'Repository' AND sr.id NOT IN (SELECT sid FROM p) UNION ALL SELECT r, id, 'database', 'Stored in' FROM e)"""


@query(_ARCH + " SELECT 'a' || r AS analysis_id, source_id, target_id, label FROM x")
def architecture_graph(spark, d):
    """A region's architecture: two projects, a controller for each nation, services and repositories, entities and their store."""
    nation, n = table(spark, d, "nation"), F.col("n_nationkey")
    analysis = text_of("a", F.col("n_regionkey")).alias("analysis_id")
    kinds = [
        (F.lit(True), "class:Shop", "Service", "Class", n % 2 == 0), (F.lit(True), "class:Book", "Repository", "Class", n % 2 == 1), (F.lit(True), "entity:Book", "", "DatabaseEntity", n % 4 != 3),
    ]
    parts = [nation.where(keep).select(analysis, text_of(prefix, n, suffix).alias("id"), text_of(prefix.split(":")[1], n, suffix).alias("name"), F.lit(kind).alias("type")) for _, prefix, suffix, kind, keep in kinds]
    parts += [nation.select(analysis, F.lit(f"project:{p}").alias("id"), F.lit(p).alias("name"), F.lit("Project").alias("type")).distinct() for p in ("web-ui", "shop-api")]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.union(p)
    edges = spark.createDataFrame([], "analysis_id string, source_id string, target_id string, type string, file_path string")
    listed = nation.select(analysis, text_of("Shop", n, "Controller").alias("controller"))
    return diagrams.architecture(nodes, edges, listed)[1].select("analysis_id", "source_id", "target_id", "label")
