"""Queries of mentions, limits, traces, layered diagrams, CI files, cascades, totals and job states over files and symbols made from the test tables, with independent SQL."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fact_queries import text_of
from .operators import ann, api_diagram, cascade, classify, details, diagrams, extract_ci, graph, mentions, mvc_diagram, package_diagram, page_diagram, retrieval, scan, totals
from .queries import _EDGES, place_edges, query, table
from .rules import when_chain
from .sources import archive_source, files
from .streaming import states

# Mentions anywhere in a text


@query(r"""
WITH w AS (SELECT lang, split_part(text, ' ', 2) AS name FROM documents), n AS (SELECT DISTINCT lang, name FROM w WHERE length(name) BETWEEN 4 AND 9)
SELECT doc_id, CAST(count(name) AS BIGINT) AS n, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM documents LEFT JOIN n ON documents.lang = n.lang AND contains(text, name) GROUP BY doc_id, text
""")
def symbol_mentions(spark, d):
    """The second words of a language's documents, wherever they stand in its documents."""
    docs = table(spark, d, "documents")
    names = docs.select("lang", F.split_part("text", F.lit(" "), F.lit(2)).alias("name")).where(F.length("name").between(4, 9))
    hits = mentions.containing(docs, "doc_id", "text", names, "name", "lang").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("x"))
    met = docs.select("doc_id").join(hits, "doc_id", "left")
    return met.select("doc_id", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("x", ","), F.lit("")).alias("names"))


@query(r"""
WITH p AS (SELECT page_id, html, split_part(url, '/', 4) AS area, regexp_extract(html, '<a href="(/[^"]*)"', 1) AS path FROM pages),
c AS (SELECT DISTINCT area, path, substr(path, 2) AS name FROM p WHERE length(path) > 4),
f AS (SELECT area, path, 'name' AS form, name AS x FROM c UNION ALL SELECT area, path, 'path', path FROM c UNION ALL SELECT area, path, 'tag', '<' || name FROM c)
SELECT page_id, f.path, form FROM p JOIN f ON p.area = f.area AND contains(html, x)
""")
def page_mentions(spark, d):
    """The first link of each page stands for a component of its area, which pages name, import by path or open as a tag."""
    pages = table(spark, d, "pages").select("page_id", "html", F.split_part("url", F.lit("/"), F.lit(4)).alias("area"), F.regexp_extract("html", '<a href="(/[^"]*)"', 1).alias("path"))
    parts = pages.where(F.length("path") > 4).select("area", "path").distinct()
    name = F.substring("path", 2, 1_000_000)
    forms = {"name": name, "path": F.col("path"), "tag": F.concat(F.lit("<"), name)}
    return mentions.mentioned(pages, "page_id", "html", parts, "path", forms, "area").select("page_id", "path", "form")


# Limits in one order over all paths


@query("""
WITH f AS (SELECT 'src/' || source || '/F' || doc_id || '.cs' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents),
k AS (SELECT *, count(*) OVER o AS n, sum(size) OVER o AS total FROM f WHERE size <= 20000 WINDOW o AS (ORDER BY upper(path), path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lim AS (SELECT count(*) * 3 // 4 AS most_files, sum(size) // 2 AS most_all FROM f),
j AS (SELECT path, size, CASE WHEN n > most_files THEN 'The number of files is at its limit.' WHEN total > most_all THEN 'The size of the files is at its limit.' END AS message FROM k, lim)
SELECT path, size, 'kept' AS outcome FROM j WHERE message IS NULL UNION ALL SELECT path, size, 'The file is too large.' FROM f WHERE size > 20000
UNION ALL SELECT arg_min(path, (upper(path), path)), arg_min(size, (upper(path), path)), message FROM j WHERE message IS NOT NULL GROUP BY message
""")
def scan_limits(spark, d):
    """Files kept and the errors that end a scan, with limits on a file, the number of files and their total size that all bite."""
    path = text_of("src/", F.col("source"), "/F", F.col("doc_id"), ".cs")
    files = table(spark, d, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))
    n, total = files.agg(F.count("*"), F.sum("size")).first()
    kept, errors = scan.sources(files, n * 3 // 4, 20_000, total // 2)
    ended = errors.join(files.select("path", "size"), "path").select("path", "size", F.col("message").alias("outcome"))
    return kept.select("path", "size", F.lit("kept").alias("outcome")).unionByName(ended)


# Paths with their evidence


def _place_nodes(spark, d) -> DataFrame:
    parts = [table(spark, d, t).select(text_of(f"{t}:", F.col(k)).alias("id"), F.col(n).alias("name"), (F.col(k) * 3 + r).cast("long").alias("seq")) for t, k, n, r in (("supplier", "s_suppkey", "s_name", 0), ("nation", "n_nationkey", "n_name", 1), ("region", "r_regionkey", "r_name", 2))]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""
WITH e AS ({_EDGES}), n AS (SELECT 'supplier:' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region),
k AS (SELECT (SELECT n_regionkey FROM nation WHERE n_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)) AS r, (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) AS a),
p AS (SELECT 0 AS step, 'supplier:1' AS id UNION ALL SELECT 1, 'nation:' || a FROM k UNION ALL SELECT 2, 'region:' || r FROM k UNION ALL SELECT 3, 'nation:' || min(n_nationkey) FROM nation, k WHERE n_regionkey = r AND n_nationkey <> a),
h AS (SELECT step, id, lead(id) OVER (ORDER BY step) AS nxt FROM p)
SELECT 'node' AS part, p.step, n.id AS source, n.name AS target FROM p JOIN n USING (id)
UNION ALL SELECT 'edge', h.step, source_id, target_id FROM h JOIN e ON (source_id = id AND target_id = nxt) OR (source_id = nxt AND target_id = id)
UNION ALL SELECT 'evidence', min(h.step), split_part(target_id, ':', 1) || '.cs', '' FROM h JOIN e ON (source_id = id AND target_id = nxt) OR (source_id = nxt AND target_id = id) GROUP BY split_part(target_id, ':', 1)
""")
def trace_evidence(spark, d):
    """From a supplier, asked for by its id, to the first other nation of its region, asked for by its name: nodes, edges and each evidence once."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    home = supplier.where("s_suppkey = 1").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r"))
    goal = nation.join(F.broadcast(home), (F.col("n_regionkey") == F.col("r")) & (F.col("n_nationkey") != F.col("a"))).agg(F.min_by("n_name", "n_nationkey")).first()[0]
    edges = place_edges(spark, d).withColumns({"file_path": F.concat(F.split_part("target_id", F.lit(":"), F.lit(1)), F.lit(".cs")), "start_line": F.lit(1), "end_line": F.lit(2), "snippet": F.lit("x")})
    _, nodes, walked, proof = graph.trace_with_evidence(_place_nodes(spark, d), edges, "SUPPLIER:1", goal.upper())
    parts = (nodes.select(F.lit("node").alias("part"), "step", F.col("id").alias("source"), F.col("name").alias("target")), walked.select(F.lit("edge"), "step", "source_id", "target_id"), proof.select(F.lit("evidence"), "step", "file_path", F.lit("")))
    return parts[0].union(parts[1]).union(parts[2])


# The layers of a web API: a region's suppliers are controllers, its nations services, its customers' segments repositories


def _api_tables(spark, d) -> dict[str, DataFrame]:
    nation = table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.col("s_suppkey"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 13 = 0").withColumn("k", F.col("c_custkey"))
    region, n, k = text_of("r", F.col("n_regionkey")).alias("analysis_id"), F.col("n_nationkey"), F.col("k")
    make = lambda df, *name: df.select(region, text_of(*name).alias("name"), F.lit("Class").alias("type"), k.alias("k"), n.alias("n"))
    nations = nation.withColumn("k", n)
    controllers = make(supplier.where("k % 5 <> 4"), "Land", k, "Controller").unionByName(make(nations.where("k % 3 = 2"), "Deal", n, "Controller"))
    services = make(nations, "Deal", n, "Service").unionByName(make(customer, "Land", k, "Manager"))
    stores = make(nations.where("k % 2 = 0"), "Deal", n, "Repository").unionByName(make(customer, "Book", k, "Store"))
    file = F.concat(F.lit("src/"), "name", F.lit(".cs"))
    symbols = controllers.unionByName(services).unionByName(stores).withColumn("file_path", file)
    context = make(nation.where("n_regionkey % 2 = 0").withColumn("k", n), "Shop", n, "DbContext").withColumn("file_path", file)
    body = F.when(F.col("name").endswith("Controller") & (F.col("k") % 3 == 0), text_of("class X { IDeal", F.col("n"), "Service s; }"))
    body = body.when(F.col("name").endswith("Controller") & (F.col("k") % 7 == 1), F.lit("class X { ShopDbContext c; }"))
    body = body.when(F.col("name").endswith("Service") & (F.col("k") % 4 == 0), text_of("class Y { Deal", F.col("n"), "Repository r; var x = _context; }"))
    body = body.when(F.col("name").endswith("Service") & (F.col("k") % 4 == 1), text_of("class Y { Deal", F.col("n") - F.col("n") % 5, "Service other; }"))
    files = symbols.select("analysis_id", F.col("file_path").alias("path"), body.otherwise(F.lit("class Z { }")).alias("content"))
    endpoints = supplier.where("k % 5 = 4").select(region, text_of("Route", k, "Controller").alias("controller"))
    used = supplier.where("k % 3 = 1").select(region, text_of("class:LAND", k, "Controller").alias("source_id"), text_of("interface:ideal", n, "service").alias("target_id"))
    kept = customer.select(region, text_of("class:Land", k, "Manager").alias("source_id"), text_of("class:Book", k, "Store").alias("target_id")).where(k % 2 == 0)
    return {"symbols": symbols.unionByName(context).select("analysis_id", "name", "type", "file_path"), "files": files, "endpoints": endpoints, "dependencies": used.unionByName(kept)}


_API = r"""
WITH s0 AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c0 AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 = 0),
n0 AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, n_nationkey AS k, n_regionkey AS r FROM nation),
ctrl0 AS (SELECT a, 'Land' || k || 'Controller' AS name, k, n, TRUE AS f FROM s0 WHERE k % 5 <> 4 UNION ALL SELECT a, 'Deal' || n || 'Controller', k, n, TRUE FROM n0 WHERE k % 3 = 2
  UNION ALL SELECT a, 'Route' || k || 'Controller', NULL, NULL, FALSE FROM s0 WHERE k % 5 = 4),
svc0 AS (SELECT a, 'Deal' || n || 'Service' AS name, k, n FROM n0 UNION ALL SELECT a, 'Land' || k || 'Manager', k, n FROM c0),
repo0 AS (SELECT a, 'Deal' || n || 'Repository' AS name FROM n0 WHERE k % 2 = 0 UNION ALL SELECT a, 'Book' || k || 'Store' FROM c0),
db AS (SELECT DISTINCT a FROM n0 WHERE r % 2 = 0),
c1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY upper(name), name) AS rank, count(*) OVER (PARTITION BY a) AS total FROM ctrl0),
s1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY upper(name), name) AS rank, count(*) OVER (PARTITION BY a) AS total FROM svc0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY upper(name), name) AS rank FROM repo0),
c AS (SELECT a, 'ctrl-' || lower(name) AS id, name, rank, CASE WHEN NOT f THEN '' WHEN k % 3 = 0 THEN 'class X { IDeal' || n || 'Service s; }' WHEN k % 7 = 1 THEN 'class X { ShopDbContext c; }' ELSE 'class Z { }' END AS t FROM c1 WHERE rank <= 16),
s AS (SELECT a, 'svc-' || lower(name) AS id, name, rank, CASE WHEN name NOT LIKE '%Service' THEN 'class Z { }' WHEN k % 4 = 0 THEN 'class Y { Deal' || n || 'Repository r; var x = _context; }'
  WHEN k % 4 = 1 THEN 'class Y { Deal' || (n - n % 5) || 'Service other; }' ELSE 'class Z { }' END AS t FROM s1 WHERE rank <= 16),
r AS (SELECT a, 'repo-' || lower(name) AS id, name, rank FROM r1 WHERE rank <= 10),
dep AS (SELECT a, 'class:land' || k || 'controller' AS x, 'interface:ideal' || n || 'service' AS y FROM s0 WHERE k % 3 = 1 UNION ALL SELECT a, 'class:land' || k || 'manager', 'class:book' || k || 'store' FROM c0 WHERE k % 2 = 0),
cs AS (SELECT c.a, c.id AS x, s.id AS y FROM c JOIN s USING (a) WHERE contains(c.t, s.name) OR EXISTS (SELECT 1 FROM dep WHERE dep.a = c.a AND contains(dep.x, lower(c.name)) AND contains(dep.y, lower(s.name)))),
gs AS (SELECT c.a, c.id AS x, arg_min(s.id, s.rank) AS y FROM c JOIN s USING (a) WHERE c.id NOT IN (SELECT x FROM cs WHERE cs.a = c.a) AND (contains(lower(c.name), lower(replace(s.name, 'Service', ''))) OR contains(lower(s.name), lower(replace(c.name, 'Controller', '')))) GROUP BY ALL),
os AS (SELECT s.a, coalesce((SELECT arg_min(id, rank) FROM c WHERE c.a = s.a AND contains(c.id, lower(replace(s.name, 'Service', '')))), (SELECT arg_min(id, rank) FROM c WHERE c.a = s.a), 'node-client-request') AS x, s.id AS y
  FROM s WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.a = s.a AND cs.y = s.id) AND NOT EXISTS (SELECT 1 FROM gs WHERE gs.a = s.a AND gs.y = s.id)),
sr AS (SELECT s.a, s.id AS x, r.id AS y FROM s JOIN r USING (a) WHERE contains(s.t, r.name) OR EXISTS (SELECT 1 FROM dep WHERE dep.a = s.a AND contains(dep.x, lower(s.name)) AND contains(dep.y, lower(r.name)))),
orp AS (SELECT r.a, coalesce((SELECT arg_min(id, rank) FROM s WHERE s.a = r.a AND contains(s.id, lower(replace(replace(r.name, 'Repository', ''), 'Store', '')))), (SELECT arg_min(id, rank) FROM s WHERE s.a = r.a), 'node-client-request') AS x, r.id AS y
  FROM r WHERE NOT EXISTS (SELECT 1 FROM sr WHERE sr.a = r.a AND sr.y = r.id))
"""


@query(_API + """SELECT a AS analysis_id, id, name, 'controller' AS category, CAST(1 AS INT) AS tier, CAST(rank AS INT) AS rank FROM c UNION ALL SELECT a, id, name, 'service', 2, CAST(rank AS INT) FROM s UNION ALL SELECT a, id, name, 'repository', 3, CAST(rank AS INT) FROM r
UNION ALL SELECT DISTINCT a, 'node-client-request', 'HTTP Client / Request', 'gateway', 0, 1 FROM n0 UNION ALL SELECT DISTINCT a, 'group-controllers', '+' || (total - 16) || ' controllers', 'group', 1, 1 FROM c1 WHERE total > 16
UNION ALL SELECT DISTINCT a, 'group-services', '+' || (total - 16) || ' services', 'group', 2, 1 FROM s1 WHERE total > 16 UNION ALL SELECT a, 'node-database-layer', 'Database', 'database', 4, 1 FROM db""")
def api_nodes(spark, d):
    t = _api_tables(spark, d)
    return api_diagram.api_architecture(**t, with_database=api_diagram.has_database(t["symbols"], t["symbols"].limit(0)))[0]


@query(_API + """SELECT a AS analysis_id, 'node-client-request' AS source_id, id AS target_id, 'HTTP Route' AS label, 'inferred' AS state FROM c UNION ALL SELECT DISTINCT a, 'node-client-request', 'group-controllers', '', 'inferred' FROM c1 WHERE total > 16
UNION ALL SELECT a, x, y, 'Injects / Calls', 'confirmed' FROM cs UNION ALL SELECT a, x, y, 'Estimated Injects', 'inferred' FROM gs UNION ALL SELECT a, x, y, 'Service Call', 'inferred' FROM os
UNION ALL SELECT a, id, 'node-database-layer', 'Direct EF Core', 'confirmed' FROM c JOIN db USING (a) WHERE contains(t, 'DbContext') OR contains(t, 'DbSet')
UNION ALL SELECT a, id, 'node-database-layer', 'EF Core / DbContext', 'confirmed' FROM s JOIN db USING (a) WHERE contains(t, 'DbContext') OR contains(t, 'DbSet') OR contains(t, '_context')
UNION ALL SELECT a, x, y, 'Accesses / Queries', 'confirmed' FROM sr UNION ALL SELECT a, x, y, 'Accesses', 'inferred' FROM orp UNION ALL SELECT a, id, 'node-database-layer', 'SQL / EF Core', 'confirmed' FROM r JOIN db USING (a)
UNION ALL SELECT s.a, s.id, o.id, 'Delegates', 'confirmed' FROM s JOIN s o ON s.a = o.a AND s.id <> o.id AND contains(s.t, o.name)""")
def api_edges(spark, d):
    t = _api_tables(spark, d)
    return api_diagram.api_architecture(**t, with_database=api_diagram.has_database(t["symbols"], t["symbols"].limit(0)))[1]


# CI files of GitLab and Azure: one of each for a region, with jobs for its nations


@query("""
WITH k AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT a AS analysis_id, 'make' || n AS job, 'big' AS runs_on, '' AS needs, CAST(2 AS INT) AS n_steps FROM k
UNION ALL SELECT k.a, 'try' || k.n, 'img', CASE WHEN k.n % 2 = 0 THEN 'make' || k.n ELSE (SELECT string_agg('make' || x.n, ',' ORDER BY x.n) FROM k x WHERE x.a = k.a) END, 1 FROM k
UNION ALL SELECT a, 'ship', 'img', string_agg('try' || n, ',' ORDER BY n), 1 FROM k GROUP BY a
""")
def gitlab_jobs(spark, d):
    """Templates, anchors, named needs, and the order of stages where a job names none."""
    n = F.col("n_nationkey")
    make, attempt = text_of("make", n, ":\n  <<: *made\n  extends: .tagged\n"), text_of("try", n, ":\n  script: go   # once\n", F.when(n % 2 == 0, text_of("  needs:\n  - job: make", n, "\n    artifacts: true\n")).otherwise(""))
    jobs = table(spark, d, "nation").groupBy("n_regionkey").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), x.alias("x")))), lambda s: s["x"]), "").alias(name) for name, x in (("makes", make), ("tries", attempt))))
    text = F.concat(F.lit("stages: [make, 'try', ship]\nimage: {name: img}\n.tagged:\n  tags: [big]\n.made: &made\n  stage: make\n  script:\n    - one\n    - |\n      two: lines\n      ship: no\n"), "makes", F.regexp_replace("tries", "script: go", "stage: try\n  script: go"), F.lit("ship: {stage: ship, script: [go]}\n"))
    files = jobs.select(text_of("r", F.col("n_regionkey")).alias("analysis_id"), F.lit(".gitlab-ci.yml").alias("path"), text.alias("content"))
    return extract_ci.jobs(files).select("analysis_id", "job", "runs_on", F.array_join("needs", ",").alias("needs"), "n_steps")


@query("""
WITH k AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n FROM nation)
SELECT a AS analysis_id, 'make' || n AS job, 'vm' AS runs_on, '' AS needs, CAST(2 AS INT) AS n_steps FROM k
UNION ALL SELECT a, 'pack', 'own', string_agg('make' || n, ',' ORDER BY n), 1 FROM k GROUP BY a
UNION ALL SELECT a, 'checks.yml', 'vm', string_agg('make' || n, ',' ORDER BY n) || ',pack', 0 FROM k GROUP BY a
UNION ALL SELECT a, 'prod', 'vm', string_agg('make' || n, ',' ORDER BY n) || ',pack,checks.yml', 2 FROM k GROUP BY a
UNION ALL SELECT DISTINCT a, 'alone', 'vm', '', 1 FROM k
""")
def azure_jobs(spark, d):
    """Stages that follow each other, wait for named ones or for none; templates and deployments."""
    n = F.col("n_nationkey")
    ordered = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), x.alias("x")))), lambda s: s["x"])
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(ordered(text_of("  - job: make", n, "\n    steps:\n    - script: a\n    - task: B@1\n      inputs:\n        jobs: none\n")).alias("makes"), ordered(text_of("make", n)).alias("names"))
    text = F.concat(
        F.lit("trigger: [main]\npool:\n  vmImage: vm\nstages:\n- stage: Make\n  jobs:\n"), F.array_join("makes", ""), F.lit("  - job: pack\n    dependsOn: ["), F.array_join("names", ", "), F.lit("]\n    pool: {name: own}\n    steps: [{script: x}]\n"),
        F.lit("- stage: Check\n  jobs:\n  - template: checks.yml\n- stage: Ship\n  dependsOn:\n  - Make\n  - Check\n  jobs:\n  - deployment: prod\n    strategy:\n      runOnce:\n        deploy:\n          steps:\n          - script: a\n          - script: b\n- stage: Alone\n  dependsOn: []\n  jobs:\n  - job: alone\n    steps:\n    - script: x\n"),
    )
    files = rows.select(text_of("r", F.col("n_regionkey")).alias("analysis_id"), F.lit("azure-pipelines.yml").alias("path"), text.alias("content"))
    return extract_ci.jobs(files).select("analysis_id", "job", "runs_on", F.array_join("needs", ",").alias("needs"), "n_steps")


# Cascades


@query("""
WITH p AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n FROM nation),
f AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'p' || n_nationkey WHEN c_custkey % 7 = 0 THEN 'p999' END AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT *, CASE k % 4 WHEN 0 THEN 'SRC/n' || n || '/N.csproj' WHEN 1 THEN 'src/N' || n || '/sub/f' || k || '.cs' WHEN 2 THEN 'src/f' || k || '.cs' ELSE 'other/f' || k || '.cs' END AS path FROM f)
SELECT a AS analysis_id, k, path, CASE WHEN ref <> 'p999' THEN ref WHEN k % 4 IN (0, 1) THEN 'p' || n ELSE 'p' || (SELECT min(n) FROM p WHERE p.a = g.a) END AS project_id FROM g
""")
def project_cascade(spark, d):
    """Files that name a project, are its manifest, lie below its folder, or have only their analysis in common with it."""
    nation = table(spark, d, "nation")
    n, k, region = F.col("n_nationkey"), F.col("c_custkey"), text_of("r", F.col("n_regionkey"))
    projects = nation.select(region.alias("analysis_id"), text_of("p", n).alias("project_id"), text_of("src/n", n, "/N.csproj").alias("path"), n.alias("seq"))
    path = F.when(k % 4 == 0, text_of("SRC/n", n, "/N.csproj")).when(k % 4 == 1, text_of("src/N", n, "/sub/f", k, ".cs")).when(k % 4 == 2, text_of("src/f", k, ".cs")).otherwise(text_of("other/f", k, ".cs"))
    files = table(spark, d, "customer").join(nation, F.col("c_nationkey") == n).select(region.alias("analysis_id"), k.alias("k"), path.alias("path"), F.when(k % 5 == 0, text_of("p", n)).when(k % 7 == 0, F.lit("p999")).alias("project_ref"))
    return cascade.project_of_files(files, projects).select("analysis_id", "k", "path", "project_id")


@query("""
WITH p AS (SELECT 'r' || n_regionkey AS a, n_name AS name, n_nationkey AS n FROM nation), s AS (SELECT 'r' || n_regionkey AS a, 'src/' || n_name || s_suppkey || '/x.csproj' AS path, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s.a AS analysis_id, k, path, coalesce(arg_min(name, n), '') AS project FROM s LEFT JOIN p ON s.a = p.a AND contains(path, name) GROUP BY ALL
""")
def project_ref_source(spark, d):
    nation, region = table(spark, d, "nation"), text_of("r", F.col("n_regionkey"))
    projects = nation.select(region.alias("analysis_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq"))
    asked = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(region.alias("analysis_id"), F.col("s_suppkey").alias("k"), text_of("src/", F.col("n_name"), F.col("s_suppkey"), "/x.csproj").alias("path"))
    return cascade.project_of_references(asked, projects).select("analysis_id", "k", "path", F.coalesce("project", F.lit("")).alias("project"))


@query(f"""
WITH e AS (SELECT source_id, target_id, CASE split_part(source_id, ':', 1) WHEN 'supplier' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END + 3 * CAST(split_part(source_id, ':', 2) AS BIGINT) AS seq FROM ({_EDGES})),
b AS (SELECT source_id AS id, * FROM e UNION ALL SELECT target_id, * FROM e)
SELECT 'nation:' || n_nationkey AS id, coalesce(arg_min(source_id, seq), '') AS edge_source, coalesce(arg_min(target_id, seq), '') AS edge_target FROM nation LEFT JOIN b ON b.id = 'nation:' || n_nationkey GROUP BY n_nationkey
""")
def endpoint_first_edge(spark, d):
    nodes = table(spark, d, "nation").select(text_of("NATION:", F.col("n_nationkey")).alias("id"))
    met = cascade.first_edge_of(nodes, place_edges(spark, d))
    return met.select(F.lower("id").alias("id"), F.coalesce("edge_source", F.lit("")).alias("edge_source"), F.coalesce("edge_target", F.lit("")).alias("edge_target"))


@query("""
SELECT 'a' || c_custkey AS analysis_id, c_custkey % 2 = 0 AS "references", c_custkey % 3 = 0 AS relations, 'Cli' AS repository_type,
CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'High' ELSE 'Medium' END AS confidence FROM customer
""")
def layer3_flags(spark, d):
    """References between projects, relations between symbols and the number of projects make a program's kind surer."""
    customer, k = table(spark, d, "customer"), F.col("c_custkey")
    own = text_of("a", k).alias("analysis_id")
    files = customer.select(own, F.lit("src/Tool.csproj").alias("path"), F.lit("").alias("content"))
    projects = customer.select(own, F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n")).drop("n")
    nodes = customer.select(own, F.lit("Class").alias("type"), F.lit("Program").alias("name"))
    none = F.struct(F.lit("Contains").alias("type"), F.lit("file:a").alias("source_id"), F.lit("class:a").alias("target_id"))
    between = F.struct(F.lit("DependsOn").alias("type"), F.when(k % 2 == 0, "project:a").otherwise("class:a").alias("source_id"), F.lit("project:b").alias("target_id"))
    related = F.struct(F.when(k % 3 == 0, F.element_at(F.array(F.lit("Calls"), F.lit("Inherits"), F.lit("Implements")), (k % 9 / 3 + 1).cast("int"))).otherwise("MapsTo").alias("type"), F.lit("class:a").alias("source_id"), F.lit("class:b").alias("target_id"))
    edges = customer.select(own, F.explode(F.array(none, between, related)).alias("e")).select("analysis_id", "e.*")
    return classify.decide(classify.flags(files, projects, nodes, edges)).select("analysis_id", "references", "relations", "repository_type", "confidence")


# Levels of totals, and values as of a time


@query("""
SELECT coalesce(l_returnflag, '-') AS l_returnflag, coalesce(l_linestatus, '-') AS l_linestatus, coalesce(y, 0) AS y, CAST(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(y) AS INT) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS y FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, y)
""")
def totals_cube(spark, d):
    lines = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    found = totals.cube(lines, ["l_returnflag", "l_linestatus", "y"], n=F.count("*"), quantity=F.sum(F.col("l_quantity").cast("long")))
    return found.withColumns({"l_returnflag": F.coalesce("l_returnflag", F.lit("-")), "l_linestatus": F.coalesce("l_linestatus", F.lit("-")), "y": F.coalesce("y", F.lit(0))})


@query("""
SELECT coalesce(r_name, '-') AS r_name, coalesce(n_name, '-') AS n_name, CAST(grouping(r_name) * 2 + grouping(n_name) AS INT) AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def totals_rollup(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return totals.rollup(rows, ["r_name", "n_name"], n=F.count("*")).withColumns({c: F.coalesce(c, F.lit("-")) for c in ("r_name", "n_name")})


@query("""
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS t, max(o_orderkey) AS k FROM orders GROUP BY ALL), e AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events)
SELECT event_id, k AS o_orderkey FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.t
""")
def events_asof_orders(spark, d):
    """The last order of an event's user before it."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("since"), "o_orderkey")
    return totals.as_of(events, orders, "user_id", "ts", "since", ["o_orderkey"]).select("event_id", "o_orderkey")


# States of jobs over a stream of their events

_KINDS = {"signup": "Queued", "view": "StaticAnalysis", "click": "Embedding", "purchase": "Completed", "error": "Failed"}


@query("""
WITH e AS (SELECT user_id || '-' || event_id % 3 AS job, CAST(ts AS TIMESTAMP) AS ts, event_type FROM events),
s AS (SELECT job, min(ts) AS first_ts, max(ts) AS last_ts, min(ts) FILTER (event_type = 'purchase') AS c, min(ts) FILTER (event_type = 'error') AS f, bool_or(event_type = 'click') AS emb, bool_or(event_type = 'view') AS ana FROM e GROUP BY job),
m AS (SELECT max(ts) AS t FROM e)
SELECT job, CASE WHEN f IS NOT NULL AND (c IS NULL OR f <= c) THEN 'Failed' WHEN c IS NOT NULL THEN 'Completed' WHEN last_ts + INTERVAL 7 DAY <= t - INTERVAL 1 HOUR THEN 'TimedOut' WHEN emb THEN 'Embedding' WHEN ana THEN 'StaticAnalysis' ELSE 'Queued' END AS status,
CASE WHEN emb THEN 'Embedding' WHEN ana THEN 'StaticAnalysis' ELSE 'Queued' END AS stage FROM s, m
""")
def job_states(spark, d):
    """The events, replayed as a stream in a few batches: the state each job ends in."""
    root = files.scratch(spark, "job-states")
    events = table(spark, d, "events")
    kind = when_chain([(F.col("event_type") == k, v) for k, v in _KINDS.items()])
    source = events.select(F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("job"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    source.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 10).parquet(f"{root}/in")
    states.keep(states.transitions(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return states.current(spark, f"{root}/out").select("job", "status", "stage")


# One archive, many tasks


@query("""
SELECT 'r' || n_regionkey || '.zip' AS archive, 'src/n' || n_nationkey || '/c' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.cs' ELSE '.txt' END AS path, CAST(strlen(c_name) AS BIGINT) AS size, CASE WHEN c_custkey % 3 = 0 THEN sha256(c_name) ELSE '' END AS hash
FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'z.zip', '', 0, ''
""")
def archive_ranges(spark, d):
    """An archive a region with a file a customer, and one that is none: read by ranges of some kilobytes, contents of one kind of file only."""
    folder = files.scratch(spark, "archives")
    nation = table(spark, d, "nation")
    path = text_of("src/n", F.col("n_nationkey"), "/c", F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, ".cs").otherwise(".txt"))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(text_of("r", F.col("n_regionkey"), ".zip").alias("archive"), path.alias("path"), "c_name")
    none = spark.range(1).select(F.lit("z.zip").alias("archive"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("c_name"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries go to their archive as they come, an archive after the other."""
        fs, at = archive_source.filesystem(folder)
        fs.create_dir(at)
        named, out, packed = None, None, None

        def close() -> None:
            if packed:
                packed.close()
            if out:
                out.close()

        for b in batches:
            for archive, path, text in zip(*(b.column(c).to_pylist() for c in ("archive", "path", "c_name")), strict=True):
                if archive != named:
                    close()
                    named, out, packed = archive, fs.open_output_stream(f"{at}/{archive}"), None
                if path is None:
                    out.write(b"no archive")
                    continue
                packed = packed or zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                packed.writestr(path, text)
            yield b.select(["archive"])
        close()

    rows.unionByName(none).repartition("archive").sortWithinPartitions("archive").mapInArrow(write, "archive string").count()
    listed = archive_source.read_large_archives(spark, folder, 4096, content=False, limited=False).select("archive", "path", "size", F.lit("").alias("hash"))
    read = archive_source.read_large_archives(spark, folder, 4096, limited=False).where(F.col("path").endswith(".cs")).select("archive", "path", "size", F.sha2("content", 256).alias("hash"))
    names = listed.where(F.coalesce(~F.col("path").endswith(".cs"), F.lit(True)))
    return names.select("archive", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), "hash").unionByName(read)


# The map of a frontend: a region's nations have a page, two components and every other one a hook; some customers have bare pages


_PAGES = r"""
WITH n AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n FROM nation),
f AS (SELECT a, 'app/n' || n || '/Page' || n || '.tsx' AS path, CASE n % 3 WHEN 0 THEN '<Card' || n || '/>' WHEN 1 THEN 'import components/w/Box' || n || '.tsx' ELSE 'none' END AS t FROM n
  UNION ALL SELECT a, 'src/components/Card' || n || '.tsx', CASE WHEN n % 4 = 0 THEN 'useCart' || n || '() axios' ELSE 'x' END FROM n UNION ALL SELECT a, 'components/w/Box' || n || '.tsx', CASE WHEN n % 5 = 0 THEN 'Card' || n ELSE 'y' END FROM n
  UNION ALL SELECT a, 'hooks/useCart' || n || '.ts', CASE WHEN n % 6 = 0 THEN 'fetch(' ELSE 'z' END FROM n WHERE n % 2 = 0 UNION ALL SELECT 'r' || n_regionkey, 'pages/c' || c_custkey || '.tsx', '' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0),
s AS (SELECT *, regexp_extract(path, '([^/]+)[.][^.]*$', 1) AS name, row_number() OVER (PARTITION BY a, split_part(replace(path, 'src/', ''), '/', 1) IN ('app', 'pages'), split_part(replace(path, 'src/', ''), '/', 1) = 'hooks' ORDER BY upper(path), path) AS rank FROM f),
p AS (SELECT *, 'page-' || name AS id FROM s WHERE (path LIKE 'app/%' OR path LIKE 'pages/%') AND rank <= 15), c AS (SELECT *, 'comp-' || name AS id FROM s WHERE path LIKE '%components/%' AND rank <= 16), h AS (SELECT *, 'hook-' || name AS id FROM s WHERE path LIKE 'hooks/%' AND rank <= 10),
pc AS (SELECT p.a, p.id AS x, c.id AS y FROM p JOIN c ON p.a = c.a AND (contains(p.t, c.name) OR contains(p.t, c.path))), cc AS (SELECT c.a, c.id AS x, o.id AS y FROM c JOIN c o ON c.a = o.a AND c.path <> o.path AND (contains(c.t, o.name) OR contains(c.t, o.path))),
ch AS (SELECT c.a, c.id AS x, h.id AS y FROM c JOIN h ON c.a = h.a AND (contains(c.t, h.name) OR contains(c.t, h.path))), api AS (SELECT a, id FROM c WHERE contains(t, 'axios') UNION ALL SELECT a, id FROM h WHERE contains(t, 'fetch('))
"""


def _page_files(spark, d) -> DataFrame:
    nation = table(spark, d, "nation")
    n, a = F.col("n_nationkey"), text_of("r", F.col("n_regionkey")).alias("analysis_id")
    page = F.when(n % 3 == 0, text_of("<Card", n, "/>")).when(n % 3 == 1, text_of("import components/w/Box", n, ".tsx")).otherwise("none")
    own = [
        (nation, text_of("app/n", n, "/Page", n, ".tsx"), page), (nation, text_of("src/components/Card", n, ".tsx"), F.when(n % 4 == 0, text_of("useCart", n, "() axios")).otherwise("x")), (nation, text_of("components/w/Box", n, ".tsx"), F.when(n % 5 == 0, text_of("Card", n)).otherwise("y")),
        (nation.where(n % 2 == 0), text_of("hooks/useCart", n, ".ts"), F.when(n % 6 == 0, "fetch(").otherwise("z")),
        (table(spark, d, "customer").where("c_custkey % 20 = 0").join(nation, F.col("c_nationkey") == n), text_of("pages/c", F.col("c_custkey"), ".tsx"), F.lit("")),
    ]
    parts = [df.select(a, path.alias("path"), text.alias("content")) for df, path, text in own]
    return reduce(DataFrame.unionByName, parts)


@query(_PAGES + """SELECT a AS analysis_id, id, path AS name, 'route' AS category, CAST(rank AS INT) AS rank FROM p UNION ALL SELECT a, id, name, 'component', CAST(rank AS INT) FROM c UNION ALL SELECT a, id, name, 'hook', CAST(rank AS INT) FROM h UNION ALL SELECT DISTINCT a, 'node-external-api', 'Backend / External API', 'external_api', 1 FROM n""")
def frontend_nodes(spark, d):
    return page_diagram.frontend_map(_page_files(spark, d))[0].drop("tier")


@query(_PAGES + """SELECT a AS analysis_id, x AS source_id, y AS target_id, 'Renders' AS label, 'confirmed' AS state FROM pc UNION ALL SELECT a, x, y, 'Sub-Component', 'confirmed' FROM cc UNION ALL SELECT a, x, y, 'Uses Hook', 'confirmed' FROM ch UNION ALL SELECT a, id, 'node-external-api', 'HTTP / REST', 'confirmed' FROM api
UNION ALL SELECT a, (SELECT arg_min(id, rank) FROM p WHERE p.a = c.a), id, 'Page Component', 'inferred' FROM c WHERE NOT EXISTS (SELECT 1 FROM pc WHERE pc.a = c.a AND y = id) AND NOT EXISTS (SELECT 1 FROM cc WHERE cc.a = c.a AND y = id)
UNION ALL SELECT a, (SELECT arg_min(id, rank) FROM c WHERE c.a = h.a), id, 'Uses Hook', 'inferred' FROM h WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.a = h.a AND y = id)
UNION ALL SELECT a, arg_min(id, rank), 'node-external-api', 'HTTP / REST', 'inferred' FROM h WHERE NOT EXISTS (SELECT 1 FROM api WHERE api.a = h.a) GROUP BY a""")
def frontend_edges(spark, d):
    return page_diagram.frontend_map(_page_files(spark, d))[1]


# Who imports which package: a region's nations are projects and modules, its suppliers packages


@query(r"""
WITH n AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n FROM nation), s AS (SELECT 'r' || n_regionkey AS a, s_suppkey AS k, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m0 AS (SELECT a, 'proj-p' || n AS id, 'P' || n AS name, 'project' AS kind, 0 AS o, '' AS t FROM n UNION ALL SELECT a, 'mod-shop' || n || 'controller', 'Shop' || n || 'Controller', 'controller', 1, '' FROM n WHERE n % 2 = 0
  UNION ALL SELECT a, 'mod-shop' || n || 'service', 'Shop' || n || 'Service', 'service', 2, 'using Core' || n || ';' FROM n WHERE n % 3 = 0 UNION ALL SELECT a, 'mod-book' || n || 'model', 'Book' || n || 'Model', 'repository', 3, '' FROM n WHERE n % 3 = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY o, upper(name), name) AS rank FROM m0),
k0 AS (SELECT a, CASE k % 5 WHEN 0 THEN 'Acme.Core' || n WHEN 1 THEN 'express-' || k WHEN 2 THEN '@x/mongo' || k WHEN 3 THEN 'jwt' || k ELSE 'misc' || k END AS name, k FROM s),
k1 AS (SELECT a, name, min(k) AS k FROM k0 GROUP BY ALL), k2 AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY k, name) AS rank FROM k1), k AS (SELECT a, name, 'pkg-' || replace(replace(lower(name), '/', '-'), '@', '') AS id FROM k2 WHERE rank <= 10),
rec AS (SELECT a, 'mod-shop' || n || 'controller' AS x, 'mod-book' || n || 'model' AS y, 'DependsOn' AS label FROM n WHERE n % 2 = 0 AND n % 3 = 1),
imp AS (SELECT k.a, coalesce((SELECT arg_min(m.id, m.rank) FROM m WHERE m.a = k.a AND (contains(m.t, k.name) OR contains(m.t, regexp_extract(k.name, '[^.]*$')))),
  CASE WHEN contains(lower(name), 'express') THEN coalesce((SELECT arg_min(id, rank) FROM m WHERE m.a = k.a AND kind = 'controller'), (SELECT arg_min(id, rank) FROM m WHERE m.a = k.a))
       WHEN contains(lower(name), 'mongo') THEN coalesce((SELECT arg_min(id, rank) FROM m WHERE m.a = k.a AND (kind = 'repository' OR contains(lower(m.name), 'model'))), (SELECT arg_max(id, rank) FROM m WHERE m.a = k.a))
       ELSE coalesce((SELECT arg_min(id, rank) FROM m WHERE m.a = k.a AND kind = 'service'), (SELECT arg_min(id, rank) FROM m WHERE m.a = k.a)) END) AS x, id AS y, 'imports' AS label FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rank) AS place, count(*) OVER (PARTITION BY a) AS n FROM m WHERE kind IN ('service', 'repository')),
mod AS (SELECT c.a, c.id AS x, coalesce((SELECT arg_min(t.id, t.place) FROM t WHERE t.a = c.a AND contains(replace(replace(lower(t.name), 'model', ''), 'service', ''), replace(lower(c.name), 'controller', ''))),
  (SELECT t.id FROM t WHERE t.a = c.a AND t.place = CAST('0x' || substr(sha256(c.id), 1, 8) AS BIGINT) % t.n + 1)) AS y, 'references' AS label FROM m c WHERE kind = 'controller')
SELECT a AS analysis_id, x AS source_id, y AS target_id, label FROM rec UNION ALL SELECT * FROM imp UNION ALL SELECT * FROM mod WHERE y IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.a = mod.a AND rec.x = mod.x AND rec.y = mod.y)
""")
def package_map(spark, d):
    nation = table(spark, d, "nation")
    n, a = F.col("n_nationkey"), text_of("r", F.col("n_regionkey")).alias("analysis_id")
    projects = nation.select(a, text_of("p", n).alias("id"), text_of("P", n).alias("name"))
    made = [(0, 2, "Shop", "Controller"), (0, 3, "Shop", "Service"), (1, 3, "Book", "Model")]
    parts = [nation.where(n % by == left).select(a, text_of(head, n, tail).alias("name"), F.lit("Class").alias("type"), text_of("src/", F.lit(head), n, tail, ".cs").alias("file_path"), n.alias("n")) for left, by, head, tail in made]
    symbols = reduce(DataFrame.unionByName, parts)
    texts = symbols.select("analysis_id", F.col("file_path").alias("path"), F.when(F.col("name").endswith("Service"), text_of("using Core", F.col("n"), ";")).otherwise("").alias("content"))
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, text_of("Acme.Core", n)).when(k % 5 == 1, text_of("express-", k)).when(k % 5 == 2, text_of("@x/mongo", k)).when(k % 5 == 3, text_of("jwt", k)).otherwise(text_of("misc", k))
    packages = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == n).select(a, name.alias("name"), k.alias("seq"))
    used = nation.where((n % 2 == 0) & (n % 3 == 1)).select(a, text_of("shop", n, "controller").alias("source_id"), text_of("mod-book", n, "model").alias("target_id"), F.lit("DependsOn").alias("type"))
    return package_diagram.package_map(projects, symbols.drop("n"), texts, packages, used)[1].drop("state")


# The smaller diagrams


@query("""
WITH e AS (SELECT 'a' || s_nationkey AS a, 'C' || s_suppkey % 30 AS c, 'GET /s/' || s_suppkey AS id, '/s/' || s_suppkey AS route FROM supplier), g AS (SELECT *, dense_rank() OVER (PARTITION BY a ORDER BY upper(c)) AS g, row_number() OVER (PARTITION BY a, c ORDER BY route) AS k FROM e)
SELECT a AS analysis_id, 'group:' || c AS source_id, id AS target_id FROM g WHERE g <= 8 AND k <= 4
""")
def endpoints_diagram(spark, d):
    k = F.col("s_suppkey")
    stored = table(spark, d, "supplier").select(text_of("a", F.col("s_nationkey")).alias("analysis_id"), text_of("C", k % 30).alias("controller"), F.lit("GET").alias("method"), text_of("/s/", k).alias("route"))
    return diagrams.endpoints(stored)[1].select("analysis_id", "source_id", "target_id")


@query("""
WITH e AS (SELECT 'a' || c_nationkey AS a, 'e' || c_custkey AS id, 'E' || c_custkey AS name FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY name, id) AS rank FROM e)
SELECT a AS analysis_id, x.id AS source_id, y.id AS target_id, 'OneToMany' AS label, CASE WHEN CAST(substr(x.id, 2) AS BIGINT) % 2 = 0 THEN 'confirmed' ELSE 'inferred' END AS state
FROM k x JOIN k y USING (a) WHERE x.rank <= 20 AND y.rank <= 20 AND CAST(substr(y.id, 2) AS BIGINT) % 7 = CAST(substr(x.id, 2) AS BIGINT) % 7 AND x.name < y.name
""")
def erd_diagram(spark, d):
    """Relations between the first twenty entities of each analysis; proven ones are confirmed."""
    k, a = F.col("c_custkey"), text_of("a", F.col("c_nationkey")).alias("analysis_id")
    rows = table(spark, d, "customer").select(a, text_of("e", k).alias("id"), text_of("E", k).alias("name"), k.alias("k"))
    # Only relations of entities that are shown are made: a relation of every pair would be as many as the square of an analysis.
    named = rows.join(diagrams.erd_entities(rows.drop("k")).select("analysis_id", "id"), ["analysis_id", "id"], "left_semi")
    x, y = (named.select("analysis_id", F.col("id").alias(f"{m}_entity_id"), F.col("name").alias(f"{m}_name"), F.col("k").alias(f"{m}_k")) for m in ("source", "target"))
    pairs = x.join(y, (x["analysis_id"] == y["analysis_id"]) & (F.col("source_k") % 7 == F.col("target_k") % 7) & (F.col("source_name") < F.col("target_name")))
    relations = pairs.select(x["analysis_id"], "source_entity_id", "target_entity_id", F.lit("OneToMany").alias("relationship_type"), F.when(F.col("source_k") % 2 == 0, "proof").alias("evidence_id"))
    return diagrams.erd(rows.drop("k"), relations)[1].select("analysis_id", "source_id", "target_id", "label", "state")


@query("""
WITH p AS (SELECT 'r' || n_regionkey AS a, 'project:' || n_name AS id, n_name AS name, n_nationkey AS n, n_regionkey AS r FROM nation), e AS (SELECT x.a, x.id AS s, y.id AS t FROM p x JOIN p y ON x.a = y.a AND y.n = x.n + 5 WHERE x.r % 2 = 0)
SELECT a AS analysis_id, s AS source_id, t AS target_id, 'references' AS label, 'confirmed' AS state FROM e
UNION ALL SELECT a, arg_min(id, (upper(name), id)), arg_max(id, (upper(name), id)), 'related', 'inferred' FROM p WHERE a NOT IN (SELECT a FROM e) GROUP BY a
""")
def monorepo_diagram(spark, d):
    """References between projects; where there are none the first project is related to the last."""
    n, a = F.col("n_nationkey"), text_of("r", F.col("n_regionkey")).alias("analysis_id")
    nation = table(spark, d, "nation")
    nodes = nation.select(a, text_of("project:", F.col("n_name")).alias("id"), F.col("n_name").alias("name"), F.lit("Project").alias("type"))
    other = nation.select(F.col("n_name").alias("t"), F.col("n_nationkey").alias("m"), F.col("n_regionkey").alias("q"))
    edges = nation.where("n_regionkey % 2 = 0").join(other, (F.col("m") == n + 5) & (F.col("q") == F.col("n_regionkey"))).select(a, text_of("project:", F.col("n_name")).alias("source_id"), text_of("project:", F.col("t")).alias("target_id"), F.lit("DependsOn").alias("type"))
    return diagrams.monorepo(nodes, edges)[1]


@query("""
WITH t AS (SELECT 'r' || n_regionkey AS a, 'class:' || c_name AS id, c_name AS name, c_custkey AS k, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY upper(name), id) AS rank FROM t),
s AS (SELECT * FROM k WHERE rank <= 12), e AS (SELECT x.a, x.id AS s, y.id AS t FROM s x JOIN s y ON x.a = y.a AND y.rank = x.rank + 2 WHERE x.r <> 3)
SELECT a AS analysis_id, s AS source_id, t AS target_id, 'inherits' AS label, 'confirmed' AS state FROM e
UNION ALL SELECT x.a, x.id, y.id, 'related', 'inferred' FROM s x JOIN s y ON x.a = y.a AND y.rank = x.rank + 1 WHERE x.a NOT IN (SELECT a FROM e)
""")
def hierarchy_diagram(spark, d):
    """Inheritance between the twelve types that are shown; a chain of them where there is none."""
    a = text_of("r", F.col("n_regionkey")).alias("analysis_id")
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = rows.select(a, text_of("class:", F.col("c_name")).alias("id"), F.col("c_name").alias("name"), F.lit("Class").alias("type"), "n_regionkey")
    ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("analysis_id").orderBy(F.upper("name"), "id"))).where("n_regionkey <> 3")
    x, y = (ranked.select("analysis_id", F.col("id").alias(c), (F.col("rank") + by).alias("at")) for c, by in (("source_id", 2), ("target_id", 0)))
    edges = x.join(y, ["analysis_id", "at"]).select("analysis_id", "source_id", "target_id", F.lit("Inherits").alias("type"))
    return diagrams.hierarchy(nodes.drop("n_regionkey"), edges)[1]


@query("""
WITH k AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation)
SELECT a AS analysis_id, CASE WHEN before IS NULL THEN 'trigger:.gitlab-ci.yml' ELSE '.gitlab-ci.yml/j' || before END AS source_id, '.gitlab-ci.yml/j' || n AS target_id, CASE WHEN before IS NULL THEN 'starts' ELSE 'needs' END AS label FROM k
""")
def workflow_diagram(spark, d):
    """A stage for each nation of a region, so that each job waits for the one before."""
    n = F.col("n_nationkey")
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), x.alias("x")))), lambda s: s["x"])
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(listed(text_of("s", n)).alias("stages"), listed(text_of("j", n, ":\n  stage: s", n, "\n  script: x\n")).alias("jobs"))
    text = F.concat(F.lit("stages: ["), F.array_join("stages", ", "), F.lit("]\n"), F.array_join("jobs", ""))
    ci = rows.select(text_of("r", F.col("n_regionkey")).alias("analysis_id"), F.lit(".gitlab-ci.yml").alias("path"), text.alias("content"))
    return diagrams.workflow(extract_ci.jobs(ci))[1].select("analysis_id", "source_id", "target_id", "label")


# Details of whole tables


def _evidences(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    path, symbol = text_of("src/f", F.col("p_size"), ".cs"), text_of("entity:", F.col("p_brand"))
    return table(spark, d, "part").select(F.lit("job").alias("analysis_id"), text_of("e", k).alias("id"), path.alias("file_path"), F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 3).cast("int").alias("end_line"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("description"), symbol.alias("symbol"), (k % 7 / 10).alias("confidence"))


@query("""
SELECT 'd' || c_custkey AS id, CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END AS n, coalesce('src/f' || p_size || '.cs:' || CAST(p_size AS INT), '') AS place FROM customer LEFT JOIN part ON p_partkey = c_custkey * 3 AND c_custkey % 4 <> 0
""")
def dependency_details(spark, d):
    """Dependencies with the list of their evidence."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(text_of("d", k).alias("id"), F.when(k % 4 != 0, text_of("e", k * 3)).alias("evidence_id"))
    met = details.dependencies_with_evidence(rows, _evidences(spark, d))
    place = F.concat_ws(",", F.transform("evidence", lambda x: F.concat_ws(":", x["file_path"], x["start_line"].cast("string"))))
    return met.select("id", F.size("evidence").alias("n"), place.alias("place"))


@query("""
WITH b AS (SELECT p_brand AS name, min(p_size) AS k FROM part GROUP BY p_brand), e AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS said FROM part)
SELECT 'n' || name AS entity_id, 'e' || e.k AS id, 'src/f' || size || '.cs' AS file_path, CASE WHEN trim(said) = '' THEN 'Defines the ' || name || ' entity.' ELSE said END AS description FROM b JOIN e ON brand = name OR size = b.k
""")
def entity_details(spark, d):
    """The evidence of every entity: what names it, and what lies in the file of its source symbol."""
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("k"))
    entities = brands.select(F.lit("job").alias("analysis_id"), text_of("n", F.col("p_brand")).alias("id"), F.col("p_brand").alias("name"), text_of("s", F.col("p_brand")).alias("source_symbol_id"))
    symbols = brands.select(text_of("s", F.col("p_brand")).alias("id"), text_of("f", F.col("k")).alias("source_file_id"))
    stored = brands.select(text_of("f", F.col("k")).alias("id"), text_of("src/f", F.col("k"), ".cs").alias("path")).distinct()
    return details.entity_evidence(entities, _evidences(spark, d), symbols, stored).select("entity_id", "id", "file_path", "description")


@query("""
SELECT 'c' || c_custkey AS chunk_id, 'job' AS analysis_id, 'f' || c_nationkey AS source_file_id, coalesce(n_name, 'src/f' || p_size || '.cs', '') AS file_path, c_mktsegment AS symbol, coalesce(CAST(p_size AS INT), 1) AS start_line, coalesce(CAST(p_size AS INT) + 3, 1) AS end_line, c_name AS content,
greatest(1, length(c_name) // 4) AS token_count, c_custkey AS chunk_index, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey END AS evidence_id, coalesce(c_custkey % 7 / 10.0 + CASE WHEN p_partkey IS NULL THEN NULL ELSE 0 END, 1.0) AS confidence, c_custkey % 10 / 10.0 AS distance, 1 - c_custkey % 10 / 10.0 AS similarity
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) ON c_nationkey = n_nationkey LEFT JOIN part ON p_partkey = c_custkey AND c_custkey % 2 = 0
""")
def search_rows(spark, d):
    """The fourteen columns of a search row, with what file and evidence of a chunk tell."""
    k = F.col("c_custkey")
    found = table(spark, d, "customer").select(
        text_of("c", k).alias("id"), F.lit("job").alias("analysis_id"), text_of("f", F.col("c_nationkey")).alias("source_file_id"), F.col("c_mktsegment").alias("symbol"), F.col("c_name").alias("content"), F.greatest(F.lit(1), F.floor(F.length("c_name") / 4)).cast("int").alias("token_count"),
        k.alias("chunk_index"), F.when(k % 2 == 0, text_of("e", k)).alias("evidence_id"), (k % 10 / 10).alias("distance"),
    )
    stored = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(text_of("f", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("path"))
    return retrieval.results(retrieval.with_provenance(found, stored, _evidences(spark, d)))


# Services outside an architecture, guards and models


_OUTSIDE = """
WITH k AS (SELECT 'a' || n_nationkey AS a, n_nationkey AS n FROM nation),
s AS (SELECT a, name, row_number() OVER (PARTITION BY a ORDER BY upper(name), 'class:' || name) AS rank FROM (SELECT a, 'AuthService' AS name FROM k WHERE n % 2 = 0 UNION ALL SELECT a, 'UsersService' FROM k WHERE n % 3 = 0 UNION ALL SELECT a, 'EmailService' FROM k WHERE n % 5 < 2 UNION ALL SELECT a, 'RoleGuard' FROM k UNION ALL SELECT a, 'RetryPolicy' FROM k WHERE n % 4 = 0 UNION ALL SELECT a, 'CartModel' FROM k)),
c AS (SELECT a, 'Cart' || i || 'Controller' AS name, i AS rank FROM k, range(1, 7) AS r(i))
"""


@query(_OUTSIDE + """SELECT a AS analysis_id, 'class:' || name AS id, 'symbol' AS category FROM s UNION ALL SELECT a, 'class:' || name, 'controller' FROM c
UNION ALL SELECT DISTINCT a, 'ext-google-oauth', 'external' FROM s WHERE contains(lower(name), 'auth') UNION ALL SELECT DISTINCT a, 'ext-email-provider', 'external' FROM s WHERE contains(lower(name), 'mail')""")
def architecture_nodes(spark, d):
    return diagrams.architecture(*_outside(spark, d))[0].select("analysis_id", "id", "category")


@query(_OUTSIDE + """, p AS (SELECT a, max(CASE WHEN name = 'AuthService' THEN 'class:AuthService' END) AS auth, max(CASE WHEN name = 'UsersService' THEN 'class:UsersService' END) AS usr, max(CASE WHEN name = 'EmailService' THEN 'class:EmailService' END) AS mail FROM s GROUP BY a)
SELECT c.a AS analysis_id, 'class:' || c.name AS source_id, 'class:CartModel' AS target_id, 'Uses Model' AS label FROM c UNION ALL SELECT c.a, 'class:' || c.name, 'class:' || s.name, 'Guarded by' FROM c JOIN s USING (a) WHERE c.rank <= 4 AND s.name IN ('RoleGuard', 'RetryPolicy')
UNION ALL SELECT a, auth, usr, 'Calls' FROM p WHERE auth || usr <> '' UNION ALL SELECT a, auth, mail, 'Dispatches Mail' FROM p WHERE auth || mail <> '' UNION ALL SELECT a, usr, mail, 'Dispatches Mail' FROM p WHERE usr || mail <> ''
UNION ALL SELECT a, auth, 'ext-google-oauth', 'Verifies Token' FROM p WHERE auth <> '' UNION ALL SELECT a, mail, 'ext-email-provider', 'Sends Mail' FROM p WHERE mail <> ''""")
def architecture_external(spark, d):
    return diagrams.architecture(*_outside(spark, d))[1].select("analysis_id", "source_id", "target_id", "label")


def _outside(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation").withColumn("analysis_id", text_of("a", n))
    made = [("AuthService", n % 2 == 0), ("UsersService", n % 3 == 0), ("EmailService", n % 5 < 2), ("RoleGuard", F.lit(True)), ("RetryPolicy", n % 4 == 0), ("CartModel", F.lit(True))]
    nodes = reduce(DataFrame.unionByName, [nation.where(keep).select("analysis_id", F.lit(f"class:{name}").alias("id"), F.lit(name).alias("name"), F.lit("Class").alias("type")) for name, keep in made])
    edges = spark.createDataFrame([], "analysis_id string, source_id string, target_id string, type string, file_path string")
    listed = nation.select("analysis_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("Cart"), i.cast("string"), F.lit("Controller")))).alias("controller"))
    return nodes, edges, listed


# Which architecture diagram an analysis gets, and that of server-rendered applications


@query("""
SELECT 'a' || c_custkey AS analysis_id, CASE c_custkey % 9 WHEN 0 THEN 'spring' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'php' WHEN 4 THEN 'mvc' WHEN 5 THEN 'mvc' WHEN 6 THEN 'mvc' WHEN 7 THEN 'api' ELSE 'universal' END AS kind FROM customer
""")
def architecture_dispatch(spark, d):
    """Languages first, then views, areas or view components, then controllers."""
    k, a = F.col("c_custkey") % 9, text_of("a", F.col("c_custkey")).alias("analysis_id")
    rows = table(spark, d, "customer")
    language = when_chain([(k == 0, "Kotlin"), (k == 1, "Python"), (k == 2, "Go"), (k == 3, "PHP")], "C#")
    path = when_chain([(k == 4, "src/Views/Home/Index.cshtml"), (k == 5, "Areas/Admin/x.cs")], "src/x.cs")
    name = when_chain([(k == 6, "MenuViewComponent"), (k == 8, "Thing")], "HomeController")
    return mvc_diagram.diagram_kind(rows.select(a, language.alias("language")), rows.select(a, path.alias("path")), rows.select(a, name.alias("name")))


_MVC = """
WITH k AS (SELECT 'r' || n_regionkey AS a, n_nationkey AS n, n_regionkey AS r FROM nation), roots AS (SELECT DISTINCT a FROM k),
c0 AS (SELECT a, 'Shop' || n || 'Controller' AS name, n % 3 = 0 AS admin FROM k UNION ALL SELECT a, 'AdminHomeController', TRUE FROM k WHERE r = 1 UNION ALL SELECT a, 'CartController', FALSE FROM k WHERE r < 3 UNION ALL SELECT DISTINCT a, 'HomeController', FALSE FROM k),
c AS (SELECT *, 'ctrl-' || lower(name) AS id, row_number() OVER (PARTITION BY a ORDER BY admin DESC, upper(name), name) AS rank FROM (SELECT DISTINCT * FROM c0)), v AS (SELECT a, 'Menu' || n || 'ViewComponent' AS name, 'vc-menu' || n || 'viewcomponent' AS id, row_number() OVER (PARTITION BY a ORDER BY 'MENU' || n) AS rank FROM k WHERE n % 4 = 0)
"""


def _mvc(spark, d) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, d, "nation")
    n, r, a = F.col("n_nationkey"), F.col("n_regionkey"), text_of("r", F.col("n_regionkey")).alias("analysis_id")
    folder = F.when(n % 3 == 0, "src/Areas/Admin/").otherwise("src/Controllers/")
    made = [
        (nation, text_of("Shop", n, "Controller"), F.concat(folder, n.cast("string"))), (nation.where(r == 1), F.lit("AdminHomeController"), F.lit("src/a.cs")), (nation.where(r < 3), F.lit("CartController"), F.lit("src/b.cs")), (nation, F.lit("HomeController"), F.lit("src/c.cs")),
        (nation.where(n % 4 == 0), text_of("Menu", n, "ViewComponent"), F.lit("src/d.cs")), (nation.where(r != 4), F.lit("ShopContext"), F.lit("src/e.cs")),
    ]
    symbols = reduce(DataFrame.unionByName, [df.select(a, name.alias("name"), F.lit("Class").alias("type"), path.alias("file_path")) for df, name, path in made])
    return mvc_diagram.mvc_architecture(symbols, nation.select(a))


@query(_MVC + """SELECT a AS analysis_id, id, name FROM c UNION ALL SELECT a, id, name FROM v UNION ALL SELECT a, 'node-dbcontext', CASE a WHEN 'r4' THEN 'DbContext' ELSE 'ShopContext' END || ' (EF Core)' FROM roots
UNION ALL SELECT a, x.id, x.name FROM roots, (VALUES ('node-client-browser', 'HTTP Client / Browser'), ('node-mvc-routing', 'ASP.NET Core Routing'), ('node-cookie-auth', 'Cookie Auth & Middleware'), ('node-razor-views', 'Razor Views (.cshtml)'), ('node-static-files', 'Static Files (wwwroot)'), ('node-session-store', 'Session Store'), ('node-database-sql', 'SQL Server Database')) AS x(id, name)""")
def mvc_nodes(spark, d):
    return _mvc(spark, d)[0].select("analysis_id", "id", "name")


@query(_MVC + """SELECT a AS analysis_id, 'node-cookie-auth' AS source_id, id AS target_id, 'Route: /admin [Admin Role]' AS label, 'confirmed' AS state FROM c WHERE admin
UNION ALL SELECT a, 'node-mvc-routing', id, 'Route: /' || CASE name WHEN 'HomeController' THEN '' ELSE replace(name, 'Controller', '') END, 'confirmed' FROM c WHERE NOT admin UNION ALL SELECT a, id, 'node-razor-views', 'Returns View(Model)', 'confirmed' FROM c WHERE rank <= 4
UNION ALL SELECT a, id, 'node-dbcontext', 'Direct DbContext', 'confirmed' FROM c WHERE rank <= 5 UNION ALL SELECT a, id, 'node-session-store', 'Get / Set Session', 'confirmed' FROM c WHERE name = 'CartController'
UNION ALL SELECT a, id, 'node-razor-views', 'Renders in _Layout', 'confirmed' FROM v UNION ALL SELECT a, id, 'node-dbcontext', 'Queries Data', 'confirmed' FROM v
UNION ALL SELECT a, x.s, x.t, x.l, x.c FROM roots, (VALUES ('node-client-browser', 'node-mvc-routing', 'HTTP Request', 'inferred'), ('node-mvc-routing', 'node-cookie-auth', 'Pipeline Auth', 'inferred'), ('node-razor-views', 'node-client-browser', 'HTML Response', 'confirmed'), ('node-static-files', 'node-client-browser', 'CSS / JS / Images', 'confirmed'), ('node-dbcontext', 'node-database-sql', 'SQL / EF Core', 'confirmed')) AS x(s, t, l, c)""")
def mvc_edges(spark, d):
    return _mvc(spark, d)[1]


# Approximate neighbours


@query()
def cosine_ivf_topk(spark, d):
    """Every hundredth vector against all: the five nearest in the nearest cells. Held against the exact answer by a test, with a recall of 0.9 or more."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build(vectors, files.scratch(spark, "cells"), cells=16)
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return ann.search(index, asked, 5, probes=12).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS x FROM embeddings, q)
SELECT query_id, id, round(x, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x, id) <= 5
""")
def cosine_ivf_exact(spark, d):
    """The same index with all of its cells read: the exact answer."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build(vectors, files.scratch(spark, "cells"), cells=16)
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return ann.search(index, asked, 5, probes=16).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")
