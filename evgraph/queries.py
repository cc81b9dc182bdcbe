"""Queries of the engine's own operators over the test tables, each with independent SQL where SQL has a form for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .functions import ids, paths, scores, vectors
from .functions import text as t
from .operators import chunks, classify, diagrams, extract_ci, extract_cs, extract_manifest, extract_ts, graph, grounding, histograms, intervals, listing, ordered, resolve, retrieval, scan
from .sources.files import settle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Aggregation


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in TABLES))
def overview_counts(spark, d):
    return histograms.overview({n: table(spark, d, n) for n in TABLES})


@query("""
SELECT lang AS language, count(*) AS n, sum(greatest(1, length(text) // 4)) AS tokens, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share, 'Unsupported' AS support
FROM documents GROUP BY lang
""")
def language_histogram(spark, d):
    tokens = F.sum(t.token_estimate(F.col("text"))).alias("tokens")
    return histograms.language_shares(table(spark, d, "documents"), "lang", tokens)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark, d):
    return histograms.by_type(table(spark, d, "events"), "event_type")


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, bool_or(o_totalprice > 400000) AS any_large, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderpriority
""")
def conditional_counts(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))
    )


# Listing, paging, details


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def page_orders(spark, d):
    return listing.page_of(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], page=3).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT count(*) AS total_count, 3 AS page, 50 AS page_size, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM orders")
def page_totals(spark, d):
    return listing.page_counts(table(spark, d, "orders"), 3)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'widget') AND contains(lower(p_type), 'eco')")
def list_filter_ci(spark, d):
    return table(spark, d, "part").where(listing.has_text("p_name", "WIDget") & listing.has_text("p_type", "eco")).select("p_partkey", "p_name", "p_type")


@query("SELECT page_id, url FROM pages WHERE lower(split_part(url, '/', 4)) IN ('typescript', 'ts') OR ends_with(lower(url), '.ts') OR lower(split_part(url, '/', 4)) = 'de' OR ends_with(lower(url), '.de')")
def language_filter(spark, d):
    language = F.split_part("url", F.lit("/"), F.lit(4))
    either = listing.of_language(language, F.col("url"), "ts") | listing.of_language(language, F.col("url"), "de")
    return table(spark, d, "pages").where(either).select("page_id", "url")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def enum_filter(spark, d):
    orders = table(spark, d, "orders")
    known = ("F", "O", "P")
    return orders.where(listing.of_kind("o_orderstatus", "f", known) & listing.of_kind("o_orderstatus", "unknown", known)).select("o_orderkey", "o_orderpriority")


_EDGES = "SELECT 'supplier:' || s_suppkey AS source_id, 'nation:' || s_nationkey AS target_id FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer"


def place_edges(spark, d) -> DataFrame:
    """Edges of suppliers and customers to nations, and of nations to regions, with the order they come in."""

    def edges(name: str, key: str, to: str, to_key: str, rank: int) -> DataFrame:
        df = table(spark, d, name)
        return df.select(F.concat(F.lit(f"{name}:"), key).alias("source_id"), F.concat(F.lit(f"{to}:"), to_key).alias("target_id"), (F.col(key) * 3 + rank).cast("long").alias("seq"))

    return edges("supplier", "s_suppkey", "nation", "s_nationkey", 0).union(edges("nation", "n_nationkey", "region", "n_regionkey", 1)).union(edges("customer", "c_custkey", "nation", "c_nationkey", 2))


@query(f"""
WITH e AS ({_EDGES}) SELECT 'inbound' AS direction, source_id, target_id FROM e WHERE target_id = 'nation:7'
UNION ALL SELECT 'outbound', source_id, target_id FROM e WHERE source_id = 'nation:7' UNION ALL SELECT 'both', source_id, target_id FROM e WHERE source_id = 'nation:7' OR target_id = 'nation:7'
""")
def direction_filter(spark, d):
    edges = place_edges(spark, d).drop("seq")
    parts = [edges.where(listing.in_direction(F.col("source_id"), F.col("target_id"), F.lit("nation:7"), way)).select(F.lit(way).alias("direction"), "*") for way in ("inbound", "outbound", "both")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""
SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS customer, coalesce(n_name, 'unknown') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def detail_left_joins(spark, d):
    solvent = table(spark, d, "customer").where("c_acctbal > 0")
    named = listing.with_names(table(spark, d, "orders"), "o_custkey", solvent, "c_custkey", "c_name", "customer")
    placed = named.join(solvent.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    nation = table(spark, d, "nation")
    return placed.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "customer", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def name_fallback_lookup(spark, d):
    known = table(spark, d, "nation").where("n_nationkey < 20")
    return listing.with_names(table(spark, d, "supplier"), "s_nationkey", known, "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey % 5 <> 0 GROUP BY ALL")
def collect_children(spark, d):
    nation = table(spark, d, "nation").where("n_nationkey % 5 <> 0")
    nested = listing.with_children(table(spark, d, "region"), nation, F.col("r_regionkey") == F.col("n_regionkey"), ["r_regionkey", "r_name"], ["n_name", "n_nationkey"], "children")
    return nested.select("r_regionkey", "r_name", F.array_join(F.transform("children", lambda c: c["n_name"]), ",").alias("nations"))


@query(f"WITH e AS ({_EDGES}), n AS (SELECT 'nation:' || n_nationkey AS node FROM nation WHERE n_regionkey = 1) SELECT DISTINCT source_id, target_id, node FROM e JOIN n ON source_id = node OR target_id = node")
def or_join_split(spark, d):
    nodes = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation:"), "n_nationkey").alias("node"))
    return listing.touching(place_edges(spark, d).drop("seq"), nodes, "source_id", "target_id", "node")


@query("SELECT o_orderkey, coalesce(c_name, n_name, 'none') AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey LEFT JOIN nation ON o_custkey = n_nationkey")
def reference_cascade(spark, d):
    even = table(spark, d, "customer").where("c_custkey % 2 = 0")
    lookups = [(F.col("o_custkey"), even, "c_custkey", "c_name"), (F.col("o_custkey"), table(spark, d, "nation"), "n_nationkey", "n_name")]
    return listing.first_by_cascade(table(spark, d, "orders"), lookups, "owner").select("o_orderkey", F.coalesce("owner", F.lit("none")).alias("owner"))


# Order, dedup, caps


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_per_key(spark, d):
    return ordered.first_per_key(table(spark, d, "events"), F.col("user_id"), ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_per_key(spark, d):
    return ordered.first_per_key(table(spark, d, "events"), F.col("user_id"), ["ts", "event_id"], last=True).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, lower(event_type), CAST(json_extract(props, '$.k') AS BIGINT) % 10 ORDER BY event_id) = 1")
def edge_dedup_ci(spark, d):
    events = table(spark, d, "events").withColumn("to", F.get_json_object("props", "$.k").cast("long") % 10)
    shouted = events.withColumn("kind", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return ordered.first_per_key_ci(shouted, [F.col("user_id").cast("string"), F.col("kind"), F.col("to").cast("string")], ["event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 500")
def edge_cap(spark, d):
    return ordered.cap(table(spark, d, "events"), [F.desc("value"), "event_id"], 500).select("event_id", "value")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 4")
def topn_per_group(spark, d):
    return ordered.top_per_group(table(spark, d, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 4).select("p_brand", "p_partkey", "p_retailprice")


@query("""
WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_name AS label, 1 AS size FROM r WHERE k <= 12 UNION ALL SELECT DISTINCT p_brand, '+' || (n - 12) || ' more', n - 12 FROM r WHERE n > 12
""")
def overflow_bucket(spark, d):
    return ordered.overflow(table(spark, d, "part"), ["p_brand"], "p_name", ["p_partkey"], 12)


@query("""
WITH k AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents WHERE n_chars <= 20000) SELECT doc_id, source, n_chars, CAST(running AS BIGINT) AS running FROM k WHERE running <= 100000
""")
def running_limit(spark, d):
    return ordered.within_running_total(table(spark, d, "documents"), ["source"], ["doc_id"], F.col("n_chars"), 20_000, 100_000).select("doc_id", "source", "n_chars", "running")


@query("SELECT c_custkey, 'fallback:' || c_nationkey AS target FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def orphan_anti_join(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 300000")
    orphans = ordered.without_match(table(spark, d, "customer"), large, F.col("c_custkey") == F.col("o_custkey"))
    return orphans.select("c_custkey", F.concat(F.lit("fallback:"), "c_nationkey").alias("target"))


@query("SELECT min(n_name) AS name FROM (SELECT n_name FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT r_name FROM region) GROUP BY lower(n_name)")
def union_distinct_ci(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    every = nation.union(nation.select(F.lower("name"))).union(table(spark, d, "region").select("r_name"))
    return ordered.first_per_key(every, F.lower("name"), ["name"])


# Intervals and prefixes


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages), o(root, owner) AS (VALUES ('', 'site'), ('en', 'english'), ('de', 'german'))
SELECT page_id, arg_max(owner, length(root)) AS owner FROM p JOIN o ON root = '' OR starts_with(lower(path), root || '/') GROUP BY page_id
""")
def longest_prefix_match(spark, d):
    files = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/", "").alias("path"))
    owners = spark.createDataFrame([("", "site"), ("en", "english"), ("de", "german")], "root string, owner string")
    return intervals.longest_prefix(files, "path", owners, "root", ["owner"]).select("page_id", "owner")


@query("""
WITH e AS (SELECT event_id, user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, event_type FROM events),
s AS (SELECT user_id, event_id AS span_id, sec AS b, sec + 86400 AS f FROM e WHERE event_type = 'signup')
SELECT event_id, arg_max(span_id, (b, span_id)) AS span_id FROM e JOIN s USING (user_id) WHERE sec BETWEEN b AND f AND event_type <> 'signup' GROUP BY event_id
""")
def enclosing_interval(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("b"), (F.col("at") + 86400).alias("f"))
    inside = intervals.enclosing(events.where("event_type <> 'signup'"), spans, ["user_id"], "at", "b", "f", F.struct("b", "span_id"))
    return inside.select("event_id", "span_id")


_SPANS = """
WITH o AS (SELECT o_custkey AS k, o_orderkey, datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS b, o_totalprice FROM orders),
a AS (SELECT k, o_orderkey AS x, b AS xb, b + 30 AS xe FROM o), c AS (SELECT k, o_orderkey AS y, b AS yb, b + 60 AS ye, o_totalprice FROM o)
"""


def _order_spans(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("b"), "o_totalprice")
    return o.select("k", F.col("o_orderkey").alias("x"), F.col("b").alias("xb"), (F.col("b") + 30).alias("xe")), o.select("k", F.col("o_orderkey").alias("y"), F.col("b").alias("yb"), (F.col("b") + 60).alias("ye"), "o_totalprice")


@query(_SPANS + "SELECT x, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM a JOIN c USING (k) WHERE xb <= ye AND xe >= yb GROUP BY x")
def interval_overlap(spark, d):
    a, c = _order_spans(spark, d)
    met = intervals.overlapping(a, c, ["k"], "xb", "xe", "yb", "ye")
    return met.groupBy("x").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query(_SPANS + "SELECT xb // 365 AS year, count(*) AS n FROM a JOIN c USING (k) WHERE xb <= ye AND xe >= yb GROUP BY year")
def interval_overlap_binned(spark, d):
    a, c = _order_spans(spark, d)
    met = intervals.overlapping_by_bin(a, c, ["k"], "xb", "xe", "yb", "ye", 60)
    return met.groupBy(F.floor(F.col("xb") / 365).alias("year")).agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS word FROM pages) SELECT word AS name, count(*) AS n FROM w WHERE word IN ('article', 'nav', 'track', 'absent') GROUP BY word
""")
def text_mentions(spark, d):
    names = spark.createDataFrame([("article",), ("nav",), ("track",), ("absent",)], "name string")
    return intervals.mentions(table(spark, d, "pages").select("page_id", "html"), "html", F.broadcast(names), "name").groupBy("name").agg(F.count("*").alias("n"))


# Scalar and text functions


_GUID = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '-' || substr(h, 11, 2) || substr(h, 9, 2) || '-' || substr(h, 15, 2) || substr(h, 13, 2) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"SELECT doc_id, {_GUID} AS id FROM (SELECT doc_id, sha256('file:job:' || source || '/' || doc_id) AS h FROM documents)")
def sha_guid(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", ids.guid(ids.key("file", F.lit("job"), path)).alias("id"))


@query("SELECT doc_id, sha256(text) AS hash, strlen(text) AS size FROM documents")
def file_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"))


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '***MASKED***', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer ***MASKED***', 'g'),
'\bsk-[A-Za-z0-9_-]{8,}', '***MASKED***', 'g'), '(?i)\b(password|pwd|uid|user id)\s*=\s*[^;"''\s]+', '\1=***MASKED***', 'g'),
'(?i)\b(api[_-]?key|token|secret|client[_-]?secret)\b(\s*[:=]\s*)(["''])[^"'']+["'']', '\1\2\3***MASKED***\3', 'g')"""


@query(f"SELECT doc_id, sha256({_MASKED}) AS masked_sha256, {_MASKED} <> text AS had_secret FROM documents")
def mask_secrets(spark, d):
    masked = t.mask_secrets(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha256"), (masked != F.col("text")).alias("had_secret"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN '[No snippet available]' WHEN length(trim(m)) > 1000 THEN left(trim(m), 997) || '...' ELSE trim(m) END AS snippet FROM (SELECT doc_id, text, " + _MASKED + " AS m FROM documents)")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", t.snippet(F.col("text")).alias("snippet"))


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM conversations),
s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(line, '([.!?])\s+([A-Z0-9`"''])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9`"''])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM l)
SELECT conv_id, turn, count(*) AS n, sum(length(trim(x))) AS chars FROM s WHERE trim(x) <> '' GROUP BY ALL
""")
def split_sentences(spark, d):
    cut = t.sentences(F.col("text"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    rows = table(spark, d, "conversations").select("conv_id", "turn", cut.alias("s")).where(F.size("s") > 0)
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n"), total.alias("chars"))


@query(r"""
SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS n_links, len(list_distinct(regexp_extract_all(html, '(?i)([a-z0-9_./\\-]+\.(?:csproj|cs|ts|json|js|xml|sln|sql|md|yml|yaml))\b', 1))) AS n_files FROM pages
""")
def extract_refs(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.size(t.file_references(F.col("html"))).cast("long").alias("n_files"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, host, CASE WHEN regexp_replace(path, '[?#].*$', '') = '' THEN '/' ELSE regexp_replace(path, '[?#].*$', '') END AS route FROM p
""")
def extract_routes(spark, d):
    route = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), F.when(route == "", "/").otherwise(route).alias("route"))


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS version FROM events")
def json_map_entries(spark, d):
    entries = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    return table(spark, d, "events").select("event_id", entries).select("event_id", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


@query(r"""
SELECT doc_id, CAST(length(m) AS BIGINT) AS chars, len(regexp_split_to_array(text, '\r\n|\r|\n')) AS end_line, greatest(1, length(m) // 4) AS token_count FROM (SELECT doc_id, text, """ + _MASKED + " AS m FROM documents)")
def whole_file_chunk(spark, d):
    whole = chunks.whole_files(table(spark, d, "documents"), ["doc_id"], "text")
    return whole.select("doc_id", F.length("content").cast("long").alias("chars"), F.col("end_line").cast("long").alias("end_line"), F.col("token_count").cast("long").alias("token_count"))


def _as_markdown(spark, d):
    """Documents whose lines that start with 'The ' or 'Der ' are headings: the test texts have none."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^(The|Der|La|Le) ", "## $1 ").alias("text"))


@query(r"""
WITH f AS (SELECT doc_id, regexp_replace(text, '(?m)^(The|Der|La|Le) ', '## \1 ', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS no FROM f),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM l)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INT) AS section, CAST(min(no) AS INT) AS start_line, CAST(max(no) AS INT) AS end_line, sha256(string_agg(line, chr(10) ORDER BY no)) AS sha FROM g GROUP BY doc_id, part
""")
def markdown_sections(spark, d):
    cut = chunks.markdown_sections(_as_markdown(spark, d), ["doc_id"], "text")
    return cut.select("doc_id", "section", "start_line", "end_line", F.sha2("content", 256).alias("sha"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 5 WHEN o_orderpriority = '2-HIGH' THEN 65 WHEN o_orderpriority = '3-MEDIUM' THEN 100 ELSE 10 END AS percent FROM orders")
def stage_progress(spark, d):
    p = F.col("o_orderpriority")
    stage = F.when(p == "1-URGENT", "Validation").when(p == "2-HIGH", "StaticAnalysis").when(p == "3-MEDIUM", "Completed").otherwise("Chunking")
    return table(spark, d, "orders").select("o_orderkey", scores.progress(stage, F.col("o_orderstatus") == "F").alias("percent"))


@query("SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS name, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder, upper(p) AS sort_key FROM (SELECT page_id, trim(replace(url, chr(92), '/')) AS p FROM pages)")
def path_parts(spark, d):
    p = paths.normal(F.col("url"))
    return table(spark, d, "pages").select("page_id", paths.file_name(p).alias("name"), paths.directory(p).alias("folder"), F.upper(p).alias("sort_key"))


# Vectors


@query("""
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 5
""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id = 0").first()["embedding"]
    return retrieval.top_k(e, asked, dimension=len(asked)).select("id", F.round("distance", 6).alias("distance"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS x FROM embeddings, q)
SELECT query_id, id, round(x, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x, id) <= 5
""")
def cosine_matrix_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_each(e, asked, 5).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))


_RAW = ", ".join(f"CAST(('0x' || substr(h, {2 * i + 1}, 2))::INT AS FLOAT) / 255.0::FLOAT * 2 - 1" for i in range(32))


@query(f"""
WITH v AS (SELECT doc_id, [{_RAW}]::DOUBLE[] AS r FROM (SELECT doc_id, sha256(text) AS h FROM documents)), n AS (SELECT doc_id, r, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS s FROM v)
SELECT doc_id, round(r[1] / s, 4) AS first, round(r[32] / s, 4) AS last, 32 AS size FROM n
""")
def embed_deterministic(spark, d):
    v = table(spark, d, "documents").select("doc_id", vectors.embed(F.col("text"), 32).alias("v"))
    return v.select("doc_id", F.round(F.element_at("v", 1).cast("double"), 4).alias("first"), F.round(F.element_at("v", -1).cast("double"), 4).alias("last"), F.size("v").alias("size"))


# Evidence, answers


_EVIDENCE = """(SELECT d.doc_id AS id, source AS file_path, lang AS symbol, CAST(n_chars % 100 AS INT) AS start_line, text AS description, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.3 END AS confidence
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _evidence(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "l_doc_id")
    confidence = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.3)
    return docs.join(labels, F.col("doc_id") == F.col("l_doc_id"), "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("file_path"), F.col("lang").alias("symbol"), (F.col("n_chars") % 100).cast("int").alias("start_line"), F.col("text").alias("description"), confidence.alias("confidence")
    )


@query(f"""
WITH f AS (SELECT * FROM {_EVIDENCE} WHERE contains(file_path, 'src1') AND contains(symbol, 'en') ORDER BY file_path, start_line, id LIMIT 20), k AS (SELECT * FROM f WHERE coalesce(confidence, 1.0) >= 0.5)
SELECT count(*) AS n, round_even(avg(coalesce(confidence, 1.0)), 6) AS mean_confidence, CASE WHEN count(*) = 0 THEN 'Zero' WHEN avg(coalesce(confidence, 1.0)) >= 0.8 THEN 'High' WHEN avg(coalesce(confidence, 1.0)) >= 0.5 THEN 'Medium' ELSE 'Low' END AS band FROM k
""")
def evidence_retrieve(spark, d):
    return retrieval.evidence_band(retrieval.evidence(_evidence(spark, d), "src1", "en", None, 0.5))


@query("""
WITH e AS (SELECT event_id, value / 1000 AS s, (event_id % 5) / 4.0 AS m, event_id % 4 AS n, CASE event_id % 4 WHEN 0 THEN 'FullySupported' WHEN 1 THEN 'PartiallySupported' WHEN 2 THEN 'Unsupported' ELSE 'InsufficientEvidence' END AS st, event_id % 3 = 0 AS rej FROM events),
q AS (SELECT *, 0.4 * least(greatest(s, 0), 1) + 0.4 * least(greatest(m, 0), 1) + 0.2 * CASE WHEN n >= 3 THEN 1.0 WHEN n = 2 THEN 0.9 ELSE 0.8 END AS ql,
CASE st WHEN 'Unsupported' THEN 0 WHEN 'PartiallySupported' THEN 0.7 * CASE WHEN rej THEN 0.9 ELSE 1 END WHEN 'FullySupported' THEN CASE WHEN rej THEN 0.85 ELSE 1 END ELSE 0.2 END AS g FROM e),
r AS (SELECT *, least(greatest(ql * g, 0), 1) AS raw, st = 'PartiallySupported' OR rej AS lim FROM q), x AS (SELECT *, CASE WHEN n = 0 THEN 0.1 WHEN lim THEN least(raw, 0.7) ELSE raw END AS sc FROM r)
SELECT event_id, round(sc, 6) AS score, CASE WHEN n = 0 OR st = 'Unsupported' THEN 'Low' WHEN lim THEN CASE WHEN sc >= 0.45 THEN 'Medium' ELSE 'Low' END WHEN sc >= 0.75 THEN 'High' WHEN sc >= 0.45 THEN 'Medium' ELSE 'Low' END AS level FROM x
""")
def confidence_score(spark, d):
    k = F.col("event_id") % 4
    state = F.when(k == 0, "FullySupported").when(k == 1, "PartiallySupported").when(k == 2, "Unsupported").otherwise("InsufficientEvidence")
    score, level = grounding.confidence(F.col("value") / 1000, (F.col("event_id") % 5) / 4.0, k, state, F.lit(0.5), F.col("event_id") % 3 == 0)
    return table(spark, d, "events").select("event_id", F.round(score, 6).alias("score"), level.alias("level"))


# Graph


@query(f"""
WITH e AS ({_EDGES}), n AS (SELECT source_id AS node, target_id AS down, NULL AS up FROM e UNION ALL SELECT target_id, NULL, source_id FROM e)
SELECT node, coalesce(string_agg(DISTINCT up, ',' ORDER BY up), '') AS upstream, coalesce(string_agg(DISTINCT down, ',' ORDER BY down), '') AS downstream FROM n WHERE starts_with(node, 'nation') OR starts_with(node, 'region') GROUP BY node
""")
def neighbour_cards(spark, d):
    cards = graph.neighbours(place_edges(spark, d)).where(F.col("node").startswith("nation") | F.col("node").startswith("region"))
    return cards.select("node", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query(f"""
WITH RECURSIVE e AS (SELECT source_id AS u, target_id AS v FROM ({_EDGES}) UNION SELECT target_id, source_id FROM ({_EDGES})),
w AS (SELECT 0 AS step, 'supplier:3' AS node UNION SELECT step + 1, v FROM w JOIN e ON u = node WHERE step < 6)
SELECT coalesce(min(step), 1) AS distance FROM w WHERE node = 'customer:1'
""")
def trace_distance(spark, d):
    return graph.trace(place_edges(spark, d), "supplier:3", "customer:1").agg(F.max("step").cast("long").alias("distance"))


@query(f"WITH e AS ({_EDGES}), n AS (SELECT source_id AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_id, 0, 1 FROM e) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM n GROUP BY node")
def node_degrees(spark, d):
    return graph.degrees(place_edges(spark, d))


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events),
g AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k
""")
def event_session(spark, d):
    grouped = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_window(spark, d):
    grouped = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


# Scans, facts and the graph, over source files written from the tables


@query("""
WITH f AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'src/a' || doc_id || '.cs' WHEN 1 THEN 'web/b' || doc_id || '.tsx' WHEN 2 THEN 'docs/c' || doc_id || '.md' WHEN 3 THEN 'node_modules/d' || doc_id || '.js'
WHEN 4 THEN 'bin/e.cs' WHEN 5 THEN 'src/f' || doc_id || '.g.cs' WHEN 6 THEN 'x/.env.local' ELSE 'y/appsettings.Dev.json' END AS path, strlen(text) AS size, text FROM documents)
SELECT doc_id, path, CASE doc_id % 8 WHEN 0 THEN 'CSharp' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Documentation' ELSE 'Configuration' END AS category,
CASE doc_id % 8 WHEN 0 THEN 'C#' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Markdown' ELSE 'JSON' END AS language, sha256(text) AS hash
FROM f WHERE doc_id % 8 IN (0, 1, 2, 7) AND size <= 60000
""")
def scan_files(spark, d):
    return scan.sources(_as_files(spark, d), most_files=10**9, most_file=60_000, most_all=10**15)[0].select("doc_id", "path", "category", "language", "hash")


def _as_files(spark, d):
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 8
    names = [("src/a", ".cs"), ("web/b", ".tsx"), ("docs/c", ".md"), ("node_modules/d", ".js"), None, ("src/f", ".g.cs")]
    path = F.when(k == 4, "bin/e.cs").when(k == 6, "x/.env.local").when(k == 7, "y/appsettings.Dev.json")
    for i, x in enumerate(names):
        path = path if x is None else F.when(k == i, F.concat(F.lit(x[0]), n, F.lit(x[1]))).otherwise(path)
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


@query("""
WITH p AS (SELECT page_id, lower(url) AS u FROM pages), t AS (SELECT page_id, CASE WHEN contains(u, 'controller') OR contains(u, 'handler') OR contains(u, 'route') OR contains(u, 'api') OR contains(u, 'view') THEN 0
WHEN contains(u, 'service') OR contains(u, 'usecase') OR contains(u, 'manager') OR contains(u, 'core') OR contains(u, 'domain') OR contains(u, 'logic') THEN 1
WHEN contains(u, 'repo') OR contains(u, 'storage') OR contains(u, 'db') OR contains(u, 'model') OR contains(u, 'entity') THEN 2 END AS tier FROM p) SELECT coalesce(tier, -1) AS tier, count(*) AS n FROM t GROUP BY ALL
""")
def tier_by_keyword(spark, d):
    return table(spark, d, "pages").groupBy(F.coalesce(rules.tier(F.col("url"), "universal"), F.lit(-1)).alias("tier")).agg(F.count("*").alias("n"))


def _sources(spark, d):
    """Source files: a C# class for each supplier, an interface for each nation, a TypeScript module for each customer, a manifest for each part."""
    job = F.lit("job").alias("analysis_id")
    line = lambda *parts: F.concat_ws("", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    s, n, c = F.col("s_suppkey"), F.col("s_nationkey"), F.col("c_custkey")
    classes = table(spark, d, "supplier").select(
        job, line("src/S", s, ".cs").alias("path"),
        line("namespace App;\npublic class S", s, " : INation", n, "\n{\n    private readonly INation", F.pmod(n + 1, F.lit(25)), " _other;\n    [HttpGet(\"x\")] public void Run() { _other.Go(); }\n}\n").alias("content"),
    )
    interfaces = table(spark, d, "nation").select(job, line("src/INation", F.col("n_nationkey"), ".cs").alias("path"), line("namespace App;\npublic interface INation", F.col("n_nationkey"), " { void Go(); }\n").alias("content"))
    modules = table(spark, d, "customer").select(
        job, line("web/c", c, ".ts").alias("path"), line("import a from 'm", F.col("c_nationkey"), "'\n/* export class Gone {}\n*/\nexport class C", c, " {}\nrouter.get('/c/", c, "', f)\n").alias("content")
    )
    packages = table(spark, d, "part").select("p_partkey", job, line("p", F.col("p_partkey"), "/package.json").alias("path"), line('{"dependencies": {"', F.col("p_name"), '": "', F.col("p_size"), '"}}').alias("content"))
    return classes, interfaces, modules, packages


@query("""
SELECT 'web/c' || c_custkey || '.ts' AS path, 1 AS line, 'import' AS fact, 'm' || c_nationkey AS name FROM customer UNION ALL SELECT 'web/c' || c_custkey || '.ts', 4, 'symbol', 'C' || c_custkey FROM customer
UNION ALL SELECT 'web/c' || c_custkey || '.ts', 5, 'route', '/c/' || c_custkey FROM customer
""")
def typescript_facts(spark, d):
    return extract_ts.facts(_sources(spark, d)[2]).select("path", "line", "fact", "name")


@query("SELECT 'p' || p_partkey || '/package.json' AS path, p_name AS name, CAST(p_size AS VARCHAR) AS version, 1 AS line FROM part")
def npm_packages(spark, d):
    return extract_manifest.npm(_sources(spark, d)[3])[0].select("path", "name", "version", "line")


@query("""
SELECT 'S' || s_suppkey AS name, 'base' AS fact, 'INation' || s_nationkey AS target FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'dependency', 'INation' || (s_nationkey + 1) % 25 FROM supplier
UNION ALL SELECT 'S' || s_suppkey || '.Run', 'call', 'Go' FROM supplier
""")
def csharp_facts(spark, d):
    return extract_cs.facts(_sources(spark, d)[0]).where("fact IN ('base', 'dependency', 'call')").select("name", "fact", "target")


@query("""
SELECT 'class:S' || s_suppkey AS source_id, 'Implements' AS type, 'interface:INation' || s_nationkey AS target_id FROM supplier UNION ALL SELECT 'class:S' || s_suppkey, 'DependsOn', 'interface:INation' || (s_nationkey + 1) % 25 FROM supplier
UNION ALL SELECT 'file:web/c' || c_custkey || '.ts', 'DependsOn', 'module:m' || c_nationkey FROM customer UNION ALL SELECT 'file:web/c' || c_custkey || '.ts', 'Exposes', 'endpoint:get:/c/' || c_custkey FROM customer
UNION ALL SELECT 'file:web/c' || c_custkey || '.ts', 'Contains', 'class:C' || c_custkey FROM customer
""")
def repository_graph(spark, d):
    """Edges of the files' graph, but for those between members."""
    classes, interfaces, modules, _ = _sources(spark, d)
    _, edges = resolve.graph([resolve.csharp(settle(extract_cs.facts(classes.union(interfaces)), "cs-facts")), resolve.typescript(settle(extract_ts.facts(modules), "ts-facts"))])
    outside = F.col("type").isin("Implements", "DependsOn", "Exposes") | (F.col("source_id").startswith("file:web") & (F.col("type") == "Contains"))
    return edges.where(outside).select("source_id", "type", "target_id")


@query("SELECT 'j' || n_nationkey AS job, CASE WHEN n_nationkey % 2 = 1 THEN 'first' ELSE '' END AS needs, 'n' || n_regionkey AS runs_on FROM nation UNION ALL SELECT 'first', '', 'u' FROM nation")
def workflow_jobs(spark, d):
    """An analysis for each nation, as the reference reads three workflow files of one analysis."""
    return _jobs(table(spark, d, "nation"), F.concat(F.lit("job"), "n_nationkey"))


def _jobs(nations, analysis):
    n = F.col("n_nationkey")
    text = F.concat(F.lit("name: W\non: [push]\njobs:\n  first:\n    runs-on: u\n  j"), n, F.when(n % 2 == 1, ":\n    needs: [first]\n    runs-on: n").otherwise(":\n    runs-on: n"), F.col("n_regionkey"), F.lit("\n"))
    files = nations.select(analysis.alias("analysis_id"), F.concat(F.lit(".github/workflows/w"), n, F.lit(".yml")).alias("path"), text.alias("content"))
    return extract_ci.jobs(files).select("job", F.array_join("needs", ",").alias("needs"), "runs_on")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 7 = 0 THEN 'ui' WHEN c_nationkey % 7 = 1 THEN 'policy' WHEN c_nationkey % 7 = 2 THEN 'data' WHEN c_nationkey % 7 = 3 THEN 'external' ELSE 'runtime' END AS lane FROM customer")
def node_lanes(spark, d):
    k = F.col("c_nationkey") % 7
    name = F.when(k == 0, "OrderController").when(k == 1, "AuthGuard").when(k == 2, "OrderRepository").when(k == 3, "RedisCache").otherwise("AuthGuardService")
    return table(spark, d, "customer").select("c_custkey", diagrams.lane(name).alias("lane"))


@query("""
WITH f AS (SELECT c_custkey, c_custkey % 2 = 0 AS ep, c_custkey % 3 = 0 AS co, c_custkey % 5 = 0 AS re, c_custkey % 7 = 0 AS py, c_custkey % 11 = 0 AS pr, c_custkey % 13 = 0 AS mono FROM customer)
SELECT c_custkey, CASE WHEN NOT (ep OR co OR re OR py OR pr OR mono) THEN 'Unsupported' WHEN mono THEN 'Monorepo' WHEN ep AND NOT re OR co THEN 'ApiBackend' WHEN re THEN 'Frontend' WHEN py THEN 'ApiBackend' WHEN pr THEN 'Cli' ELSE 'Unsupported' END AS repository_type FROM f
""")
def classify_cascade(spark, d):
    by = lambda m: F.col("c_custkey") % m == 0
    no = F.lit(False)
    languages = F.filter(F.array(F.when(by(7), "Python"), F.when(by(5), "JavaScript"), F.when(by(11) | by(13), "C#")), lambda x: x.isNotNull())
    flagged = table(spark, d, "customer").select(
        "c_custkey", languages.alias("languages"), F.when(by(13), 2).when(by(11), 1).otherwise(0).alias("n_csproj"), F.lit(0).alias("n_npm"), F.when(by(13), 2).otherwise(0).alias("n_projects"), F.when(by(2), 3).otherwise(0).alias("n_endpoints"),
        by(3).alias("controllers"), by(5).alias("react"), by(7).alias("python"), by(11).alias("program"), *(no.alias(c) for c in "next vue angular routes express java go php rust context references relations library".split()),
    )
    return classify.decide(flagged).select("c_custkey", "repository_type")
