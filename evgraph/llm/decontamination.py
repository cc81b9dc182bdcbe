"""Benchmark decontamination: prefix-filtered set join, in DataFrame operations only.

Words are maximal runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z. An item's
windows are its runs of WINDOW words, or the whole item if it has fewer. Items and windows
are sets of shingles (SHINGLE words, or the whole item if it has fewer), each at an offset.

1. Occurrences of benchmark shingles in the documents and their numbers of words: one scan, no exchange (the benchmark side is
   broadcast if its counted size is within BROADCAST_SHINGLES; otherwise both sides shuffle, and words are counted in a scan of their own).
2. Shingles are ordered by rarity in the documents. A window occurs only where all its
   shingles do, so its necessary prefix is one shingle, the rarest.
3. Occurrences of prefix shingles give candidate diagonals (document, item, position less
   offset), within the bounds that position and length set on where a window can begin and end.
4. On candidate diagonals, the shingles of the windows that the prefix stands for are looked up by document and position, so common
   shingles meet no item but those of candidates: runs of consecutive offsets as long as a window's
   shingles are exact occurrences. Shingles are compared as words, not as hashes.

Defined results: null texts have no words; items without words are never matched; documents without
hits have 0, 0 and the digest of the empty string; repeated rows give repeated results; rows
with equal doc_id and other texts are apart; null item_ids count as an item that has no id in the digest. Other columns, whatever their
names, are kept by remove_contaminated (which keeps rows with null ids or texts unless contaminated) and ignored else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, put_back, set_aside

WINDOW = 13
SHINGLE = 3
BROADCAST_SHINGLES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "text_hash"]
#: Stands for a document among the hashes of its shingles; a shingle with this hash is told from it by its words.
WHOLE = 0


def word_list(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _shingle_hashes(words: str, q: int) -> Column:
    """The hash of the q words from each position on; none in a shorter text."""
    one = {1: lambda i: F.xxhash64(F.get(words, i)), 2: lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)), 3: lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))}
    return F.when(F.size(words) >= q, F.transform(F.sequence(F.lit(0), F.size(words) - q), one[q])).otherwise(F.array().cast("array<long>"))


def benchmark_shingles(items: DataFrame) -> DataFrame:
    """item (row number of the distinct item), item_id, q, offset, shingle (words), need (a window's shingles), n_item."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode_outer(F.array(word_list("text"))).alias("words")).where(F.size("words") > 0)
    split = split.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item_id", "words"])
    q = F.least(F.size("words"), F.lit(SHINGLE))
    length = F.least(F.size("words"), F.lit(WINDOW))
    sized = split.withColumn("q", q).withColumn("need", length - q + 1).withColumn("n_shingles", F.size("words") - F.col("q") + 1)
    return sized.select(
        "item", "item_id", "q", "need", "n_shingles", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_shingles") - 1), lambda i: F.slice("words", i + 1, F.col("q")))).alias("offset", "shingle")
    )


def occurrences(docs: DataFrame, shingles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n_words, at, sid of each occurrence of a benchmark shingle; doc_id, text_hash and n_words of each document."""
    known = shingles.select("sid", "q", "shingle").distinct()
    small = known.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    lengths = sorted(r["q"] for r in known.select("q").distinct().collect())  # at most SHINGLE values
    # A generator's output is computed once: an alias would be copied into every lambda that names it. The outer
    # forms keep the optimizer from computing the arrays a second time in a filter.
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode_outer(F.array(word_list("text"))).alias("words"))
    count = F.size("words")
    # The hashes of all lengths stand in one array, those of a length after those of the lengths before it. The first
    # hash of all is WHOLE, whose occurrence stands for the document.
    spread = words.select(*KEY, "words", F.posexplode_outer(F.concat(F.array(F.lit(WHOLE)), *(_shingle_hashes("words", q) for q in lengths))).alias("place", "hash"))
    begin, begins = F.lit(1), []
    for q in lengths:
        begins.append((q, begin))
        begin = begin + F.greatest(count - q + 1, F.lit(0))
    at = reduce(lambda other, x: F.when(F.col("q") == x[0], F.col("place") - x[1]).otherwise(other), begins, F.lit(-1))
    hashed = reduce(lambda other, q: F.when(F.col("q") == q, F.xxhash64(*(F.get("shingle", F.lit(j)) for j in range(q)))).otherwise(other), lengths, F.lit(WHOLE))
    side = known.select("sid", "q", "shingle", hashed.alias("hash"))
    spark = docs.sparkSession
    whole = spark.range(1).select(F.lit(None).cast("long").alias("sid"), F.lit(0).alias("q"), F.lit(None).cast("array<string>").alias("shingle"), F.lit(WHOLE).alias("hash"))
    if small:
        met = spread.join(F.broadcast(side.union(whole)), "hash").withColumn("at", at)
        hit = met.where(F.col("shingle").isNull() | (F.col("at") >= 0) & (F.slice("words", F.greatest("at", F.lit(0)) + 1, F.col("q")) == F.col("shingle")))
        hit = hit.select(*KEY, count.alias("n_words"), F.when(F.col("shingle").isNotNull(), F.col("at")).alias("at"), "sid")
    else:
        # What is shuffled of a position is its own shingle, so the bytes grow with the words and not with their square.
        first, length = reduce(lambda other, x: (F.when(F.col("place") >= x[1], x[1]).otherwise(other[0]), F.when(F.col("place") >= x[1], F.lit(x[0])).otherwise(other[1])), begins, (F.lit(0), F.lit(0)))
        placed = spread.where(F.col("hash") != WHOLE).select(*KEY, count.alias("n_words"), (F.col("place") - first).alias("at"), F.slice("words", F.greatest(F.col("place") - first, F.lit(0)) + 1, length).alias("own"), "hash")
        hit = placed.join(side, "hash").where(F.col("own") == F.col("shingle")).select(*KEY, "n_words", "at", "sid")
    found = cut(hit, "shingle-occurrences")
    every = found.where("at IS NULL") if small else words.select(*KEY, count.alias("n_words"))
    return found.where("at IS NOT NULL"), every.select(*KEY, F.col("n_words").cast("long").alias("n_words"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest shingle of each window: item, begin (the window's offset), offset, sid, need, q. A shingle that no document has rules its windows out."""
    ranked = shingles.join(counts, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A window begins at each offset up to n_shingles - need and spans `need` shingles.
    best = F.min(F.struct("n", "sid", "offset")).over
    parts = []
    for need in sorted(r["need"] for r in shingles.select("need").distinct().collect()):  # at most WINDOW values
        span = Window.partitionBy("item").orderBy("offset").rowsBetween(0, need - 1)
        parts.append(
            ranked.where(F.col("need") == need)
            .withColumn("best", best(span))
            .where(F.col("offset") <= F.col("n_shingles") - need)
            .select("item", F.col("offset").alias("begin"), F.col("best.offset").alias("offset"), F.col("best.sid").alias("sid"), F.col("best.n").alias("n"), "need", "q")
        )
    return reduce(DataFrame.unionByName, parts).where("n > 0").drop("n") if parts else None


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    docs = docs.select("doc_id", "text")
    shingles = cut(benchmark_shingles(items).withColumn("sid", F.xxhash64("q", "shingle")), "benchmark-shingles")
    found, base = occurrences(docs, shingles)
    prefix = prefixes(shingles, found.groupBy("sid").agg(F.count("*").alias("n")))
    if prefix is None:
        hits = found.select(*KEY, F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    else:
        hits = _hits(found, prefix, shingles)
    same = base["doc_id"].eqNullSafe(hits["doc_id"]) & (base["text_hash"] == hits["text_hash"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(hits, same, "left").select(
        base["doc_id"],
        base["text_hash"],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).drop("text_hash")


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated rows. The columns stay as they are."""
    found = cut(contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    few = found.limit(BROADCAST_SHINGLES + 1).count() <= BROADCAST_SHINGLES
    kept = set_aside(docs, "doc_id", "text")
    on = kept["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(kept["text"]) == found["_hash"])
    return put_back(kept.join(F.broadcast(found) if few else found, on, "left_anti"), docs, "doc_id", "text")


def _hits(found: DataFrame, prefix: DataFrame, shingles: DataFrame) -> DataFrame:
    """Per document with a hit: n_hit, n_items, items (ids joined by commas)."""
    diagonal = F.col("at") - F.col("offset")
    begins, ends = diagonal + F.col("begin"), diagonal + F.col("begin") + F.col("need") + F.col("q") - 1
    candidates = found.join(prefix, "sid").where((begins >= 0) & (ends <= F.col("n_words"))).groupBy(*KEY, "item", diagonal.alias("diagonal"), "offset")
    # The windows that one prefix shingle stands for overlap in it, so their offsets are one range.
    ranges = candidates.agg(F.min("begin").alias("low"), F.max(F.col("begin") + F.col("need") - 1).alias("high"))
    wanted = ranges.select(*KEY, "item", "diagonal", F.explode(F.sequence("low", "high")).alias("offset")).distinct()
    placed = wanted.join(shingles.select("sid", "item", "item_id", "offset", "need", "q"), ["item", "offset"]).withColumn("at", F.col("diagonal") + F.col("offset"))
    on = placed["doc_id"].eqNullSafe(found["doc_id"])
    for c in ("text_hash", "at", "sid"):
        on = on & (placed[c] == found[c])
    along = placed.join(found, on, "left_semi")
    run = F.col("offset") - F.dense_rank().over(Window.partitionBy(*KEY, "item", "diagonal").orderBy("offset"))
    runs = along.withColumn("run", run).groupBy(*KEY, "item", "item_id", "diagonal", "run", "need", "q").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    kept = runs.where(F.col("last") - F.col("first") + 1 >= F.col("need"))
    begin = F.col("diagonal") + F.col("first")
    spans = kept.select(*KEY, "item", "item_id", begin.alias("s"), (F.col("diagonal") + F.col("last") + F.col("q")).alias("e"))
    grown = spans.groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"),
        F.collect_set(F.struct("item", F.coalesce("item_id", F.lit("")).alias("id"))).alias("matched"),
    )
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    ids = F.sort_array(F.transform("matched", lambda m: m["id"]))
    return grown.select(*KEY, union.cast("long").alias("n_hit"), F.size(F.array_distinct(ids)).cast("long").alias("n_items"), F.array_join(F.array_distinct(ids), ",").alias("items"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'UPPER', 'LOWER'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'UPPER', 'LOWER'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wi AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS o, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[o:o + n - 1], ' ') AS t FROM wi),
sizes AS (SELECT DISTINCT n FROM win),
di AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS o, w FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, n, o, array_to_string(w[o:o + n - 1], ' ') AS t FROM di),
m AS (SELECT r, dw.n, o, item_id FROM dw JOIN win ON dw.n = win.n AND dw.t = win.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(o, o + n)) AS p FROM (SELECT DISTINCT r, o, n FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
""".replace("UPPER", UPPER).replace("LOWER", LOWER)
