"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Targets: the sources share `percent` per cent of all words by their weights. No target passes `most` times its source's
words; what that leaves over is shared again among the other sources, until none is above.

Quotas: blocks of equally many words go one by one to the party with the highest quotient target / (2 * blocks it has + 1).
The parties are the shards of the sources, each with its part of the target; a source of up to SHARD_ROWS rows is one
shard, a larger one several, so that no task holds a source. The highest quotients are found by a divisor: a party has
floor(target / divisor + 1/2) blocks, one small aggregate a round narrows the divisor down, and the seats still open are
given in the order of their quotients.

Selection: a shard's documents stand in seeded order and are cut into blocks of equally many words. A quota of more
words than the shard has takes it whole that often; the blocks still wanted lie evenly in the order from a seeded
start, so how many words of a document are taken follows from where it stands.

A block has BLOCK words, or as many fewer as it takes for the smallest target to have FINE blocks.

Defined results: a null or empty text has size 0, and nothing of it is taken; null is a source of its own, the last.
Without any words all targets are 0. Rows are never merged: repeated rows are taken each for itself. Equal rows (id, size and
source) are interchangeable, so reruns agree. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
PERCENT, MOST = 100, 3
SEED = 2024
BLOCK, FINE = 1024, 512
SHARD_ROWS = 2_000
#: Divisors tried in one round.
TRIED = 32
ROUNDS = 12
_BEFORE = (Window.unboundedPreceding, -1)


def seeded(*parts) -> Column:
    """31 bits of a hash of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(SEED)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: float = PERCENT, most: int = MOST) -> DataFrame:
    """sources (source, source_size, n_docs), with its weight and target.

    The level is the target of a weight of 1. Each round adds up the sources whose cap the level passes and raises
    the level for the others; it ends when the level stays.
    """
    placed = running_totals(sources, [F.col("source").asc_nulls_last()], {"_place": F.lit(1)})
    weighed = cut(placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("long")).drop("_place"), "mix-sources")
    limit = most * F.col("source_size")
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level = -1.0
    reached = 0.0
    while reached != level:
        level = reached
        full = limit <= level * F.col("weight") if level else F.lit(False)
        held, open_weight = weighed.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        reached = (total - (held or 0)) / open_weight if open_weight else float("inf")
    return weighed.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")) if total else F.lit(0.0))


def apportion(parties: DataFrame, votes: str, most: str, seats: int) -> DataFrame:
    """parties with `quota`: as many of the seats as its quotients votes / (2k + 1), k = 0, 1, ..., are among the highest, and no more than `most`.

    Ties go to the party that comes first by the columns source and shard. The parties are a written table.
    """

    def quota(divisor) -> Column:
        return F.least(F.floor(F.col(votes) / divisor + 0.5), F.col(most)).cast("long")

    open_ = F.col(most) > 0
    edge = parties.where(open_ & (F.col(votes) > 0)).agg(F.min(F.col(votes) / (F.col(most) + 1)), 2.5 * F.max(votes), F.sum(most), F.count("*")).first()
    if edge[0] is None or seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    (low, high, all_seats, n), given = edge, 0
    seats = min(seats, all_seats)
    if seats == all_seats:
        return parties.withColumn("quota", F.when(F.col(votes) > 0, F.col(most)).otherwise(0).cast("long"))
    within = all_seats
    for _ in range(ROUNDS):
        # given <= seats at high, within >= seats at low
        if given == seats or within - given <= n:
            break
        tried = [low * (high / low) ** (k / TRIED) for k in range(1, TRIED)]
        counts = parties.where(open_).agg(*(F.sum(quota(d)).alias(f"n{k}") for k, d in enumerate(tried))).first()
        for d, count in zip(tried, counts, strict=True):  # the counts fall as divisors rise
            if count >= seats:
                low, within = d, count
        for d, count in zip(reversed(tried), reversed(counts), strict=True):
            if count <= seats and d >= low:
                high, given = d, count
    sure = quota(high)
    if given == seats:
        return parties.withColumn("quota", F.when(open_, sure).otherwise(0).cast("long"))
    wanted = parties.where(open_ & (quota(low) > sure)).select("source", "shard", votes, F.explode(F.sequence(sure, quota(low) - 1)).alias("k"))
    last = wanted.orderBy(F.desc(F.col(votes) / (F.col("k") + 0.5)), F.col("source").asc_nulls_last(), "shard", "k").limit(seats - given)
    more = last.groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard")).agg(F.count("*").alias("_more"))
    met = parties.join(more, parties["source"].eqNullSafe(more["_source"]) & (parties["shard"] == more["_shard"]), "left")
    return met.withColumn("quota", F.when(open_, sure + F.coalesce("_more", F.lit(0))).otherwise(0).cast("long")).drop("_source", "_shard", "_more")


def taken_before(at: Column, block: int) -> Column:
    """Words that the mix takes of a shard's first `at` words, by the shard's columns shard_size, quota and start."""
    size, quota = F.col("shard_size"), F.col("quota")
    whole = F.floor(quota * block / size)
    rest = quota * block - whole * size
    blocks = F.floor(size / block)
    chosen, left = F.floor(rest / block), rest % block  # whole blocks still wanted, and words after them
    start = F.col("start") % F.greatest(blocks, F.lit(1))

    def of(k: Column) -> Column:  # chosen blocks among the first k
        return F.floor((k * chosen + start) / F.greatest(blocks, F.lit(1)))

    k = F.least(F.floor(at / block), blocks)
    inside = F.when(k < blocks, (of(k + 1) - of(k)) * (at - k * block)).otherwise(F.least(at - k * block, left))
    return F.when(size > 0, whole * at + of(k) * block + inside).otherwise(0).cast("long")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: float = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken (its words in the mix, repeats counted) of every row."""
    sized = cut(sizes(docs), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, percent, most)
    least, total = sources.where("target > 0").agg(F.min("target"), F.sum("target")).first()
    block = int(max(1, min(BLOCK, (least or 0) // FINE)))

    of_source = sources.select(F.col("source").alias("_source"), "source_size", "target", F.ceil(F.col("n_docs") / SHARD_ROWS).alias("n_shards"))
    key = seeded(F.col("doc_id"), F.col("size"))
    placed = sized.join(of_source, sized["source"].eqNullSafe(of_source["_source"])).select("doc_id", "source", "size", "source_size", "target", key.alias("key"), (key % F.col("n_shards")).alias("shard"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("target").alias("_target"), F.first("source_size").alias("_size"))
    votes = F.when(F.col("_size") > 0, F.col("_target") * F.col("shard_size") / F.col("_size")).otherwise(0.0)
    parties = cut(shards.select("source", "shard", "shard_size", votes.alias("votes"), F.floor(most * F.col("shard_size") / block).cast("long").alias("room")), "mix-shards")
    quotas = apportion(parties, "votes", "room", int((total or 0) / block + 0.5)).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota", seeded(F.col("source"), F.col("shard")).alias("start")
    )
    order = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(*_BEFORE)
    ordered = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)))
    met = ordered.join(quotas, ordered["source"].eqNullSafe(quotas["_source"]) & (ordered["shard"] == quotas["_shard"]))
    taken = taken_before(F.col("at") + F.col("size"), block) - taken_before(F.col("at"), block)
    return met.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _hashed(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256('{SEED}:' || {" || ':' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)}), 1, 8) AS BIGINT)"


_TAKEN = """(CASE WHEN shard_size = 0 THEN 0 ELSE whole * AT + ((least(AT // b, blocks) * chosen + start) // n) * b
  + CASE WHEN least(AT // b, blocks) < blocks
         THEN (((AT // b + 1) * chosen + start) // n - ((AT // b) * chosen + start) // n) * (AT - AT // b * b)
         ELSE least(AT - blocks * b, rest % b) END END)"""

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({MOST} * source_size) OVER before, 0))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
      row_number() OVER (ORDER BY {MOST} * source_size / CAST(weight AS DOUBLE), source NULLS LAST) AS place FROM w
      WINDOW before AS (ORDER BY {MOST} * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, place) AS level FROM f WHERE {MOST} * source_size >= level * weight),
t AS (SELECT w.*, least(CAST({MOST} * source_size AS DOUBLE), level * weight) AS target, CAST(ceil(n_docs / {SHARD_ROWS}.0) AS BIGINT) AS n_shards FROM w, l),
blk AS (SELECT CAST(greatest(1, least({BLOCK}, floor(coalesce(min(target), 0) / {FINE}))) AS BIGINT) AS b, CAST(coalesce(sum(target), 0) AS DOUBLE) AS total FROM t WHERE target > 0),
seats AS (SELECT b, CAST(floor(total / b + 0.5) AS BIGINT) AS n FROM blk),
k AS (SELECT doc_id, d.source, size, source_size, target, n_shards, {_hashed("doc_id", "size")} AS key FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, key % n_shards AS shard, CAST(coalesce(sum(size) OVER (PARTITION BY source, key % n_shards ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM k),
sh AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size, CASE WHEN first(source_size) > 0 THEN first(target) * CAST(sum(size) AS BIGINT) / first(source_size) ELSE 0 END AS votes FROM p GROUP BY source, shard),
q AS (SELECT source, shard, shard_size, votes, unnest(range(0, CAST(floor({MOST} * shard_size / b) AS BIGINT))) AS k FROM sh, seats WHERE votes > 0),
won AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY votes / (k + 0.5) DESC, source NULLS LAST, shard, k) AS place FROM q), seats WHERE place <= n GROUP BY ALL),
o AS (SELECT sh.source, sh.shard, shard_size, b, coalesce(quota, 0) AS quota, CASE WHEN shard_size > 0 THEN coalesce(quota, 0) * b // shard_size ELSE 0 END AS whole, shard_size // b AS blocks,
      greatest(shard_size // b, 1) AS n, {_hashed("sh.source", "sh.shard")} % greatest(shard_size // b, 1) AS start
      FROM sh CROSS JOIN seats LEFT JOIN won ON sh.source IS NOT DISTINCT FROM won.source AND sh.shard = won.shard),
r AS (SELECT *, quota * b - whole * shard_size AS rest, (quota * b - whole * shard_size) // b AS chosen FROM o)
SELECT doc_id, size, source_size, target, CAST({_TAKEN.replace("AT", "(pos + size)")} - {_TAKEN.replace("AT", "pos")} AS BIGINT) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard
"""
