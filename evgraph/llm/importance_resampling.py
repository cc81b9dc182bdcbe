"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of 1 to `longest` words. Each partition is read in blocks of whole documents, the Arrow batches. A block's
words become ids, its suffixes are sorted by their first `longest` ids (a suffix array, by doubling), and the number of
leading words that neighbours share (the LCP array) splits it, for each length, into runs: a run holds all occurrences
of one n-gram. Its text is hashed once, and its bucket is scattered back to the positions where it occurs.

A document's buckets are written once. Bucket counts of all documents and of the target give each bucket a gain; a
document's weight is the mean of its gains, its score the weight plus seeded Gumbel noise, and the highest scores are drawn.

What the driver holds are counts of `buckets` buckets and one row for each distinct score (scores are whole numbers
below 10^6 in absolute value, whatever the input).

Defined results: a null text has no words; without features the weight is 0. A null doc_id is hashed as an empty text. Rows are never
merged: repeated rows are drawn each for itself; rows of equal score go by doc_id (null first), then n_features and weight. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, cut, give_back, runs, small_batches

LONGEST = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

#: Byte values: A-Z lower-cased, every other ASCII character but letters and digits as 0.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 0


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(id of each word, offset of each text's first word and the end, the distinct words' bytes) of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0]))]
    bounds = bounds - bounds[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begins[firsts] = inside[firsts]  # a text's first byte continues no word of the text before it
    at = np.concatenate(([0], np.cumsum(begins)))[bounds]
    place = np.flatnonzero(begins)
    kept = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.append(kept[place], kept[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, coded.dictionary.to_pylist()


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` ids within their text, LCP with the suffix before, at most depth)."""
    n = len(ids)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words from here to the text's end
    rank, have = ids + 1, 1
    while have < depth:  # ranks of `have` words and the ranks that follow make ranks of twice as many
        after = np.zeros(n, np.int64)
        far = left > have
        after[far] = rank[np.flatnonzero(far) + have]
        _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
        rank, have = rank + 1, 2 * have
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int32)
    same = np.ones(max(n - 1, 0), bool)
    for k in range(depth):
        a, b = order[:-1], order[1:]
        same = same & (left[a] > k) & (left[b] > k)
        same[same] = ids[a[same] + k] == ids[b[same] + k]
        lcp[1:] += same
    return order, lcp


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, offset of each text's features and the end, words of each text)."""
    ids, at, words = word_ids(texts)
    order, lcp = suffix_array(ids, at, longest)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(ids))
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, owner = [], []
    for n in range(1, longest + 1):
        begins, _ = runs(np.cumsum(lcp < n))  # neighbours that share n words stand in one run
        lengths = np.diff(np.append(begins, len(order)))
        heads = order[begins]
        whole = left[heads] >= n
        heads, lengths = heads[whole], lengths[whole]
        if n == 1:
            hashed = [zlib.crc32(words[i]) % buckets for i in ids[heads].tolist()]
        else:
            hashed = [zlib.crc32(b" ".join([words[i] for i in ids[h : h + n].tolist()])) % buckets for h in heads.tolist()]
        at_all = order[np.repeat(whole, np.diff(np.append(begins, len(order))))]
        bucket = np.empty(len(ids), np.int64)
        bucket[at_all] = np.repeat(np.array(hashed, np.int64), lengths)
        place = np.flatnonzero(left >= n)
        found.append(bucket[place])
        owner.append(text_of[place])
    flat, of = np.concatenate(found), np.concatenate(owner)
    if longest > 1:
        flat = flat[np.argsort(of, kind="stable")]
    counts = np.bincount(of, minlength=len(at) - 1)
    return flat, np.concatenate(([0], np.cumsum(counts))), np.diff(at)


def _stored(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def hashed_features(docs: DataFrame, key: str, longest: int, buckets: int) -> DataFrame:
    """key, n_words and the text's buckets, packed."""
    small_batches(docs.sparkSession)
    kind = _stored(buckets)
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at, n = features(b.column("text"), longest, buckets)
            flat = flat.astype(kind)
            yield batch(schema, b.column("key"), n.astype(np.int64), [flat[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        give_back()

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(found, "key long, n_words long, buckets binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: added up within tasks, then by bucket; `buckets` rows reach the driver."""
    kind = _stored(buckets)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("buckets").to_pylist()), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield batch(schema, at.astype(np.int32), total[at])

    rows = hashed.select("buckets").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    buckets, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight; the gains, 8 bytes a bucket, go with the task."""
    kind = _stored(len(gain))
    sent = hashed.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("buckets").to_pylist()
            n = np.array([len(x) for x in blobs], np.int64) // kind().itemsize
            total = np.concatenate(([0], np.cumsum(sent.value[np.frombuffer(b"".join(blobs), kind)])))[np.concatenate(([0], np.cumsum(n)))]
            yield batch(schema, b.column("key"), b.column("n_words"), n, np.diff(total) // np.maximum(n, 1))

    return hashed.mapInArrow(found, "doc_id long, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with score: weight plus Gumbel noise by a hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank: the highest `percent` per cent of the rows with `least` words or more, in order; rank is null for others.

    Rows are ranked within their score; how many rows have a higher score comes from a count by score.
    """
    able = F.col("n_words") >= least
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each score
    steps = by_score.select(F.col("score").alias("_score"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    met = scored.join(F.broadcast(steps.where("before < drawn")), able & (F.col("score") == F.col("_score")), "left")
    columns = ("doc_id", "n_features", "weight", "score")
    inside = met.where("before IS NOT NULL")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    ranked = inside.select(*columns, F.when(place <= F.col("drawn"), place).cast("long").alias("rank"))
    return ranked.unionByName(met.where("before IS NULL").select(*columns, F.lit(None).cast("long").alias("rank")))


def importance_resampling(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs, drawn towards the texts of target."""
    hashed = cut(hashed_features(docs, "doc_id", longest, buckets), "buckets")
    gain = gains(bucket_counts(hashed, buckets), bucket_counts(hashed_features(target, "item_id", longest, buckets), buckets))
    return draw(cut(noisy(weighed(hashed, gain)), "weights"), percent)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
o AS (SELECT r, unnest(w) AS word FROM d),
tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)),
u AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM o UNION SELECT word FROM b)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, tab),
s AS (SELECT bucket, count(*) AS s FROM o JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM o) AS s_all, (SELECT count(*) FROM b) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM o JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM e LEFT JOIN k USING (r)
""".replace("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").replace("LOWER", "abcdefghijklmnopqrstuvwxyz")
