"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct shingles (SHINGLE words, the whole text if it has fewer), as 56-bit
hashes, the leading bytes of 64. Equal sets are one class from the start, so copies cost one member. Two classes
link when their Jaccard similarity is at least 0.75; linked classes form components.

The sets are hashed once and written; all that follows reads them. Exact copies within a task are written once.

Candidates. In any order of tokens, linked sets share a token in the first n - ceil(0.75 n) + 1 of either.
1. All tokens are counted. One in more than MOST_RARE sets is frequent. Rare tokens are ordered by hash, frequent ones go last.
2. Each class is indexed by the tokens of its prefix. A class with too few rare tokens fills its prefix with frequent
   ones: the prefix is extended until tokens
   that share a group (by hash; as many groups as an eighth of the size) make up for one token a group, and all
   pairs of tokens within a group are indexed. Groups depend on the size's power of two; a class
   is indexed for its own and for those of its possible partners.

Verification. Classes that share as many rare tokens as a link needs at least, or an indexed pair, are compared by
their whole sets. Of indexed pairs each class is compared with a hub, a class of about its size that many share pairs with. Classes of one
hub can only link if they share enough with it or a token outside it, so groups of near copies need no comparison of
all pairs. What could still join two components is compared, the likeliest pair of each class first. A link that joins what is joined
already changes nothing, so no other pair needs a comparison.

Which tokens are frequent is told by a bitmap of 2^FREQUENT_BITS bits, or 16 bits a frequent token if that is more, up to 2^MOST_BITS
(128 MB): a rare token that falls on set bits is treated as frequent, by every document alike, which costs time but no link.

Defined results: null and empty texts have no shingles, are linked with nothing and have their own doc_id
as component_id. Rows with equal doc_id are told apart by their sets. Null doc_ids are kept and link as others do; a component's id is its
smallest doc_id that is not null. Sets are found by class, whatever the doc_ids. Other columns, whatever their names, are kept by keep_representatives and ignored else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DEAL_DIGITS, batch, blobs, cut, deal_again, folders_made, give_back, put_back, release, release_unread, runs, set_aside, small_batches, word_codes

SHINGLE = 5
MOST_RARE = 24
FREQUENT_BITS, MOST_BITS = 27, 30
#: Postings that a task holds before it deals them out, and bytes of a bucket at most, about.
FLUSH = 500_000
BUCKET_BYTES = 4 << 20
#: Sets that a task remembers to write copies once.
REMEMBERED = 200_000
#: Rounds of components(): twice the square of the logarithm of 10^12 links would be more than it has ever taken.
MOST_ROUNDS = 200
#: Links that a task contracts at a time.
LOCAL_LINKS = 200_000
#: Ids up to which a list of documents is broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000

_K, _MIX = np.uint64(0x9FB21C651E98DF25), np.uint64(0xFF51AFD7ED558CCD)
_S32, _ONE = np.uint64(32), np.uint64(1)
#: Bytes of a stored token; the bits below are clear.
STORED = 7
_LEADING = np.uint64((1 << 64) - (1 << 8 * (8 - STORED)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _MIX
    x = (x ^ (x >> _S32)) * _K
    return x ^ (x >> _S32)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct shingle hashes; the bits that aren't stored are clear."""
    codes, at = word_codes(texts)
    whole = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for k in range(size):
        whole = whole * _K + codes[k : k + len(whole)]
    whole = _mix(whole) & _LEADING
    out = []
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - begin >= size:
            out.append(np.unique(whole[begin : end - size + 1]))
            continue
        short = np.full(min(1, end - begin), end - begin, np.uint64)
        for k in range(begin, end):
            short = short * _K + codes[k]
        out.append(_mix(short) & _LEADING)
    return out


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _needed(n: int) -> int:
    """Least overlap of a set of n with a set it links to."""
    return (3 * n + 3) // 4


def signatures(tokens: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexed single tokens (bit 0 clear) and token pairs (bit 0 set) of a set."""
    return _signatures(tokens, np.zeros(len(tokens), bool) if frequent is None else is_frequent(tokens, frequent))


def _signatures(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(tokens)
    prefix = n - _needed(n) + 1
    cold = tokens[~frequent]
    if len(cold) >= prefix:
        return cold[:prefix], np.empty(0, np.uint64)
    rest, hot = prefix - len(cold), tokens[frequent]
    pairs = [_pairs(hot, rest, level) for level in range(n.bit_length() - 1, (4 * n // 3).bit_length())]
    return cold, np.concatenate(pairs)


def _pairs(hot: np.ndarray, rest: int, level: int) -> np.ndarray:
    salt = np.uint64((level + 1) * int(_K) & 0xFFFFFFFFFFFFFFFF)
    groups = (1 << level) // 8
    if not groups:
        return _mix(hot[:rest] + salt) | _ONE
    group = (hot >> np.uint64(20)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    first = np.ones(len(hot), bool)
    first[order[1:]] = group[order[1:]] != group[order[:-1]]
    m = int(np.searchsorted(np.cumsum(~first), rest)) + 1
    order = order[order < m]
    where = np.flatnonzero(np.diff(group[order])) + 1
    out = []
    for members in np.split(hot[order], where):
        if len(members) > 1:
            a, b = np.triu_indices(len(members), 1)
            out.append(_mix(members[a] * _K + members[b] * _MIX + salt) | _ONE)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def is_frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Both bits that a token's 37 leading bits name are set."""
    lead, bits = tokens >> np.uint64(27), len(bitmap).bit_length() + 2
    out = np.ones(len(tokens), bool)
    for at in (lead >> np.uint64(37 - bits), lead & np.uint64((1 << bits) - 1)):
        out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, class and tokens (the set, STORED bytes a shingle) of every row.

    tokens is null where the text has no words or the task has written that set before.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("tokens", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()
        for b in batches:
            found = shingle_sets(b.column("text"))
            classes = [class_of(t) if len(t) else None for t in found]
            stored: list[bytes | None] = []
            for t, c in zip(found, classes, strict=True):
                stored.append(None if c is None or c in written else _packed(t))
                written.add(c)
            if len(written) > REMEMBERED:
                written.clear()
            yield batch(schema, b.column("doc_id"), b.column("key"), [len(t) for t in found], classes, stored)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(made, "doc_id long, key long, n_shingles long, class long, tokens binary")


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - STORED :].tobytes()


def _flat(stored: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sets, and the offset at which each set's begin."""
    at = np.frombuffer(stored.buffers()[1], np.int32, len(stored) + 1, 4 * stored.offset)
    data = np.frombuffer(stored.buffers()[2] or b"", np.uint8, int(at[-1] - at[0]), int(at[0]))
    tokens = np.zeros((len(data) // STORED, 8), np.uint8)
    tokens[:, 8 - STORED :] = data.reshape(-1, STORED)
    return tokens.reshape(-1).view("<u8"), (at - at[0]) // STORED


def _count_deal(stored: DataFrame, digits: int) -> DataFrame:
    """All tokens of the sets in blobs by bucket, with how often a task met each (255 at most).

    A blob has the 32 bits below the bucket's, and whole tokens where buckets are dealt again.
    """
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
    first = min(digits, DEAL_DIGITS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            held.clear()
            begins, count = runs(tokens)
            tokens, count = tokens[begins], np.minimum(count, 255).astype(np.uint8)
            sent = tokens if digits > first else (tokens >> np.uint64(32 - digits)).astype(np.uint32)
            return batch(schema, *map(list, zip(*blobs(tokens, first, sent, count), strict=True)))

        for b in batches:
            held.append(_flat(b.column("tokens"))[0])
            size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()
        give_back()

    return deal_again(stored.select("tokens").mapInArrow(dealt, "bucket long, tokens binary, counts binary"), digits, {"tokens": np.uint64, "counts": np.uint8})


def _frequent(dealt: DataFrame, digits: int) -> DataFrame:
    """token (its leading bits) of the tokens that more than MOST_RARE sets have."""
    schema = pa.schema([("token", pa.int64())])
    whole = digits > DEAL_DIGITS

    def counted(group: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64 if whole else np.uint32)
        n = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8)
        order = np.argsort(tokens)
        tokens, n = tokens[order], n[order].astype(np.int64)
        begins = runs(tokens)[0]
        tokens = tokens[begins][np.add.reduceat(n, begins) > MOST_RARE].astype(np.uint64)
        if not whole:
            tokens = np.uint64(group["bucket"][0].as_py()) << np.uint64(64 - digits) | tokens << np.uint64(32 - digits)
        return pa.table([tokens.view(np.int64)], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(counted, "token long")


def _bitmap(hot: DataFrame) -> np.ndarray:
    """A bitmap with both bits of each token set: joined on the executors into at most 2^MOST_BITS / 32 words."""
    bits = min(MOST_BITS, max(FREQUENT_BITS, (16 * hot.count()).bit_length()))
    lead = hot.selectExpr("shiftrightunsigned(token, 27) AS x")
    places = lead.selectExpr(f"explode(array(shiftright(x, {37 - bits}), x & {(1 << bits) - 1})) AS bit")
    words = places.selectExpr("CAST(shiftright(bit, 5) AS INT) AS w", "shiftleft(1L, CAST(bit & 31 AS INT)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _deal(stored: DataFrame, digits: int, frequent) -> DataFrame:
    """Indexed tokens (token, class) in blobs by bucket, and token pairs in blobs of buckets below 0. frequent: a broadcast bitmap."""
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("classes", pa.binary())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        paired: list[tuple[np.ndarray, int]] = []
        size = 0

        def joined(parts: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
            out = np.concatenate([t for t, _ in parts]), np.repeat(np.array([c for _, c in parts], np.int64), [len(t) for t, _ in parts])
            parts.clear()
            return out

        def flush() -> pa.RecordBatch:
            tokens, classes = joined(held)
            order = np.argsort(tokens)
            rows = list(blobs(tokens[order], min(digits, DEAL_DIGITS), tokens[order], classes[order]))
            if paired:
                tokens, classes = joined(paired)
                rows.append((-1 - int(tokens[0] >> _S32) % (1 << DEAL_DIGITS), tokens.tobytes(), classes.tobytes()))
            return batch(schema, *map(list, zip(*rows, strict=True)))

        for b in batches:
            flat, at = _flat(b.column("tokens"))
            hot = is_frequent(flat, frequent.value)
            for c, begin, end in zip(b.column("class").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                single, pairs = _signatures(flat[begin:end], hot[begin:end])
                held.append((single.copy(), c))
                if len(pairs):
                    paired.append((pairs, c))
                size += len(single) + len(pairs)
                if size >= FLUSH:
                    yield flush()
                    size = 0
                    give_back()
        if held:
            yield flush()
        give_back()

    return deal_again(stored.select("tokens", "class").mapInArrow(dealt, "bucket long, tokens binary, classes binary"), digits, {"tokens": np.uint64, "classes": np.int64})


def _distinct(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((classes, tokens))
    tokens, classes = tokens[order], classes[order]
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
    return tokens[keep], classes[keep]


def _gather(dealt: DataFrame) -> DataFrame:
    """Of each bucket: (token, class) of the tokens in several classes, and all pairs as they are.

    As every set was counted, no token here is in more than MOST_RARE classes.
    """
    schema = pa.schema([("token", pa.int64()), ("class", pa.int64())])

    def gathered(group: pa.Table) -> pa.Table:
        tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
        classes = np.frombuffer(b"".join(group["classes"].to_pylist()), np.int64)
        if group["bucket"][0].as_py() < 0:  # pairs lie in any bucket; they are only unpacked
            return pa.table([tokens.view(np.int64), classes], schema=schema)
        order = np.argsort(tokens)
        tokens, classes = tokens[order], classes[order]
        count = runs(tokens)[1]
        several = np.repeat(count > 1, count)
        tokens, classes = _distinct(tokens[several], classes[several])
        count = runs(tokens)[1]
        several = np.repeat(count > 1, count)
        return pa.table([tokens[several].view(np.int64), classes[several]], schema=schema)

    return dealt.groupBy("bucket").applyInArrow(gathered, "token long, class long")


def memberships(stored: DataFrame, n_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Rare tokens (token, class) and token pairs (token, class) that the classes have in their prefixes; of tokens those that two classes or more have.

    stored: class and tokens of every class.
    """
    spark = stored.sparkSession
    digits = max(5, (n_tokens // 4 * 16 // BUCKET_BYTES).bit_length())
    hot = cut(_frequent(_count_deal(stored, digits), digits), "ngram-frequent", free=True)
    last = cut(_gather(_deal(stored, digits, spark.sparkContext.broadcast(_bitmap(hot)))), "ngram-tokens", free=True)
    paired = F.col("token").bitwiseAND(1) == 1
    return last.where(~paired), cut(last.where(paired).distinct(), "ngram-token-pairs")


def _local_stars(links: DataFrame) -> DataFrame:
    """(u, v) with the same components as links (a, b): of every LOCAL_LINKS links that a task reads, each class with the least that they reach."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def contract(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        above = list(range(len(nodes)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
        roots = np.fromiter(map(top, range(len(nodes))), np.int64, len(nodes))
        under = np.flatnonzero(roots != np.arange(len(nodes)))
        return batch(schema, nodes[under], nodes[roots[under]])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for x in batches:
            held.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
            size += x.num_rows
            if size >= LOCAL_LINKS:
                yield contract(held)
                size = 0
        if held:
            yield contract(held)

    return links.select("a", "b").mapInArrow(stars, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(class, root) of the classes with a link (a, b); root is the smallest class that links reach, and has no row of its own.

    Links are contracted where they lie, then large stars and small stars are made in turn until every class has one root and every
    root only itself. Every round is cut, and no list is gathered in one place beyond a node's neighbours, which are
    only aggregated. Raises rather than return unfinished components.
    """
    pairs = cut(_local_stars(links), "edges")
    for _ in range(MOST_ROUNDS):
        ends = pairs.union(pairs.select("v", "v")).groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        if not ends.where("lo <> hi").limit(1).count():
            break
        edges = pairs.union(pairs.selectExpr("v AS u", "u AS v"))
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = cut(edges.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = cut(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.selectExpr("u", "m AS v")).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "class")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(class, root) after further links: only the roots that they join are gone through again."""
    a, b = (roots.select(F.col("class").alias(x), F.col("root").alias(f"_r{x}")) for x in "ab")
    met = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
    further = cut(components(met.where("a <> b")), "ngram-joined").toDF("class", "above")
    moved = roots.join(further.withColumnRenamed("class", "root"), "root", "left").select("class", F.coalesce("above", "root").alias("root"))
    fresh = further.join(roots, "class", "left_anti").select("class", F.col("above").alias("root"))
    return cut(moved.union(fresh), "ngram-roots")


def _whole_sets(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, tokens) of the wanted classes, each once."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    schema = pa.schema([("class", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def made(batches):
        for x in batches:
            flat, at = _flat(x.column("tokens"))
            yield batch(schema, x.column("class"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64))))

    kept = stored.select("class", "tokens").join(F.broadcast(wanted) if few else wanted, "class", "left_semi")
    return cut(kept.mapInArrow(made, "class long, tokens array<long>").dropDuplicates(["class"]), "ngram-sets", free=True)


def _with_sets(stored: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with na, nb and the whole sets ta and tb. classes: class and n."""
    a, b = (classes.select(F.col("class").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    sized = cut(pairs.join(a, "a").join(b, "b"), "ngram-pairs")
    whole = _whole_sets(stored, sized.select(F.col("a").alias("class")).union(sized.select("b")).distinct())
    left = sized.join(whole.withColumnsRenamed({"class": "a", "tokens": "ta"}), "a")
    return left.join(whole.withColumnsRenamed({"class": "b", "tokens": "tb"}), "b")


def _similar(shared: Column) -> Column:
    return 100 * shared >= 75 * (F.col("na") + F.col("nb") - shared)


def _verified(stored: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose similarity is at least 0.75, by their whole sets."""
    n = classes.select("class", "n")
    sized = pairs.join(n.toDF("a", "_na"), "a").join(n.toDF("b", "_nb"), "b").where("100 * least(_na, _nb) >= 75 * greatest(_na, _nb)").select("a", "b")
    return _with_sets(stored, sized, classes).where(_similar(F.size(F.array_intersect("ta", "tb")))).select("a", "b")


def _candidates(rare: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, n) of the classes that share so many rare tokens as a link needs.

    In the order of tokens, a link's classes have at most n - o tokens apart (o: the least overlap for
    their sizes), so of the prefix of one of them all but so many are shared, and all shared ones are rare.
    Classes whose prefix took in token pairs have fewer rare tokens; for them one shared token is enough.
    """
    mixed = pairs.select("class").distinct().withColumn("mixed", F.lit(True))
    sized = classes.select("class", "n").join(mixed, "class", "left").withColumn("mixed", F.col("mixed").isNotNull())
    known = rare.join(sized, "class")
    a = known.select("token", F.col("class").alias("a"), F.col("n").alias("na"), F.col("mixed").alias("ma"))
    b = known.select("token", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("mixed").alias("mb"))
    met = a.join(b, "token").where("a < b AND 100 * least(na, nb) >= 75 * greatest(na, nb)")
    shared = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first(F.expr("ma OR mb")).alias("mixed"))
    return shared.where(F.col("mixed") | (F.col("n") >= _least_shared())).select("a", "b", "n")


def _least_shared() -> Column:
    """How many indexed tokens and pairs classes of na and nb shingles share at least if they link.

    They have at most n - o tokens apart, and a prefix holds n - ceil(0.75 n) + 1 of them. In a prefix that was
    extended for pairs by one token a group, shared frequent tokens of a group make at least one pair less than there are.
    """
    overlap = F.ceil(75 * (F.col("na") + F.col("nb")) / 175)
    return F.least(*(F.col(n) - F.floor((3 * F.col(n) + 3) / 4) + 1 - (F.col(n) - overlap) for n in ("na", "nb")))


def links_and_components(found: DataFrame) -> DataFrame:
    """(class, root) of all linked classes. found: sets(docs), cut."""
    classes = cut(found.where("class IS NOT NULL").groupBy("class").agg(F.max("n_shingles").alias("n")), "ngram-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    docs = found.where("tokens IS NOT NULL").select("class", "tokens")
    rare, pairs = memberships(docs, total)
    close = cut(_candidates(rare, pairs, classes), "ngram-candidates")
    degree = pairs.groupBy("class").agg(F.count("*").alias("degree"))
    ranked = cut(pairs.join(degree, "class").join(classes.select("class", "n"), "class"), "ngram-ranked")
    around = cut(_around_hubs(docs, ranked, classes), "ngram-hubs")
    links = around.where("similar").select(F.col("class").alias("a"), F.col("hub").alias("b"))
    tried = around.where("class <> hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))
    roots = cut(components(links), "ngram-roots")

    def compare(wanted: DataFrame) -> None:
        nonlocal tried, roots
        wanted = cut(wanted.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "ngram-wanted")
        if not wanted.limit(1).count():
            return
        tried = tried.union(wanted)
        links = cut(_verified(docs, wanted, classes), "ngram-links")
        if links.limit(1).count():
            roots = joined(roots, links)

    def apart(wanted: DataFrame) -> DataFrame:
        """Of (a, b, ...): those not joined yet."""
        a, b = (roots.select(F.col("class").alias(x), F.col("root").alias(f"_r{x}")) for x in "ab")
        return wanted.join(a, "a", "left").join(b, "b", "left").where("coalesce(_ra, a) <> coalesce(_rb, b)").drop("_ra", "_rb")

    def nearest(of: DataFrame) -> DataFrame:
        """Of (a, b, n): each class's pair of greatest n."""
        either = of.select(F.col("a").alias("class"), F.col("b").alias("other"), "n").union(of.select("b", "a", "n"))
        best = either.groupBy("class").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
        return best.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))

    compare(nearest(apart(close)).union(_hub_neighbours(ranked, around)))
    rest = cut(apart(close).unionByName(_beside_hubs(around, roots)).unionByName(_across_hubs(ranked, around, roots, close)).groupBy("a", "b").agg(F.max("n").alias("n")), "ngram-rest")
    compare(nearest(rest))  # most join here, and need no other comparison
    compare(apart(rest))
    return roots


def _around_hubs(stored: DataFrame, ranked: DataFrame, classes: DataFrame) -> DataFrame:
    """class, hub, n, x (tokens shared with the hub), outside (tokens that the hub hasn't), similar; a hub is its own.

    A class's hub is that one, of the classes with most token pairs for each of its pairs, which it shares most pairs with.
    """
    # Classes of one band are within 4/3 of each other's size, so a hub isn't a long text that short ones are cut from.
    placed = ranked.withColumn("band", F.floor(F.log(F.col("n")) / math.log(4 / 3)))
    hubs = placed.groupBy("token", "band").agg(F.max_by("class", F.struct("degree", "class")).alias("hub"), F.count("*").alias("k")).where("k > 1").drop("k")
    met = placed.join(hubs, ["token", "band"]).groupBy("class", "hub").agg(F.count("*").alias("k"))
    best = met.groupBy("class").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
    chosen = best.select("hub").distinct()
    # A class that is a hub for another is one for itself.
    others = best.join(chosen.withColumnRenamed("hub", "class"), "class", "left_anti").toDF("a", "b")
    both = _with_sets(stored, others, classes)
    shared = F.size(F.array_intersect("ta", "tb"))
    near = both.select(F.col("a").alias("class"), F.col("b").alias("hub"), F.col("na").alias("n"), shared.alias("x"), F.array_except("ta", "tb").alias("outside"), _similar(shared).alias("similar"))
    own = chosen.withColumnRenamed("hub", "class").join(classes, "class").select("class", F.col("class").alias("hub"), "n", F.col("n").cast("int").alias("x"), F.array().cast("array<long>").alias("outside"), F.lit(False).alias("similar"))
    return near.unionByName(own)


def _hub_neighbours(ranked: DataFrame, around: DataFrame) -> DataFrame:
    """(a, b) of the hubs that follow each other in size among those with a token pair: joins groups that lie on the edge of a band."""
    of = ranked.join(around.select(F.col("hub").alias("class")).distinct(), "class", "left_semi")
    by_size = Window.partitionBy("token").orderBy("n", "class")
    pairs = of.select("class", F.lag("class").over(by_size).alias("other")).where("other IS NOT NULL").distinct()
    return pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))


_OVERLAP = "ceil(75 * (na + nb) / 175)"


def _sides(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    a, b = (rows.select(*keys, F.col("class").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("x").alias(f"x{s}")) for s in "ab")
    return a, b


def _beside_hubs(around: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, n) of the classes of one hub, in different components, that may link.

    They share at most the lesser of what each shares with the hub, and what they share outside it. So either the
    first is enough for a link, or they share a token outside the hub: the join is on those, which few classes have.
    """
    rows = around.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = rows.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hub")
    rows = rows.join(mixed, "hub", "left_semi")
    size = "a < b AND ra <> rb AND 100 * least(na, nb) >= 75 * greatest(na, nb)"
    # Only classes that share three quarters of themselves with the hub can be enough by that alone.
    a, b = _sides(rows.where("4 * x >= 3 * n"), ["hub"])
    inside = a.join(b, (a["hub"] == b["hub"]) & F.expr(f"{size} AND least(xa, xb) >= {_OVERLAP}")).select("a", "b", F.least("xa", "xb").cast("long").alias("n"))
    a, b = _sides(rows.withColumn("token", F.explode("outside")), ["hub", "token"])
    met = a.join(b, (a["hub"] == b["hub"]) & (a["token"] == b["token"]) & F.expr(f"{size} AND least(xa, xb) + least(na - xa, nb - xb) >= {_OVERLAP}"))
    counted = met.groupBy("a", "b", "na", "nb", "xa", "xb").agg(F.count("*").alias("k")).where(f"least(xa, xb) + k >= {_OVERLAP}")
    return inside.unionByName(counted.select("a", "b", (F.least("xa", "xb") + F.col("k")).cast("long").alias("n")))


def _across_hubs(ranked: DataFrame, around: DataFrame, roots: DataFrame, close: DataFrame) -> DataFrame:
    """(a, b, n) of the classes with different hubs, in different components, that share so many tokens and token pairs as a link needs."""
    placed = ranked.select("token", "class", "n").join(around.select("class", "hub"), "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).withColumn("hub", F.coalesce("hub", "class"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("hub").alias("h1"), F.max("hub").alias("h2")).where("lo <> hi AND h1 <> h2").select("token")
    rows = placed.join(mixed, "token", "left_semi").withColumnRenamed("hub", "x")
    a, b = _sides(rows, ["token"])
    met = a.join(b, (a["token"] == b["token"]) & F.expr("a < b AND ra <> rb AND xa <> xb AND 100 * least(na, nb) >= 75 * greatest(na, nb)"))
    shared = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    more = shared.join(close, ["a", "b"], "left").withColumn("n", F.col("k") + F.coalesce("n", F.lit(0)))
    return more.where(F.col("n") >= _least_shared()).select("a", "b", F.col("n").cast("long").alias("n"))


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, class, root (the component's least class) and component_id of every row."""
    small_batches(docs.sparkSession, 2)
    stored = cut(sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "ngram-docs")
    found = cut(stored.drop("tokens"), "ngram-rows")
    roots = links_and_components(stored)
    release(stored)
    of_class = found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    # Reread, so that the join below deals both sides anew and can split a class with many rows.
    named = cut(of_class.join(names, "root").select("class", "root", "component_id"), "ngram-named")
    return found.join(named, "class", "left").select("doc_id", "key", "n_shingles", "class", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_join(docs: DataFrame) -> DataFrame:
    return with_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each component: its smallest doc_id's (null if it has no other), and of its texts with that doc_id the one whose hash is least.

    Texts without words are linked with nothing and stay. The columns stay as they are.
    """
    made = folders_made()
    named = with_components(docs)
    own = cut(named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "key", F.col("class").isNull().alias("bare")).agg(F.count("*").alias("n")), "ngram-kept")
    least = own.where("NOT bare").groupBy("root").agg(F.min_by(F.struct("doc_id", "key", "n"), "key").alias("x")).select("x.*")
    kept = least.union(own.where("bare").select("doc_id", "key", F.lit(1).alias("n"))).toDF("_id", "_key", "_n")
    few = kept.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    plain = set_aside(docs, "doc_id", "text")
    on = plain["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(plain["text"]) == kept["_key"])
    met = plain.join(F.broadcast(kept) if few else kept, on)
    once, again = met.where("_n = 1"), met.where("_n > 1").dropDuplicates(["_id", "_key"])
    return release_unread(put_back(once.union(again), docs, "doc_id", "text"), made)  # what comes after starts with an empty shared folder
