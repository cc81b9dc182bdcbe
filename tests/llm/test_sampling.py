"""Resampling, mixing and alignment against their SQL and plain forms of themselves."""

import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evgraph.llm import importance_resampling, mixing, tokenizer_alignment
from evgraph.llm.common import cut, tokenizer_path

from .conftest import COLUMNS, prose


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def oracle(sql, columns, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    found = con.sql(sql)
    at = [found.columns.index(c) for c in columns]
    return sorted((tuple(r[k] for k in at) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(k, prose(f"item{k}", 40)) for k in range(4)] + [(9, None), (10, "")], "item_id long, text string")


# Resampling


def test_resampling(docs, clashing, nothing, items):
    got = importance_resampling.importance_resampling(docs, items)
    assert table(got) == oracle(importance_resampling.ORACLE_SQL, got.columns, documents=docs, benchmark=items)
    assert table(got) == table(importance_resampling.importance_resampling(clashing.repartition(2), items))
    assert importance_resampling.importance_resampling(nothing, items).count() == 0
    assert importance_resampling.importance_resampling(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_features_are_all_runs_of_words(longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choices(["a", "b", "ab", "É", "x1"], k=rng.randint(0, 12))) for _ in range(60)] + [None, "", "--", "A.b!A?b", "a" * 500, "ab ab ab ab ab ab"]
    flat, at, n = importance_resampling.features(pa.array(texts + texts[:3], pa.string())[1:], longest, 1000)
    for k, t in enumerate((texts + texts[:3])[1:]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1)]
        assert n[k] == len(words) and sorted(flat[at[k] : at[k + 1]]) == sorted(zlib.crc32(g.encode()) % 1000 for g in grams)


def test_suffixes_are_in_order():
    rng = random.Random(5)
    texts = [[rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(30)]
    ids, at = np.array([x for t in texts for x in t], np.int64), np.cumsum([0, *map(len, texts)])
    suffix = {i: t[i - a :] for t, a in zip(texts, at, strict=False) for i in range(a, a + len(t))}
    for depth in (1, 2, 3, 4, 7):
        order, lcp = importance_resampling.suffix_array(ids, at, depth)
        keys = [suffix[i][:depth] for i in order.tolist()]
        assert keys == sorted(keys)
        shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp[1:].tolist() == [shared(a, b) for a, b in zip(keys, keys[1:], strict=False)]


def test_ties_are_drawn_by_id(spark, items):
    data = [(k, prose("same", 30), None, None, None) for k in range(50)] + [(7, prose("same", 30), None, None, None)] * 3
    got = importance_resampling.importance_resampling(spark.createDataFrame(data, COLUMNS), items, percent=40).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(data) * 40 // 100 + 1))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)


# Mixing


def sources(spark, seed=0, sizes=(40, 9, 3, 25, 1, 60)):
    rng = random.Random(seed)
    data = [(n * 1000 + k, " ".join("w" for _ in range(rng.choice((0, 1, 5, 40, 300)))), "en", f"s{n}" if n else None, None) for n, many in enumerate(sizes) for k in range(many)]
    return spark.createDataFrame(data + [(None, "a b c", "en", "s1", None)] * 3 + [(99_999, None, "en", "empty", None)], COLUMNS)


def test_mixing(spark, docs, clashing, nothing, monkeypatch):
    for frame in (docs, sources(spark), nothing):
        got = mixing.mixture(frame)
        assert table(got) == oracle(mixing.ORACLE_SQL, got.columns, documents=frame)
    assert table(mixing.mixture(docs)) == table(mixing.mixture(clashing.repartition(3)))
    assert table(mixing.mixture(sources(spark).limit(0).unionByName(sources(spark).where("text IS NULL")))) == [(99_999, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("shard_rows", [2000, 5])
def test_taken_words_come_near_targets(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    frame = sources(spark)
    got = mixing.mixture(frame)
    rows = got.join(frame.select("doc_id", "source").distinct(), "doc_id").where("doc_id IS NOT NULL").collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    for source, (taken, target) in by.items():
        if source != "s1":  # rows without an id are left out above
            assert abs(taken - target) <= 0.01 * target + 3 * (1 + len(rows) // shard_rows), source
    assert table(got) == table(mixing.mixture(frame.repartition(9)))


def test_targets_stop_at_the_cap_and_are_shared_again(spark):
    sized = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 5, 1), ("d", 100, 1), (None, 50, 1)], "source string, source_size long, n_docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    weight, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 10, "b": 1000, "c": 5, "d": 100, None: 50}
    left, open_, expected = float(sum(size.values())), set(size), dict.fromkeys(size, 0.0)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            expected[s] += share * weight[s]
            if expected[s] >= 3 * size[s]:
                left += expected[s] - 3 * size[s]
                expected[s] = 3.0 * size[s]
                open_.discard(s)
    assert got == pytest.approx(expected)


def test_quotas_go_to_the_highest_quotients(spark):
    rng = random.Random(4)
    for trial in range(4):
        data = [(f"s{k}", 0, float(rng.choice((0, 1, 3, 3, 10, 1000)) * (1 if trial else rng.random())), rng.randrange(40)) for k in range(25)]
        seats = rng.randrange(1, 200)
        heap = [(-v / 0.5, s, 0, v, room) for s, _, v, room in data if v > 0 and room]
        heapq.heapify(heap)
        expected = Counter()
        for _ in range(seats):
            if not heap:
                break
            _, s, k, v, room = heapq.heappop(heap)
            expected[s] += 1
            if k + 1 < room:
                heapq.heappush(heap, (-v / (k + 1.5), s, k + 1, v, room))
        parties = cut(spark.createDataFrame(data, "source string, shard int, votes double, room long"), "test-parties")
        got = {r["source"]: r["quota"] for r in mixing.apportion(parties, "votes", "room", seats).collect()}
        assert got == {s: expected[s] for s, *_ in data}


def test_native_forms_have_no_python(docs):
    plan = mixing.mixture(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Alignment

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["a  b", "x\n y", " lead", "trail ", "<|endoftext|> hi <s> </s>", "▁odd", "　wide space", "tab\t tab", "é\U0001f600 ok", "  ", "\n", "", None, "a \x1c b", "don't we'll 12 34,5", "İß ça", "x" * 700]


def aligned(pair, text):
    """(A's ids, B's ids, groups) of a whole text by the libraries, byte by byte."""
    byte_of = tokenizer_alignment._byte_of()
    if not text:
        return [], [], []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    of_a = [bytes(byte_of[c] for c in pair.a.id_to_token(i)) for i in a]
    of_b = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pair.b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(of_a) != whole or b"".join(of_b) != whole:
        return [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    groups, i, j, both = [], 0, 0, set(ends_a) & set(ends_b)
    for end in sorted(both):
        k, m = i, j
        while i < len(a) and ends_a[i] <= end:
            i += 1
        while j < len(b) and ends_b[j] <= end:
            j += 1
        groups.append((a[k:i], b[m:j]))
    return a, b, groups


def test_alignment(spark, docs, clashing, nothing):
    import hashlib

    frame = docs.unionByName(spark.createDataFrame([(10_000 + k, t, "en", "s", 0) for k, t in enumerate(ODD)], COLUMNS))
    pair = tokenizer_alignment.Pair(A, B)
    assert pair.cuts
    found = [(r["doc_id"], *aligned(pair, r["text"])) for r in frame.collect()]
    counts = Counter((ga[-1], gb[-1]) for *_, groups in found for ga, gb in groups)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = []
    for doc_id, a, b, groups in found:
        links = [counts[ga[-1], gb[-1]] for ga, gb in groups]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        n_best = sum(counts[ga[-1], gb[-1]] == best[gb[-1]] for ga, gb in groups)
        expected.append((doc_id, len(a), len(b), len(groups), len(groups), n_best, sum(links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = tokenizer_alignment.tokenizer_alignment(frame, A, B).select(*names)
    assert table(got) == sorted(expected, key=repr)
    assert table(tokenizer_alignment.tokenizer_alignment(clashing, A, B)) == table(tokenizer_alignment.tokenizer_alignment(docs.repartition(1), A, B))
    assert tokenizer_alignment.tokenizer_alignment(nothing, A, B).count() == 0


def test_alignment_counts_by_bounded_groups(spark, docs):
    blocks = tokenizer_alignment.aligned_batches(docs, A, B)
    sizes = blocks.select(F.size("pairs").alias("n"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("links"), F.aggregate("n_groups", F.lit(0).cast("long"), lambda a, x: a + x).alias("groups")).collect()
    assert all(r["n"] <= r["links"] == r["groups"] for r in sizes)
