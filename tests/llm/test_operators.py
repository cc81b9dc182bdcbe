"""Every operator against a plain form of itself on small inputs."""

import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evgraph.llm import decontamination, html_extraction, ngram_join, pieces, quality_classifier, quality_rules, substring_dedup, token_codes, toxicity, warc
from evgraph.llm.common import WordCache, scratch, tokenizer_path, word_hashes

from .conftest import COLUMNS, edited, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(map(tuple, con.sql(sql).fetchall()), key=repr)


# Quality rules


def test_quality_rules(docs, clashing, nothing):
    got = quality_rules.quality_rules(docs)
    assert table(got) == oracle(quality_rules.ORACLE_SQL, documents=docs)
    assert table(got) == table(quality_rules.quality_rules(clashing))
    assert quality_rules.quality_rules(nothing).count() == 0


def test_repeated_windows(spark):
    text = " ".join(["a b c d e f g h"] * 3 + ["x y"])
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text, None, None, None)], COLUMNS)).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (26, 24, True)


# Decontamination


def test_decontamination(spark, docs, clashing, nothing, rows):
    long = words_of(rows[5][1])
    items = [(1, " ".join(long[10:40])), (2, "ONE, two"), (3, " ".join(long[50:63]).upper()), (4, None), (5, ""), (6, "..."), (7, "absent words here"), (8, "one"), (10, " ".join(long[12:30])), (None, "two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = bench.where("item_id IS NOT NULL")
    assert table(decontamination.decontamination(docs, known)) == oracle(decontamination.ORACLE_SQL, documents=docs, benchmark=known)
    assert table(decontamination.decontamination(clashing, known)) == table(decontamination.decontamination(docs, known))
    assert decontamination.decontamination(docs, bench).count() == docs.count()
    assert decontamination.decontamination(nothing, known).count() == 0
    clean = decontamination.decontamination(docs, known.limit(0))
    assert clean.where("n_hit > 0 OR contaminated").count() == 0 and clean.count() == docs.count()
    kept = decontamination.remove_contaminated(clashing, known)
    bad = decontamination.decontamination(docs, known).where("contaminated").count()
    assert bad and kept.count() == docs.count() - bad and kept.columns == clashing.columns


# N-gram join


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = lowered(t)
        w = words_of(w)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            k = len(x & y)
            if k and 100 * k >= 75 * (len(x) + len(y) - k):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[find(k)].append(i)
    return sorted(((i, len(s), min((j for j in groups[find(k)] if j is not None), default=None)) for k, (i, s) in enumerate(sets)), key=repr)


def test_ngram_join(docs, clashing, nothing, rows):
    expected = brute_components([*rows, (None, "a text without an id")])
    assert table(ngram_join.ngram_join(docs)) == expected
    assert table(ngram_join.ngram_join(clashing)) == expected
    assert ngram_join.ngram_join(nothing).count() == 0
    kept = ngram_join.keep_representatives(clashing)
    assert kept.columns == clashing.columns
    own = Counter(i for i, n, c in expected if i == c or not n)
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in own if i is not None}
    assert kept.where("doc_id = 30 OR doc_id = 31").count() == 0 and kept.where("doc_id = 3").count() == 1


def test_texts_without_ids_or_with_one_id(spark):
    """A representative of each component, whatever its doc_ids; texts that only rows without an id have are linked."""
    alone, base, other = [prose(40 + i, 100) for i in range(6)], prose("null", 150), prose("none", 150)
    linked = [(None, base), (None, edited(base, 1, 0.01)), (7, edited(base, 2, 0.01)), (None, other), (None, edited(other, 3, 0.01)), (None, edited(other, 4, 0.01))]
    rows = [(None, t) for t in alone[:3]] + [(9, t) for t in alone[3:]] + linked + [(None, alone[0]), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_representatives(df).collect()]
    assert Counter(kept) >= Counter([*rows[:6], (7, linked[2][1]), (None, ""), (None, "")])
    assert len(kept) == 10 and sum(t in [x for _, x in linked[3:]] for _, t in kept) == 1


def test_frequent_tokens_and_pairs(spark):
    """Groups beyond MOST_RARE: near copies whose shingles are all frequent, and texts that share a long passage."""
    rng = random.Random(5)
    base, passage = prose("b", 200).split(), prose("p", 60)
    near = [" ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in base) for share in (0.005, 0.01, 0.02, 0.04) for _ in range(20)]
    sharing = [f"{passage} {prose(i, 12)}" for i in range(40)]
    rows = list(enumerate(near + sharing + [prose(900 + i, 80) for i in range(20)]))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    assert table(ngram_join.ngram_join(df)) == brute_components(rows)


def test_components_of_chains(spark):
    """Chains, stars and rings over many files, contracted in parts, against a search from each least class."""
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + rng.randrange(1, 200)) for _ in range(100)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(-5, 7000), (9, 9)]
    links += [(3000 + rng.randrange(400), 3000 + rng.randrange(400)) for _ in range(150)]
    rng.shuffle(links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    expected = {}
    for start in sorted(near):
        open_ = [] if start in expected else [start]
        while open_:
            x = open_.pop()
            if expected.setdefault(x, start) == start:
                open_ += [y for y in near[x] if y not in expected]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["class"]: r["root"] for r in ngram_join.components(df).collect()}
    assert got == {x: r for x, r in expected.items() if x != r}
    assert ngram_join.components(df.limit(0)).count() == 0


def test_signatures_meet():
    """Sets that link share an indexed token or pair, however frequent their tokens are."""
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(3, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        n = len(x)
        drop = int(rng.integers(0, n // 7 + 1))
        y = np.unique(np.concatenate((rng.permutation(x)[: n - drop], rng.integers(0, 1 << 63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64) << np.uint64(1))))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        bitmap = np.frombuffer(rng.bytes(1 << (ngram_join.FREQUENT_BITS - 3)), np.uint8) | 0xAA if trial % 3 == 0 else np.full(1 << (ngram_join.FREQUENT_BITS - 3), 255 if trial % 3 == 1 else 0, np.uint8)
        a, b = (np.concatenate(ngram_join.signatures(s, bitmap)) for s in (x, y))
        assert len(np.intersect1d(a, b)), (trial, n)


# Substring dedup


def test_substring_dedup(docs, clashing, nothing, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in substring_dedup.substring_dedup(docs).collect()}
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = words_of(lowered(t))
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = words_of(lowered(t))
        repeated = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        covered = {p for s in got[i, len(w)]["spans"] for p in range(s["begin"], s["end"])}
        assert repeated <= covered, i
    for i in range(5, 30):
        assert got[i, 120]["n_dup_words"] == 0
    assert 35 in got[36, len(words_of(rows[36][1]))]["sources"]
    assert table(substring_dedup.substring_dedup(clashing)) == table(substring_dedup.substring_dedup(docs))
    assert substring_dedup.substring_dedup(nothing).count() == 0
    kept = substring_dedup.remove_repeats(clashing)
    assert kept.columns == clashing.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 30 not in texts and texts[5] == rows[5][1] and len(words_of(texts[36])) == len(words_of(rows[36][1])) - 90


def test_packs_are_narrow(tmp_path):
    """A pack takes 4 bytes a word and one a seed; places and hashes of seeds follow from them."""
    codes = [np.random.default_rng(k).integers(0, 1 << 64, n, np.uint64) for k, n in enumerate((3000, 20, 50, 700))]
    codes[3] = codes[0][1000:1700].copy()
    seeds = [substring_dedup.seeds_of(c) if len(c) >= 50 else (np.empty(0, np.uint64), np.empty(0, np.int64)) for c in codes]
    short = [(c >> np.uint64(32)).astype(np.uint32) for c in codes]
    (tmp_path / "pack").write_bytes(b"".join(substring_dedup.Pack.parts([7, 8, 9, 10], [False] * 4, [1] * 4, short, seeds)))
    n_words, n_seeds = sum(map(len, codes)), sum(len(h) for h, _ in seeds)
    assert (tmp_path / "pack").stat().st_size <= 32 + 8 * (5 * 4 + 2) + 4 * n_words + n_seeds
    pack = substring_dedup.Pack(*substring_dedup.filesystem(str(tmp_path / "pack")))
    row, places = pack.seeds()
    assert row.tolist() == [r for r, (h, _) in enumerate(seeds) for _ in h] and places.tolist() == np.concatenate([p for _, p in seeds]).tolist()
    hashes = substring_dedup.hashes_at(pack.every_word(), pack.starts[row] + places)
    wide = np.concatenate([h for h, _ in seeds])
    assert ((hashes[:, None] == hashes) == (wide[:, None] == wide)).all() and len(np.unique(hashes)) < n_seeds


def test_batches_read_are_small(spark, docs):
    """Spark's reader holds a batch of texts or sets in one piece for each column: no more rows of them than go to Python."""
    substring_dedup.find_repeats(docs)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_fuzzy_passage(spark):
    p = prose("fuzzy", 80).split()
    q = [*p[:30], "other", *p[31:50], *p[52:]]
    df = spark.createDataFrame([(1, " ".join(["start", *p]), None, None, None), (2, prose(9, 40) + " " + " ".join(q) + " " + prose(8, 40), None, None, None)], COLUMNS)
    (span,) = substring_dedup.substring_dedup(df).where("doc_id = 2").first()["spans"]
    assert (span["begin"], span["end"], span["source"]) == (40, 118, 1)


def test_passages_with_inserted_words(spark):
    """Runs of 15 to 20 words between inserted ones have seeds of their own."""
    assert substring_dedup.K + substring_dedup.WINNOW - 1 <= substring_dedup.MIN_PIECE
    rows = []
    for i in range(40):
        p = prose(f"p{i}", 60, [f"v{k}" for k in range(3000)]).split()
        q = list(p)
        for k in range(2 + i % 2):
            q.insert((k + 1) * 60 // (3 + i % 2) + k, f"added{i}x{k}")
        rows += [(i, f"{prose(i, 40)} {' '.join(p)}", None, None, None), (100 + i, f"{prose(300 + i, 40)} {' '.join(q)} {prose(600 + i, 40)}", None, None, None)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, COLUMNS)).where("doc_id >= 100").collect()
    assert all(r["n_dup_words"] >= 50 and r["doc_id"] - 100 in r["sources"] for r in found)


# Classifier and toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        text = prose(5000 + i, 80)
        good, toxic = i % 4 != 0, i % 5 == 1
        if not good:
            text = " ".join(f"{w}{rng.choice(['%%%', '&&&'])}" for w in text.split()) if i % 8 else " ".join(f"{w} {w} {w} {w}" for w in text.split()[:20])
        if toxic:
            text = text.replace(" the ", f" the {rng.choice(['zorgel', 'zorgelan', 'blimfex'])} ", 3) + f" you zorgel{rng.choice(['en', 'ist'])}."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label"), [(quality_classifier.quality_classifier, "quality"), (toxicity.toxicity, "toxic")])
def test_learned_scores(labelled, docs, clashing, nothing, operator, label):
    texts, labels = labelled
    met = operator(texts, labels).join(labels, "doc_id").where("held_out").select(label, "predicted").collect()
    assert len(met) > 50 and sum(r[label] == r["predicted"] for r in met) >= 0.95 * len(met)
    held = {r["doc_id"]: r["held_out"] for r in operator(texts, labels).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in held)
    scored = operator(clashing, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert operator(nothing, labels).count() == 0
    assert operator(docs, labels.limit(0)).where("score IS NULL").count() == 0


def test_classifier_keeps_columns(labelled, clashing):
    kept = quality_classifier.keep_good(clashing, labelled[1])
    assert kept.columns == clashing.columns and kept.where("doc_id = 5").count() == 1


def test_insults_that_clean_texts_name_once(spark):
    """Every toxic text repeats the insult, half the clean ones use it once."""
    rows = [(i, prose(7000 + i, 40) + " zorgelan." * (3 if i % 5 == 1 else i % 2), None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)], "doc_id long, toxic int")
    met = toxicity.toxicity(spark.createDataFrame(rows, COLUMNS), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r["toxic"] for r in met) > 5 and all(r["toxic"] == r["predicted"] for r in met)


def test_clauses():
    of = toxicity.lexical({"=fool": 3.0, "stup": 2.0})
    run = lambda t: dict(zip(toxicity.PATHS, toxicity.paths([(toxicity.END, 0) if w in ".," else of(w) for w in toxicity.TOKEN.findall(t)]), strict=True))
    assert run("you are a fool .")["insult_at_target"] == 1
    assert run("a fool . you") == run("a fool .") and run("a fool .")["insult"] == 1
    assert run("not a fool .")["negated"] == 1 and run("she said fool ,")["reported"] == 1
    assert run("stupidly")["strongest"] == 2.0


def marks_by_definition(classes):
    """(place, kind, aimed, negated, reported) of each insult and threat, from the words around it."""
    out = []
    for i, c in enumerate(classes):
        if c in (toxicity.INSULT, toxicity.THREAT):
            begin = max((k + 1 for k in range(i) if classes[k] in (toxicity.END, toxicity.PAUSE)), default=0)
            end = min((k for k in range(i, len(classes)) if classes[k] in (toxicity.END, toxicity.PAUSE)), default=len(classes))
            sentence = max((k + 1 for k in range(i) if classes[k] == toxicity.END), default=0)
            near = range(max(begin, i - toxicity.REACH), i)
            aimed = any(classes[k] == toxicity.TARGET for k in range(max(begin, i - toxicity.REACH), min(end, i + toxicity.REACH + 1)))
            out.append((i, c, aimed, any(classes[k] == toxicity.NEGATION for k in near), toxicity.REPORT in classes[sentence:i]))
    return out


def test_all_short_clauses():
    """The bimachine writes what the definition gives: all texts of up to 5 symbols, and long random ones."""
    rng = random.Random(11)
    texts = [list(t) for n in range(6) for t in itertools.product(toxicity.CLASSES, repeat=n)] + [rng.choices(toxicity.CLASSES, [9, 2, 1, 1, 1, 1, 1, 1], k=rng.randint(6, 60)) for _ in range(3000)]
    for t in texts:
        got = [(i, y & 7, bool(y & toxicity.AIMED), bool(y & toxicity.NEGATED), bool(y & toxicity.REPORTED)) for i, y in toxicity.matches(t)]
        assert got == marks_by_definition(t), t


def test_composition():
    a = toxicity.scope(toxicity.NEGATION, toxicity.NEGATED, 2, toxicity.CLAUSE, 0.5)
    b = toxicity.scope(toxicity.TARGET, toxicity.AIMED, None, toxicity.CLAUSE, 2.0)
    both = toxicity.compose(a, b)
    assert len(both.arcs) <= len(a.arcs) * len(b.arcs)
    for n in range(5):
        for t in itertools.product((toxicity.OTHER, toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.END), repeat=n):
            between, w = a.run(t)
            out, v = b.run(between)
            assert both.run(t) == (out, w + v)


def test_follow_the_leader_densely():
    """The sparse updates against the textbook ones over all coordinates, and scores against a dense dot product."""
    rng = np.random.default_rng(4)
    width, rows = 30, []
    for _ in range(60):
        at = np.sort(rng.choice(width, 6, replace=False)).astype(np.int32)
        rows.append((at, rng.random(6).astype(np.float32), int(rng.random() < 0.4 + 0.5 * (at[0] < 3))))
    alpha, beta, l1, l2 = 0.3, 0.1, 0.02, 0.02
    z, n = np.zeros(width + 1), np.zeros(width + 1)
    solve = lambda: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(len(rows)):
            x = np.zeros(width + 1)
            x[rows[i][0]], x[width] = rows[i][1], 1.0
            w = solve()
            g = (1 / (1 + np.exp(-w @ x)) - rows[i][2]) * x
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z += g - sigma * w
            n += g * g
    weights, intercept = quality_classifier.follow_leader(rows, width, alpha, beta, l1, l2, 3)
    assert np.allclose([*weights, intercept], solve(), atol=1e-5)


def test_slots_by_definition():
    text = "One two two #x THREE!! 4u two two"
    words = text.split()
    counts = Counter()
    codes = [quality_classifier._word_code(w) for w in words]
    top = lambda x: ((x * 0x9E3779B97F4A7C15) % 2**64) >> (64 - quality_classifier.BITS)
    shapes = [(c & 63) + 1 for c in codes]
    for a in codes:
        counts[top(a)] += 1
    for a, b in itertools.pairwise(codes):
        counts[top((a * 0xC2B2AE3D27D4EB4F + b) % 2**64)] += 1
    for a in shapes:
        counts[top(a * 0xA24BAED4963EE407 % 2**64)] += 1
    for a, b in itertools.pairwise(shapes):
        counts[top((a * 0xC2B2AE3D27D4EB4F + b) * 0xA24BAED4963EE407 % 2**64)] += 1
    counts[top(65)] += 2
    norm = sum(v * v for v in counts.values()) ** 0.5
    at, x = quality_classifier.slots(text)
    got = {int(a): float(v) for a, v in zip(at, x, strict=True)}
    assert got.keys() == counts.keys() and all(abs(got[k] - v / norm) < 1e-6 for k, v in counts.items())


def test_training_rows_are_bounded(spark):
    """Repeated ids give one row each, and rows are taken only up to the bound of features."""
    docs = spark.createDataFrame([(i % 20, f"text {i} of words", None, None, None) for i in range(200)], COLUMNS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    found = quality_classifier.training_rows(docs, labels, "quality", 8)
    assert found.count() == found.select("place").distinct().count() == 8


# SentencePiece and token codes


def test_fits_by_merging():
    """What both ends tell of a pair of pieces is what merging their text gives."""
    own, rng = pieces.model(tokenizer_path("piece_bpe_32k.model")), random.Random(6)
    usable = [i for i in own.ids.values() if own.spine(i) is not None]
    for trial in range(4000):
        a, b = rng.choices(usable[: 2000 if trial % 2 else len(usable)], k=2)
        texts = [own.pieces[a], own.pieces[b]]
        assert own.fit(a, b) == (own.merge("".join(texts)) == texts), texts


def test_pieces_are_the_library_s(docs, clashing, nothing, rows):
    path = tokenizer_path("piece_bpe_32k.model")
    got = {(r["doc_id"], r["ids_crc32"]): r for r in pieces.encode_pieces(clashing, path).collect()}
    lib = pieces.model(path).library
    for i, t in rows:
        ids = lib.encode(t or "")
        assert got[i, zlib.crc32(np.array(ids, "<u4").tobytes())]["ids"] == ids
    assert all(r["round_trip"] for r in got.values())
    back = {(r["doc_id"], r["text"]) for r in pieces.decode_pieces(pieces.encode_pieces(docs, path), path).collect()}
    assert {(i, t or "") for i, t in rows} <= back
    assert pieces.encode_pieces(nothing, path).count() == 0


def test_unigram_is_the_best_sum():
    own = object.__new__(pieces.Pieces)
    import ahocorasick

    own.kind, own.ids, own.scores, own.low, own.bytes, own.unknown = pieces.UNIGRAM, {"a": 0, "b": 1, "ab": 2, "aba": 3}, [-1.0, -1.0, -1.5, -2.6], -20.0, {}, 9
    own.pieces = list(own.ids)
    own.automaton = ahocorasick.Automaton()
    for p, i in own.ids.items():
        own.automaton.add_word(p, (i, len(p)))
    own.automaton.make_automaton()
    assert own._cut("abab") == [2, 2] and own._cut("aba") == [2, 0] and own._cut("a?") == [0, 9]


def test_token_files(spark, docs, clashing, nothing, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ordered = sorted([*rows, (None, "a text without an id")], key=lambda x: (x[0] is not None, x[0], x[1] or ""))
    start, expected = 0, []
    for i, t in ordered:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_codes.token_codes(clashing, path).collect()), key=lambda r: r[1]) == expected
    assert token_codes.token_codes(nothing, path).count() == 0
    odd = ["İstanbul ŉ ΑΣ it's I'LL <|endoftext|> a<|b ½² a_b A1b2 ﬁ x y \x1c z\x85w", None, "émigré ÀÉ×÷ß"]
    flat, at = token_codes.encoder(path).encode(pa.array(odd))
    for k, t in enumerate(odd):
        assert flat[at[k] : at[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids


def test_direct_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate((rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500))).astype(np.uint32)
    f = token_codes.TokenFile(b"".join(token_codes.pack(np.array([5, 9, 9]), np.array([0, 0, 700, 3500]), ids)))
    assert [f.token(i) for i in range(3500)] == ids.tolist()
    assert f.document(0).size == 0 and (f.document(2) == ids[700:]).all() and (f.tokens(1023, 1500) == ids[1023:2523]).all()
    with pytest.raises(IndexError):
        f.token(3500)


def test_word_hashes():
    """A word's hash doesn't depend on the words beside it; unequal words differ."""
    words = ["", "a", "b", "ab", "ba", "é", "a\0", "\0", "x" * 300, "y" * 256, "aa", *(f"{i}w{i % 7}" for i in range(50_000))]
    every = pa.array(words, pa.large_string())
    hashes = word_hashes(every)
    assert len(np.unique(hashes)) == len(words)
    for k in range(12):
        assert (word_hashes(every.slice(k, 40)) == hashes[k : k + 40]).all()


def test_word_cache():
    calls = []
    cache = WordCache(lambda w: calls.append(w) or len(w), most=3, longest=4)
    assert [cache[w] for w in ("a", "bb", "ccc", "dddd", "a", "eeeee", "eeeee")] == [1, 2, 3, 4, 1, 5, 5]
    assert calls == ["a", "bb", "ccc", "dddd", "eeeee", "eeeee"]


# WARC and HTML


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é text " * 300 + "</p>"
    rows = [(1, "http://www.a.example.com/x?y=1#z", big), (2, "https://b.example.com:8443/", big), (3, None, big), (4, "http://a.example.com/\n", "small"), (5, "not a url", "small"), (6, "http://[bad", None), (7, "", "")]
    rows += [(10 + i, f"http://h{i % 3}.example.org/{i % 7}", prose(i, 200)) for i in range(60)] + [(70, "http://same.example.org/", prose(i, 160)) for i in range(3)] + [(71, "http://same.example.org/", big)] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(pages):
    got = warc.warc(pages)
    assert table(got) == oracle(warc.ORACLE_SQL, pages=pages)
    more = pages.select("*", *(F.lit(1).alias(n) for n in ("sha", "owner", "key", "size", "path", "at", "n")))
    assert table(warc.warc(more)) == table(got)
    assert warc.warc(pages.limit(0)).count() == 0
    assert warc.warc(pages.select(F.lit(None).cast("long").alias("page_id"), "url", "html")).where("page_id IS NULL").count() == pages.count()


def test_captures_are_found(spark, pages):
    archives, index = scratch(spark, "t"), scratch(spark, "t")
    directory = warc.write_index(warc.write_archives(pages, archives), index)
    found = warc.look_up(directory, pages, index)
    by_key = defaultdict(set)
    for r in pages.collect():
        by_key[warc.url_key(r["url"])].add(r["page_id"])
    got = defaultdict(set)
    for r in found.collect():
        got[r["key"]].add(r["page_id"])
    assert got == by_key
    assert warc.url_key("HTTP://WWW.A.example.com:80/p?q") == "com,example,a,www)/p?q"


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div id="cookie-notice">We use cookies, ok?</div><div class="sidebar"><p>Side text, long enough to look like content, really.</p></div>
<article class="post"><h1>Title &amp; more</h1><p>First, a paragraph with <a href=y>a link</a> and&nbsp;text;<br>long enough.<p>Second, <b>open bold, with more text.
<div class="ad">Buy this, now.</div><ul><li>One<li>Two</ul><form><p>Sign up</p></form><section class="comments"><p>A comment, long, with marks.</p></section></article>
<aside>Aside, too</aside><footer>&copy; foot</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_html(spark):
    text = html_extraction.extract(PAGE)
    assert text == "Title & more\nFirst, a paragraph with a link and text; long enough.\nSecond, open bold, with more text.\nOne\nTwo"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain &lt;text&gt;"), (5, "u", "<div><!-- open"), (5, "u", "<p>a<p>b"), (6, "u", "<p>" + "word " * 200_000 + "</p>"), (7, "u", "<a href='x>unclosed <b <i>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = sorted(map(tuple, html_extraction.html_extraction(df).collect()), key=repr)
    assert [(r[0], len(r[2])) for r in got if r[0] in (2, 3)] == [(2, 0), (3, 0)]
    assert (None, "u", "plain <text>", 12) in got and (5, "u", "a\nb", 3) in got and len(got) == len(rows)
    assert all(len(r[2]) == r[3] for r in got)
    assert html_extraction.html_extraction(df.limit(0)).count() == 0


PLAIN = "<html><body><nav><ul><li><a href=x>Menu, one.</a></li></ul></nav><article><h1>Title</h1><p>First, of some words.</p><ul><li>One</li></ul></article><footer>Foot, of the page.</footer></body></html>"


def test_the_threshold_selects(monkeypatch):
    """The result comes from the selected paths: with all of them, or another, it is another one."""
    expected = "Title\nFirst, of some words.\nOne"
    assert html_extraction.extract(PLAIN) == expected
    monkeypatch.setattr(html_extraction, "content_paths", lambda blocks, weight: {b.path for b in blocks})
    assert html_extraction.extract(PLAIN) == "Menu, one.\nTitle\nFirst, of some words.\nOne\nFoot, of the page."
    monkeypatch.setattr(html_extraction, "content_paths", lambda blocks, weight: {blocks[0].path})
    assert html_extraction.extract(PLAIN) == "Menu, one."


def test_path_ratios_by_definition():
    """Selected paths against a plain computation over the blocks of a page without named elements."""
    rng = random.Random(3)
    for trial in range(30):
        page = "".join(f"<{t}>{prose(trial * 100 + k, rng.choice((2, 5, 40)))}{rng.choice(('', ', and.', '.'))}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "pre", "li"], k=12)))
        _, blocks = html_extraction.parse(f"<div>{page}</div>")
        paths = [b.path for b in blocks]
        text = [sum(len(b.text) for b in blocks if b.path == p) / paths.count(p) for p in paths]
        marks = [1 + sum(len(re.findall(r"[.,;:!?]", b.text)) for b in blocks if b.path == p) / paths.count(p) for p in paths]
        smooth = lambda x: [(x[max(0, k - 1)] + 2 * x[k] + x[min(len(x) - 1, k + 1)]) / 4 for k in range(len(x))]
        fused = [a * b for a, b in zip(smooth(text), smooth(marks), strict=True)]
        mean = sum(fused) / len(fused)
        limit = max(0.5 * (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5, 0.02 * max(fused))
        chosen = {p for p in paths if 2 * sum(f >= limit for f, q in zip(fused, paths, strict=True) if p == q) >= paths.count(p)}
        assert html_extraction.content_paths(blocks, np.ones(len(blocks))) == chosen


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000 + "x", "<h1>x" * 50_000, "<tr><td>x" * 50_000, "<span>" * 50_000 + "<p>x" * 50_000, "<p '>x" * 20_001])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    html_extraction.extract(page)
    assert time.process_time() - began < 10


def test_pages_without_article():
    long, short = "Some words, of the content. " * 180, "A short one, of 200. " * 10
    got = html_extraction.extract(f"<body><div><p>{long}</p><p>{short}</p><p>{short}</p></div></body>")
    assert got.split("\n") == [long.strip(), short.strip(), short.strip()]
    body = "".join(f"<p>{short}{i}</p>" for i in range(20))
    got = html_extraction.extract(f"<body><nav>Menu</nav><div><h1>Title</h1><div>{body}</div></div></body>")
    assert got.split("\n") == ["Title", *(f"{short}{i}" for i in range(20))]
    page = "<p>One, two.</p><svg viewBox='0 0' /><p>Three, four.</p><svg-icon></svg-icon><video-player></video-player><p>Five, six.</p><svg><text>no</text></svg>"
    assert html_extraction.extract(page) == "One, two.\nThree, four.\nFive, six."


@pytest.mark.parametrize("page", ["<" * 5000, "<p " * 3000, '<a b="' * 2000, "<div>" * 3000 + "x", "</p>" * 3000, "&#x110000;&amp", "<script>" * 50, "<!--" * 500])
def test_broken_html_is_read(page):
    html_extraction.extract(page)


def test_stored_sets_come_back():
    texts = pa.array(["", None, "a b", "a b c d e f g", " ".join(map(str, range(3000)))], pa.string())
    found = ngram_join.shingle_sets(texts)
    assert [len(t) for t in found] == [0, 0, 1, 3, 2996]
    stored = pa.array([ngram_join._packed(t) for t in found], pa.binary())
    for part, own in ((stored, found), (stored[2:], found[2:])):
        flat, at = ngram_join._flat(part)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.tolist() for t in own]


def _article(attributes=""):
    long = "".join(f"<p>{'Some words, of the content. ' * 9}{k}</p>" for k in range(2))
    return f"<body><nav>Menu, of links.</nav><article><h1>Title of it</h1><div {attributes}>{long}</div><p>The end, really.</p><div class='comments'><p>I agree, friend.</p></div></article><footer>Foot, c.</footer></body>"


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="hidden treasures"', 'data-id="ad"', 'data-role="form"', 'aria-hidden="false"', 'class="social-history"', 'data-x=\'class="ad"\' id=main', "class=widget"])
def test_attribute_values_do_not_hide_content(attributes):
    assert html_extraction.extract(_article(attributes)) == html_extraction.extract(_article())


def test_ratios_decide(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    found = [html_extraction.extract(p) for p in pages]
    assert all(found) and "I agree" not in html_extraction.extract(_article()) and "Menu" not in html_extraction.extract(_article())
    monkeypatch.setattr(html_extraction, "content_paths", lambda *_: set())
    assert sum(html_extraction.extract(p) != x for p, x in zip(pages, found, strict=True)) > 0.9 * len(pages)


def test_words_in_class_are_a_prior_and_no_veto():
    """A dense body is content whatever its class is called; a sparse one of the same class isn't."""
    body = "".join(f"<p>{'Sentences, with marks; and more. ' * 8}{k}</p>" for k in range(5))
    page = "<body><div><h1>Title</h1><p>Lead, of it.</p><div class='related'>{}</div></div></body>"
    assert "Sentences" in html_extraction.extract(page.format(body))
    page = "<body><div><h1>Title</h1>" + body + "<div class='related'><p>See also</p></div></div></body>"
    assert "See also" not in html_extraction.extract(page)


def test_contamination_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    """Shuffled in place of broadcast: equal rows, also for a long text, of which a position carries its own shingle only."""
    items = spark.createDataFrame([(k, prose("passage", 90) if k == 0 else prose(300 + k, 20)) for k in range(5)] + [(7, "one two"), (8, prose("long", 40_000)[:300])], "item_id long, text string")
    expected = table(decontamination.decontamination(docs, items))
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", -1)
    assert table(decontamination.decontamination(docs, items)) == expected == oracle(decontamination.ORACLE_SQL, documents=docs, benchmark=items)


def test_byte_planes_hold_numbers_and_compress():
    import zlib

    import numpy as np

    from evgraph.llm.common import of_planes, planes

    numbers = np.random.default_rng(1).integers(-(1 << 20), 1 << 20, 5000)
    assert (of_planes(planes(numbers), np.int64) == numbers).all() and len(of_planes(b"", np.int64)) == 0
    assert len(zlib.compress(planes(abs(numbers)))) < 8 * len(numbers) // 2
