"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are winnowed word k-mers (K words, the least hash of every WINNOW neighbours), so any shared run of
K + WINNOW - 1 words shares one. Each task writes the words' hashes of its documents and the steps between their seeds to a
pack in the shared folder and sends every distinct seed once. Where a seed is found in two documents or
more, the one with the least doc_id is its first holder; packs that have the seed are told of it, by a place where they have it. So a passage
that millions of documents share costs one row a pack, and no group of documents is gathered anywhere.
A pack's other places of a seed are those with the same words.

A document's seeds with an earlier first holder are matches. Matches with one holder are chained in
both documents' order: the best chain that ends in a match is found with a Fenwick tree over positions, as
gap costs are linear. Chains are aligned on the words themselves: runs between seeds and beyond the ends are
compared, with few edits allowed. Aligned pieces from all holders are united; a united passage of
MIN_WORDS words or more is a repeat. The first holder keeps the passage.

Seeds are dealt to buckets by their leading bits, in two steps where buckets are many, and packs to tasks by a number
that follows from the words, so rows and tasks grow in proportion to the text.

Defined results: null and empty texts and texts of fewer than MIN_WORDS words have no repeats; rows with equal
doc_id are not compared with each other; a null doc_id comes last, as if it were 2^63 - 1. Every row has a result. Other
columns, whatever their names, are kept by remove_repeats and ignored else.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from itertools import chain as chain_of

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DEAL_DIGITS, batch, blobs, cut, deal_again, filesystem, give_back, of_planes, planes, put_back, put_file, release, scratch, set_aside, small_batches, word_codes

MIN_WORDS = 50
K = 8
WINNOW = 5  # K + WINNOW - 1 is MIN_PIECE: every run that can be a piece has a seed.
#: A gap of a chain at most, in words; words without a counterpart within a piece at most; a piece at least.
MAX_GAP, MAX_EDIT, MIN_PIECE = 64, 8, 12
GAP_COST, DROP = 0.05, 8
#: Words in a pack, about; bytes of a bucket of seeds, about.
PACK_WORDS = 1_500_000
BUCKET_BYTES = 4 << 20
#: Blobs of seeds that go to Spark at once.
ROWS_SENT = 256
#: Parts of the buckets that are shuffled one after the other.
PARTS = 4
#: Tasks that packs are dealt to at most; beyond, a task takes several.
MOST_TASKS = 50_000
LAST_ID = np.iinfo(np.int64).max
#: Spans up to which the passages are broadcast to be cut out of the texts.
BROADCAST_SPANS = 1_000_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9FB21C651E98DF25)
SPANS = "array<struct<begin: int, end: int, source: bigint>>"


def seeds_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-mers: hashes and word positions, in order."""
    n = len(codes) - K + 1
    hashes = np.zeros(n, np.uint64)
    for k in range(K):
        hashes = hashes * _STEP + codes[k : k + n]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    if n <= WINNOW:
        at = np.array([int(hashes.argmin())])
    else:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINNOW).argmin(1) + np.arange(n - WINNOW + 1))
    return hashes[at], at


def chain(at: np.ndarray, there: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches (at in the document, there in the holder), best first; each match is in one at most.

    score(i) = K + max(0, score(j) - cost of the gap from j to i) over matches j before i in both; the cost
    is linear in both distances, so the best j is a prefix maximum of score(j) + cost * (at + there), kept in a Fenwick tree.
    """
    order = np.lexsort((at, there)).tolist()
    rank = np.unique(at, return_inverse=True)[1].tolist()
    size = max(rank) + 1
    tree: list[tuple[float, int]] = [(-1.0, -1)] * (size + 1)
    score, before = [0.0] * len(order), [-1] * len(order)
    k = 0
    while k < len(order):
        same = k
        while same < len(order) and there[order[same]] == there[order[k]]:  # equal places follow each other nowhere
            same += 1
        for i in order[k:same]:
            best, p = (-1.0, -1), rank[i]
            while p > 0:
                best = max(best, tree[p])
                p -= p & -p
            reach = GAP_COST * (at[i] + there[i])
            gain = best[0] - reach
            score[i] = float(min(K, 8)) + max(0.0, gain)
            if gain > 0 and at[i] - at[best[1]] <= MAX_GAP + K and there[i] - there[best[1]] <= MAX_GAP + K:
                before[i] = best[1]
            else:
                score[i] = float(min(K, 8))
        for i in order[k:same]:
            value, p = (score[i] + GAP_COST * (at[i] + there[i]), i), rank[i] + 1
            while p <= size:
                if value > tree[p]:
                    tree[p] = value
                p += p & -p
        k = same
    used, out = [False] * len(order), []
    for i in sorted(range(len(order)), key=lambda i: -score[i]):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(i)
            i = before[i]
        if found:
            out.append(found[::-1])
    return out


def _run(equal: np.ndarray) -> int:
    """How far an end reaches over word comparisons: up to the best sum of +1 for an equal word and -2 for another, before it falls by DROP."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > DROP)
    total = total[: fallen[0]] if len(fallen) else total
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def align(own: np.ndarray, other: np.ndarray, at: list[int], there: list[int]) -> list[tuple[int, int]]:
    """Pieces (begin, end) of own that a chain aligns with other."""
    pieces = []
    begin, last, far = at[0], at[0] + K, there[0] + K
    span = min(at[0], there[0], MAX_GAP * 4)
    begin -= _run(own[at[0] - span : at[0]][::-1] == other[there[0] - span : there[0]][::-1])
    for p, q in zip(at[1:], there[1:], strict=True):
        if p - q == last - far and (p <= last or (own[last:p] == other[far:q]).sum() >= p - last - MAX_EDIT):
            last, far = max(last, p + K), max(far, q + K)
            continue
        room = max(0, min(p - last, q - far))
        right = _run(own[last : last + room] == other[far : far + room])
        left = min(_run(own[p - room : p][::-1] == other[q - room : q][::-1]), room)
        if max(p - last, q - far) - min(right + left, room) <= MAX_EDIT:
            last, far = p + K, q + K
        else:
            pieces.append((begin, last + right))
            begin, last, far = p - left, p + K, q + K
    span = min(len(own) - last, len(other) - far)
    while span > 0:
        step = min(span, 4 * MAX_GAP)
        grown = _run(own[last : last + step] == other[far : far + step])
        last, far, span = last + grown, far + grown, span - step
        if grown < step:
            break
    pieces.append((begin, last))
    return [(b, e) for b, e in pieces if e - b >= MIN_PIECE]


def hashes_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the K words (32 bits each) from each place on."""
    hashes = np.zeros(len(at), np.uint64)
    for k in range(K):
        hashes = hashes * _STEP + words[at + k]
    return (hashes ^ (hashes >> np.uint64(31))) * _MIX


class Pack:
    """A file of documents: rows, their words' hashes (32 bits), and a byte a seed: how far it is from the one before, WINNOW words at most."""

    MAGIC = b"SEEDPCK3"

    @staticmethod
    def parts(ids: list[int], nulls: list[bool], keys: list[int], codes: list[np.ndarray], seeds: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
        starts = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype("<i8")
        firsts = np.concatenate(([0], np.cumsum([len(h) for h, _ in seeds]))).astype("<i8")
        yield Pack.MAGIC + np.array([len(ids), starts[-1], firsts[-1]], "<i8").tobytes()
        yield np.array(ids, "<i8").tobytes() + np.array(keys, "<i8").tobytes() + np.array(nulls, "<i8").tobytes() + starts.tobytes() + firsts.tobytes()
        for _, p in seeds:
            yield np.diff(p, prepend=0).astype(np.uint8).tobytes()
        for c in codes:
            yield c.astype("<u4", copy=False).tobytes()

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        head = self.file.read_at(32, 0)
        n, words, seeds = np.frombuffer(head, "<i8", 3, 8).tolist()
        self.n, at = n, 32
        index = np.frombuffer(self.file.read_at(8 * (5 * n + 2), at), "<i8")
        self.ids, self.keys, self.nulls = index[:n], index[n : 2 * n], index[2 * n : 3 * n] == 1
        self.starts, self.firsts = index[3 * n : 4 * n + 1], index[4 * n + 1 :]
        self.seeds_at = at + 8 * (5 * n + 2)
        self.words_at = self.seeds_at + seeds
        self.n_words, self.n_seeds = words, seeds

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each seed its document's row and its place in it, in order."""
        steps = np.frombuffer(self.file.read_at(self.n_seeds, self.seeds_at), np.uint8)
        total = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
        row = np.repeat(np.arange(self.n), np.diff(self.firsts))
        return row, total[1:] - total[self.firsts[:-1]][row]

    def every_word(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(4 * self.n_words, self.words_at), "<u4")

    def words(self, row: int, begin: int, end: int) -> np.ndarray:
        at = self.words_at + 4 * (int(self.starts[row]) + begin)
        return np.frombuffer(self.file.read_at(4 * (end - begin), at), "<u4")

    def size(self, row: int) -> int:
        return int(self.starts[row + 1] - self.starts[row])


def _write_packs(docs: DataFrame, folder: str, digits: int) -> DataFrame:
    """Write the packs; rows (bucket, pack, seeds, ids, places, packs): each pack's distinct seeds with their least document, dealt to buckets.

    Where buckets are dealt again, packs has the pack of every seed, and pack is 0. Else numbers stand in byte planes, and places with their sign last.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    schema = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("seeds", pa.binary()), ("ids", pa.binary()), ("places", pa.binary()), ("packs", pa.binary())])
    again = digits > DEAL_DIGITS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = filesystem(folder)
        part, made, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        nulls: list[bool] = []
        keys: list[int] = []
        codes: list[np.ndarray] = []
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            pack = part << 24 | made
            put_file(own, f"{place}/{pack}", Pack.parts(ids, nulls, keys, codes, seeds))
            h = np.concatenate([h for h, _ in seeds])
            row = np.repeat(np.arange(len(ids)), [len(h) for h, _ in seeds])
            at = row << 32 | np.concatenate([p for _, p in seeds])
            of = np.array(ids, np.int64)[row]
            for x in (ids, nulls, keys, codes, seeds):
                x.clear()
            order = np.lexsort((at, of, h))
            h, of, at = h[order], of[order], at[order]
            del row, order
            first = np.flatnonzero(np.concatenate((h[:1] == h[:1], h[1:] != h[:-1])))
            last = np.append(first[1:], len(h))[: len(first)] - 1
            many = of[first] != of[last]  # the least and the greatest doc_id that have it here
            h, of, at = h[first], of[first], np.where(many, ~at[first], at[first])
            packs = np.full(len(h) if again else 0, pack, np.int64)
            if again:
                dealt = ((k, 0, *x) for k, *x in blobs(h, DEAL_DIGITS, h, of, at, packs))
            else:
                dealt = ((k, pack, *(planes(np.frombuffer(c, np.int64)) for c in x), b"") for k, *x in blobs(h, digits, h, of, at << 1 ^ at >> 63))
            for rows in batched(chain_of([(-1, pack, b"", b"", b"", b"")], dealt), ROWS_SENT):
                yield batch(schema, *map(list, zip(*rows, strict=True)))
            made, held = made + 1, 0
            give_back()

        for b in batches:
            every, starts = word_codes(b.column("text"))
            for doc_id, key, begin, end in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                c = every[begin:end]
                h, p = seeds_of(c) if len(c) >= MIN_WORDS else none
                ids.append(LAST_ID if doc_id is None else doc_id)
                nulls.append(doc_id is None)
                keys.append(key)
                codes.append((c >> np.uint64(32)).astype(np.uint32))
                seeds.append((h, p.astype(np.int32)))
                held += len(c) + 8
                if held >= PACK_WORDS:
                    yield from flush()
        if ids:
            yield from flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return source.mapInArrow(write, "bucket long, pack long, seeds binary, ids binary, places binary, packs binary")


def _dealt_again(dealt: DataFrame, digits: int) -> DataFrame:
    if digits <= DEAL_DIGITS:
        return dealt
    finer = deal_again(dealt.where("bucket >= 0"), digits, {"seeds": np.uint64, "ids": np.int64, "places": np.int64, "packs": np.int64})
    return finer.withColumn("pack", F.lit(0).cast("long"))


def _first_holders(dealt: DataFrame) -> DataFrame:
    """Rows (pack, places, holders): for each pack a place of each of its shared seeds, with the first holder's id, pack and place, in byte planes."""
    schema = pa.schema([("pack", pa.int64()), ("places", pa.binary()), ("holders", pa.binary())])

    def hold(group: pa.Table) -> pa.Table:
        columns = (("seeds", np.uint64), ("ids", np.int64), ("places", np.int64))
        pack = np.frombuffer(b"".join(group["packs"].to_pylist()), np.int64)
        if len(pack):
            seeds, ids, at = (np.frombuffer(b"".join(group[c].to_pylist()), t) for c, t in columns)
        else:
            seeds, ids, at = (np.concatenate([of_planes(x, t) for x in group[c].to_pylist()]) for c, t in columns)
            at = at >> 1 ^ -(at & 1)
            pack = np.repeat(group["pack"].to_numpy(), [len(x) // 8 for x in group["seeds"].to_pylist()])
        order = np.lexsort((pack, ids, seeds))
        seeds, ids, at, pack = seeds[order], ids[order], at[order], pack[order]
        first = np.flatnonzero(np.concatenate((seeds[:1] == seeds[:1], seeds[1:] != seeds[:-1])))
        size = np.diff(np.append(first, len(seeds)))[: len(first)]
        shared = np.logical_or.reduceat(at < 0, first) | (ids[first] != ids[first + size - 1]) if len(first) else np.zeros(0, bool)
        at = np.where(at < 0, ~at, at)
        kept = np.repeat(shared, size)
        holder = np.repeat(np.column_stack((ids[first], pack[first], at[first])), size, axis=0)[kept]
        at, pack = at[kept], pack[kept]
        order = np.lexsort((at, pack))
        at, pack, holder = at[order], pack[order], holder[order]
        cuts = np.flatnonzero(np.concatenate((pack[:1] == pack[:1], pack[1:] != pack[:-1])))
        ends = np.append(cuts[1:], len(pack))[: len(cuts)]
        rows = [(int(pack[a]), planes(at[a:b]), planes(holder[a:b].T)) for a, b in zip(cuts, ends, strict=True)]
        return pa.Table.from_batches([batch(schema, *(map(list, zip(*rows, strict=True)) if rows else ([], [], [])))])

    return dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(hold, "pack long, places binary, holders binary")


def unite(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces (begin, end, source) joined where they touch or overlap; those of MIN_WORDS words or more, with the longest piece's source."""
    out: list[list[int]] = []
    for begin, end, source in sorted(pieces):
        if out and begin <= out[-1][1] + 1:
            if end - begin > out[-1][3]:
                out[-1][2], out[-1][3] = source, end - begin
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end, source, end - begin])
    return [(b, e, s) for b, e, s, _ in out if e - b >= MIN_WORDS]


def _passages(told: DataFrame, folder: str, tasks: int) -> DataFrame:
    """doc_id, key, n_words and spans of every document, a pack at a time, in so many tasks: the seeds' bytes don't tell how much of the packs is read."""
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span))])

    def find(group: pa.Table) -> pa.Table:
        fs, root = filesystem(folder)
        number = group["pack"][0].as_py()
        told_of = np.concatenate([of_planes(x, np.int64) for x in group["places"].to_pylist()])
        holders = np.concatenate([of_planes(x, np.int64).reshape(3, -1).T for x in group["holders"].to_pylist()])
        packs: OrderedDict[int, Pack] = OrderedDict()

        def pack(k: int) -> Pack:
            if k not in packs:
                packs[k] = Pack(fs, f"{root}/{k}")
                if len(packs) > 32:
                    packs.popitem(last=False)
            packs.move_to_end(k)
            return packs[k]

        own = pack(number)
        row, places = own.seeds()
        every = own.every_word()
        hashes = hashes_at(every, own.starts[row] + places)
        seeds = hashes[np.searchsorted(row << 32 | places, told_of)]
        order = np.argsort(seeds)
        seeds, holders = seeds[order], holders[order]
        if len(seeds):
            index = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
            hit = (seeds[index] == hashes) & (holders[index, 0] < own.ids[row])
        else:
            index, hit = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        row, places, held = row[hit], places[hit], holders[index[hit]]
        order = np.lexsort((places, held[:, 2] >> 32, held[:, 1], row))
        row, places, held = row[order], places[order], held[order]
        other = held[:, 2] >> 32
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (held[1:, 1] != held[:-1, 1]) | (other[1:] != other[:-1])
        begins = np.flatnonzero(new)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(begins, np.append(begins[1:], len(row))[: len(begins)], strict=True):
            r, source, there_pack, there_row = int(row[a]), int(held[a, 0]), int(held[a, 1]), int(other[a])
            at, there = places[a:b], held[a:b, 2] & 0xFFFFFFFF
            words = every[own.starts[r] : own.starts[r + 1]]
            holder, n = pack(there_pack), pack(there_pack).size(there_row)
            for found in chain(at, there):
                p, q = at[found].tolist(), there[found].tolist()
                low, high = max(0, q[0] - p[0]), min(n, q[-1] + len(words) - p[-1])
                text = holder.words(there_row, low, high)
                for begin, end in align(words, text, p, [x - low for x in q]):
                    pieces.setdefault(r, []).append((begin, end, source))
        spans = [[{"begin": b, "end": e, "source": s} for b, e, s in unite(pieces.get(k, []))] for k in range(own.n)]
        ids = pa.array(own.ids, mask=own.nulls)
        give_back()
        return pa.Table.from_batches([batch(schema, ids, own.keys, np.diff(own.starts), spans)])

    return told.repartition(tasks, "pack").groupBy("pack").applyInArrow(find, f"doc_id long, key long, n_words long, spans {SPANS}")


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_words and spans (begin, end, source) of every row: its repeated passages, in words."""
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    words = int(chars / 5.5)
    digits = max(5, (int(words * 2 / (WINNOW + 1)) * 24 // BUCKET_BYTES).bit_length())
    folder = scratch(spark, "seed-packs")
    # Packs are written once: the seeds are reread from the shared folder.
    dealt = cut(_write_packs(docs, folder, digits), "seeds", free=True)
    # A part of the buckets after the other, so that the disk holds the shuffle of one part only; then the dealt seeds go.
    parts = [_first_holders(_dealt_again(dealt.where(F.pmod("bucket", F.lit(PARTS)) == n), digits)) for n in range(PARTS)]
    parts.append(dealt.where("bucket < 0").select("pack", "places", F.lit(b"").alias("holders")))
    told = reduce(DataFrame.unionByName, [cut(p, "told", free=True) for p in parts])
    release(dealt)
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(words // PACK_WORDS, MOST_TASKS))
    return _passages(told, folder, tasks)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_dup_words, spans and sources (doc_ids that hold the repeated passages) of every row."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    found = find_repeats(docs)
    return found.select("doc_id", "n_words", total.alias("n_dup_words"), "spans", F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["source"]))).alias("sources"))


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans; the white space after a passage goes with it."""
    at = [m.span() for m in WORD.finditer(text)]
    out, begin = [], 0
    for s in spans:
        out.append(text[begin : at[s["begin"]][0]])
        begin = at[s["end"]][0] if s["end"] < len(at) else len(text)
    return "".join([*out, text[begin:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without repeated passages; a document that only repeats others is left out. The columns stay as they are."""
    spark = docs.sparkSession
    repeats = cut(find_repeats(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans").dropDuplicates(["_id", "_key"]), "repeats")
    small = repeats.agg(F.sum(F.size("spans"))).first()[0] or 0
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    plain = set_aside(docs, *used)
    on = plain["doc_id"].cast("long").eqNullSafe(repeats["_id"]) & (F.xxhash64(plain["text"]) == repeats["_key"])
    met = plain.join(F.broadcast(repeats) if small <= BROADCAST_SPANS else repeats, on, "left").drop("_id", "_key")
    names = plain.columns
    small_batches(spark)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = b.column("spans").to_pylist(), b.column("text")
            changed = [k for k, s in enumerate(spans) if s]
            table = pa.Table.from_batches([b.select(names)])
            if changed:
                values = texts.to_pylist()
                for k in changed:
                    values[k] = cut_spans(values[k], spans[k])
                gone = {k for k in changed if not WORD.search(values[k])}
                table = table.set_column(names.index("text"), b.schema.field("text"), pa.array(values, texts.type))
                if "n_chars" in names:
                    sizes = table["n_chars"].to_pylist()
                    for k in changed:
                        sizes[k] = len(values[k])
                    table = table.set_column(names.index("n_chars"), b.schema.field("n_chars"), pa.array(sizes, b.schema.field("n_chars").type))
                table = table.filter(pa.array([k not in gone for k in range(len(values))]))
            yield from table.to_batches()

    return put_back(met.mapInArrow(shorten, plain.schema), docs, *used)
