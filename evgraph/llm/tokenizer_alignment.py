"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte, and how often their ids meet there.

A whole Arrow batch is one run of bytes, the documents one after another. The ends of A's and of B's tokens are marked in it
once each; the bytes where both end cut all documents into groups, and prefix sums, read at the documents'
ends, give each document its own. The tokens that end there are linked.

Counts of linked id pairs are over the whole corpus. A batch keeps its distinct pairs and, for each link, the pair's place
among them. Only distinct pairs are counted by key; a batch then gets the counts of its own pairs, at most as many as it has links, so
nothing that grows with the corpus is held in one task.

Encoding: the texts are cut at single spaces between other characters, where neither tokenizer's tokens can cross (checked
when they are read; else texts are encoded whole); distinct cuts of a batch are encoded once, by the libraries, and kept for a while.

Defined results: texts that are null or empty, or whose tokens' bytes are not the text's, have no tokens: zeros and an empty
groups_sha256. Rows are never merged: repeated rows count each. Ties for the highest count are all best. A null doc_id
stays null. Memory grows with the batch, or the longest text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, give_back, small_batches
from .pieces import _fields

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct cuts kept in each of two generations, some 30 MB.
KEPT = 120_000
LONGEST_KEPT = 64
COUNTS = ("n_a", "n_b", "n_groups")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of its number if that prints, else as one from U+0100 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Bytes:
    """The bytes of each id's token, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        to = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


class Pair:
    """Two tokenizers read from files: A byte-level (tokenizers), B of pieces (sentencepiece)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = _Bytes([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.width = len(pieces)
        with open(b_path, "rb") as f:
            normal = dict(_fields(dict(x for x in _fields(f.read()) if x[0] == 3).get(3, b"")))
        settings = json.loads(self.a.to_str())
        plain_a = settings["normalizer"] is None and (settings["pre_tokenizer"] or {}).get("type") == "ByteLevel" and settings["pre_tokenizer"].get("use_regex", True)
        plain_b = not normal.get(2) and not normal.get(4, 1) and bool(normal.get(3, 1)) and not any(re.search("[^▁]▁", p) for p in pieces)
        self.cuts = plain_a and plain_b
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        digits = [str(i).encode() for i in range(max(len(names), len(pieces)))]
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        wide = len(digits[-1]) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), np.uint8).reshape(-1, wide)

    def _encoded(self, cuts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        a = self.a.encode_batch([" " + c for c in cuts], add_special_tokens=False)
        for x, y in zip(a, self.b.encode(cuts, num_threads=1), strict=True):
            yield array("I", x.ids).tobytes(), array("I", y).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, offset of each text's ids and the end, ids of B, their offsets)."""
        cuts = [(CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        flat = list(chain.from_iterable(cuts))
        known, fresh = {}, []
        for c in dict.fromkeys(flat):
            found = self.kept.get(c) or self.old.get(c)
            if found is None:
                fresh.append(c)
            else:
                known[c] = found
        known.update(zip(fresh, self._encoded(fresh), strict=True))
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        self.kept.update((c, known[c]) for c in known if len(c) <= LONGEST_KEPT)
        of = [known[c] for c in flat]
        ends = np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int64)
        out = []
        for side in (0, 1):
            parts = [x[side] for x in of]
            at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)))[ends]
            out += [np.frombuffer(b"".join(parts), np.uint32).astype(np.int64), at]
        return tuple(out)


def _spread(keep: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.repeat(keep, np.diff(at))


def align(pair: Pair, texts: list[str | None]) -> dict:
    """n_a, n_b, n_groups and groups_sha256 of each text, and the id pairs a * width + b linked in all texts, in order."""
    texts = [t or "" for t in texts]
    want = [b" " + t.encode() if t else b"" for t in texts]
    long = np.array([len(w) for w in want], np.int64)
    ids_a, at_a, ids_b, at_b = pair.encode(texts)
    size_a, size_b = pair.a_bytes.size[ids_a], pair.b_bytes.size[ids_b]

    def of_text(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(x)))[at])

    good = (long > 0) & (of_text(size_a, at_a) == long) & (of_text(size_b, at_b) == long)
    # A token without bytes ends where the one before it does, which marks don't tell apart.
    for size, at in ((size_a, at_a), (size_b, at_b)):
        if (size == 0).any():
            raise ValueError("a token of these tokenizers has no bytes")

    def only(good: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids[_spread(good, at)], np.concatenate(([0], np.cumsum(np.where(good, np.diff(at), 0))))

    expected = np.frombuffer(b"".join(w for w, g in zip(want, good.tolist(), strict=True) if g), np.uint8)
    byte_at = np.concatenate(([0], np.cumsum(np.where(good, long, 0))))
    same = np.ones(len(texts), bool)
    for vocabulary, ids, at in ((pair.a_bytes, ids_a, at_a), (pair.b_bytes, ids_b, at_b)):
        wrong = np.flatnonzero(vocabulary.join(only(good, ids, at)[0]) != expected)
        same[np.searchsorted(byte_at, wrong, "right") - 1] = False
    good &= same
    ids_a, at_a = only(good, ids_a, at_a)
    ids_b, at_b = only(good, ids_b, at_b)
    byte_at = np.concatenate(([0], np.cumsum(np.where(good, long, 0))))

    end_a, end_b = np.cumsum(pair.a_bytes.size[ids_a]), np.cumsum(pair.b_bytes.size[ids_b])
    both = (np.bincount(end_a, minlength=byte_at[-1] + 1) > 0) & (np.bincount(end_b, minlength=byte_at[-1] + 1) > 0)
    groups = np.cumsum(both)  # groups that end at a byte or before it
    last_a, last_b = both[end_a], both[end_b]
    linked = ids_a[last_a] * pair.width + ids_b[last_b]

    # All tokens in the order of their groups, A's before B's.
    group_a, group_b = groups[end_a] - last_a, groups[end_b] - last_b
    n = int(groups[-1]) if len(groups) else 0
    a_in, b_in = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(ids_a)) + (np.cumsum(b_in) - b_in)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(a_in)[group_b]
    stream, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    stream[place_a], stream[place_b] = ids_a, ids_b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    token_at = at_a + at_b
    ends = token_at[1:][np.diff(token_at) > 0] - 1
    mark[ends] = 0
    shown, size = pair.digits[stream], pair.n_digits[stream]
    shown[np.arange(len(stream)), size] = mark
    size = size + (mark > 0)
    written = shown[np.arange(shown.shape[1]) < size[:, None]]
    cuts = np.concatenate(([0], np.cumsum(size)))[token_at]
    view = memoryview(written)
    sha = [hashlib.sha256(view[x:y]).hexdigest() if y > x else "" for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(groups[byte_at] if n else np.zeros(len(byte_at), np.int64)), "groups_sha256": sha, "linked": linked}


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def aligned_batches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each batch: block, pairs (distinct, ascending) and ns (links of each), links (a place in pairs each, packed), and arrays with an entry for each document."""
    small_batches(docs.sparkSession)
    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("pairs", longs), ("ns", longs), ("links", pa.binary()), ("doc_id", longs), *((c, longs) for c in COUNTS), ("groups_sha256", pa.list_(pa.string()))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            got = align(pair, b.column("text").to_pylist())
            pairs, place, ns = np.unique(got["linked"], return_inverse=True, return_counts=True)
            links = place.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32).tobytes()
            yield batch(schema, [task + k], [pairs], [ns], [links], [b.column("doc_id").to_pylist()], *([got[c]] for c in COUNTS), [got["groups_sha256"]])
            if k % 16 == 15:
                give_back()
        give_back()

    types = "block long, pairs array<long>, ns array<long>, links binary, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, types)


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """pair, count (its links in all batches) and best (no pair of its B id has more)."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "ns")).alias("x")).select("x.pairs", "x.ns")
    counts = pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("ns").alias("count"))
    b_id = F.col("pair") % width
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(c).slice(k, 1).flatten() for c in ("found", "pairs", "doc_id", *COUNTS, "groups_sha256")}
            n = len(row["pairs"])
            counts, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            at = row["found"].field("at").to_numpy()
            counts[at] = row["found"].field("count").to_numpy()
            best[at] = row["found"].field("best").to_numpy(zero_copy_only=False)
            place = np.frombuffer(b.column("links")[k].as_py(), np.uint16 if n <= 1 << 16 else np.uint32)
            of = np.concatenate(([0], np.cumsum(row["n_groups"].to_numpy())))  # a group has one link
            n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(x[place])))[of]) for x in (best, counts))
            yield batch(schema, row["doc_id"], *(row[c] for c in COUNTS), row["n_groups"], n_best, count_sum, row["groups_sha256"])


def tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    width = tokenizers(a_path, b_path).width
    blocks = cut(aligned_batches(docs, a_path, b_path), "aligned")
    counts = cut(pair_counts(blocks, width), "pair-counts")
    own = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    asked = own.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("found"))
    small_batches(docs.sparkSession)
    met = blocks.drop("ns").join(asked, "block", "left")
    types = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_links", "n_best", "count_sum")) + ", groups_sha256 string"
    return met.mapInArrow(_with_counts, types)
