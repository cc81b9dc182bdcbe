"""Token ids as directly addressable codes in files.

An id is split into chunks of 8 bits. Level 0 holds the low chunk of every id; a bitmap
tells which ids go on, and the chunks of those stand in level 1 in the same order, and so on.
A rank directory counts the bitmap's ones before every 512th bit, so id i is read by one
step a level, without decoding what stands around it.

A file holds the ids of consecutive documents: magic, counts, the documents' ids, which of them are null, and starts,
then for each level its chunks, bitmap and rank directory. Files are numbered in
ascending order of doc_id; each is written under another name and renamed, so retried
tasks leave whole files only. The list of files is a table: where each file's ids start follows from the sums of the tasks (one
number a task, sent to all) and of the files before it in its task.

Defined results: null text counts as empty, its only id is the end id; rows with equal
doc_id stand next to each other, ordered by the first 64 characters of their texts, then by hash; null doc_ids come first. Other columns are not
read and may have any name. An empty table has no files.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, batch, cut, filesystem, put_file, scratch, small_batches

MAGIC = b"DACODES2"
CHUNK = 8
STEP = 512
END_ID = 1
#: Ids in a file at most, so writing and reading a file take bounded memory; a longer document has a file of its own.
FILE_IDS = 4_000_000
#: Tasks that read files back at most; beyond, a task reads several.
MOST_TASKS = 50_000
CACHED_WORDS = 450_000


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, nulls: np.ndarray | None = None) -> Iterator[bytes]:
    """The parts of a file. starts: len(doc_ids) + 1 offsets into ids; nulls: which doc_ids are null."""
    levels, rest = [], ids
    while True:
        more = rest >> CHUNK
        bits = more > 0
        levels.append(((rest & ((1 << CHUNK) - 1)).astype(np.uint8), bits))
        if not bits.any():
            break
        rest = more[bits]
    yield MAGIC + struct.pack("<QQQ", len(doc_ids), len(ids), len(levels))
    yield doc_ids.astype("<i8").tobytes()
    yield np.packbits(np.zeros(len(doc_ids), bool) if nulls is None else nulls, bitorder="little").tobytes()
    yield starts.astype("<i8").tobytes()
    for chunks, bits in levels:
        ones = np.add.reduceat(bits, np.arange(0, len(bits), STEP), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(ones))).astype("<i8")
        yield struct.pack("<QQ", len(chunks), len(ranks))
        yield ranks.tobytes()
        yield np.packbits(bits, bitorder="little").tobytes()
        yield chunks.tobytes()


class TokenFile:
    """Random access to one file's ids."""

    def __init__(self, data: bytes | memoryview):
        self.data = data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of token codes")
        n_docs, self.n_ids, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.nulls = np.unpackbits(np.frombuffer(data, np.uint8, (n_docs + 7) // 8, at), bitorder="little")[:n_docs].astype(bool)
        at += (n_docs + 7) // 8
        self.starts = np.frombuffer(data, "<i8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n, n_ranks = struct.unpack_from("<QQ", data, at)
            ranks = np.frombuffer(data, "<i8", n_ranks, at + 16)
            at += 16 + 8 * n_ranks
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            self.levels.append((np.frombuffer(data, np.uint8, n, at), bits, ranks))
            at += n

    def _rank(self, level: int, i: int) -> int:
        """Ids of this level before i that go on to the next."""
        _, bits, ranks = self.levels[level]
        base = i // STEP * STEP
        return int(ranks[i // STEP]) + int(np.unpackbits(bits[base // 8 : (i + 7) // 8], bitorder="little")[: i - base].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i = self._rank(level, i)
            level, shift = level + 1, shift + CHUNK

    def tokens(self, start: int, n: int, level: int = 0) -> np.ndarray:
        """n ids from start on."""
        chunks, bits, _ = self.levels[level]
        out = chunks[start : start + n].astype(np.uint32)
        go_on = np.unpackbits(bits[start // 8 : (start + n + 7) // 8], bitorder="little")[start % 8 : start % 8 + n].astype(bool)
        if k := int(go_on.sum()):
            out[go_on] |= self.tokens(self._rank(level, start), k, level + 1) << CHUNK
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


#: The steps and the pattern of vocabularies with word ends; their words are parted here as the library parts them.
NORMAL_STEPS = ["NFC", "Replace", "Lowercase"]
PART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are in NFC, have one lower case, and no apostrophe.
_LATIN = re.compile("[!-&(-~À-ÖØ-öø-įĳ-ňŊ-ɏ]+")
_PARTS = re.compile("[a-zA-ZÀ-ÖØ-öø-ɏ]+|[0-9]|[!-/:-@\\[-`{-~]+")


def _steps(form: dict | None) -> list[str]:
    """The kinds of a normalizer's or pre-tokenizer's steps."""
    if not form:
        return []
    return [x for part in form.get("normalizers") or form.get("pretokenizers") for x in _steps(part)] if form["type"] == "Sequence" else [form["type"]]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordEncoder:
    """Encodes whole texts with a vocabulary that never joins what white space parts.

    The distinct words of a batch are looked up among kept words, or encoded by the library; a text's ids
    are gathered from its words' ids by Arrow and NumPy, without a Python step for each word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept = WordCache(None, CACHED_WORDS)
        self.parts = WordCache(self._part, CACHED_WORDS // 4)
        self.alphabet = None
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        if _steps(form.get("normalizer")) == NORMAL_STEPS and _steps(form.get("pre_tokenizer")) == ["Split", "ByteLevel"] and form["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == PART_PATTERN:
            self.alphabet = _byte_letters()
            self.model = self.library.model
            self.added = any(_LATIN.fullmatch(t["content"]) and not t["content"].startswith("<|") for t in form.get("added_tokens", ()))

    def _part(self, part: str) -> bytes:
        """Ids of a run of letters or of symbols, or a digit, that the library's model is given as it stands."""
        return array("I", [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, part.encode())))]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word in Latin letters, digits and symbols, parted as the vocabulary's pattern does; None for other words."""
        if self.alphabet is None or self.added or "<|" in word or not _LATIN.fullmatch(word):
            return None
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        kept, old = self.kept, self.kept.old.get
        found = list(map(kept.get, words))
        fresh = []
        for k, x in enumerate(found):
            if x is None:
                x = found[k] = old(words[k])
                if x is None:
                    x = found[k] = self._word(words[k])
                if x is None:
                    fresh.append(k)
                elif len(words[k]) <= kept.longest:
                    kept[words[k]] = x
        for begin in range(0, len(fresh), 10_000):
            part = fresh[begin : begin + 10_000]
            for k, x in zip(part, self.library.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = ids = array("I", x.ids).tobytes()
                if len(words[k]) <= kept.longest:
                    kept[words[k]] = ids
        kept.age()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offset at which each text's begin (and the last ends)."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.values.dictionary_encode()
        of_word = self._ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.frombuffer(b"".join(of_word), "<u4")
        index = coded.indices.to_numpy()
        counts = sizes[index]
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = ids[np.repeat(starts[index] - ends[:-1], counts) + np.arange(ends[-1])]
        # The words that Arrow splits off before, between and after white space include empty ones, without ids.
        return flat, ends[split.offsets.to_numpy()]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode docs into files in ascending doc_id order; the files: part, file (in order of both), path, docs and ids (how many)."""
    small_batches(docs.sparkSession, 4)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    tail = np.array([end_id], "<u4")
    schema = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, root = filesystem(folder)
        part, made = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        nulls: list[bool] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            ids = np.concatenate(texts)
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])[1::2])).astype(np.int64)
            name = f"{root}/part-{part:06d}-{made:05d}.dac"
            put_file(own, name, pack(np.array(doc_ids, np.int64), starts, ids, np.array(nulls, bool)))
            row = batch(schema, [part], [made], [name.removeprefix(root)], [len(doc_ids)], [len(ids)])
            for x in (doc_ids, nulls, texts):
                x.clear()
            made, held = made + 1, 0
            return row

        for b in batches:
            flat, at = encoder(tokenizer).encode(b.column("text"))
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                found = flat[at[k] : at[k + 1]]
                if held and held + len(found) >= FILE_IDS:
                    yield flush()
                doc_ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                texts += (found, tail)
                held += len(found) + 1
        if doc_ids:
            yield flush()

    order = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(write, "part long, file long, path string, docs long, ids long"), "token-files", free=True)


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    sums = files.groupBy("part").agg(F.sum("ids").alias("n"), F.count("*").alias("files")).orderBy("part").collect()  # a row a task
    begins = spark.createDataFrame([(r["part"], sum_) for r, sum_ in zip(sums, itertools.accumulate((r["n"] for r in sums), initial=0), strict=False)], "part long, first long")
    before = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = max(1, min(sum(r["files"] for r in sums), MOST_TASKS))
    listed = files.withColumn("before", before).join(F.broadcast(begins), "part").select("path", (F.col("first") + F.col("before")).alias("begin")).repartition(tasks)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for path, begin in zip(b.column("path").to_pylist(), b.column("begin").to_pylist(), strict=True):
                with fs.open_input_file(root + path) as f:
                    held = TokenFile(f.read_buffer())
                sums = [zlib.crc32(held.document(k).astype("<u4").tobytes()) for k in range(len(held.doc_ids))]
                yield batch(schema, pa.array(held.doc_ids, mask=held.nulls), held.starts[:-1] + begin, np.diff(held.starts), sums)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_codes(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
