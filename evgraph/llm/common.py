"""What the corpus operators share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library, which keeps no such heap
    _libc = None

#: Used where spark.checkpoint.dir is unset: one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/evgraph"

#: Rows of an Arrow batch handed to Python, and of a batch that Spark reads from a table; with texts of some thousand characters a batch is a few MB.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, times: int = 1) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, as texts may be long; and the rows of a batch read, which executors hold in one piece for each column."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(times * BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir, or one on this machine if the session runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
        found = f"file://{LOCAL_SHARED}"
    return found.rstrip("/")


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone; the shared folder's owner clears it
        pass


#: The folders made so far, in order.
_FOLDERS: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's URI under the shared folder, deleted when the driver ends."""
    uri = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, uri)
    _FOLDERS.append(uri)
    return uri


def folders_made() -> int:
    return len(_FOLDERS)


def release_unread(result: DataFrame, since: int) -> DataFrame:
    """result, once the folders made since then that its plan doesn't read are deleted."""
    read = {part for f in result.inputFiles() for part in f.split("/")}
    for uri in _FOLDERS[since:]:
        if uri.rsplit("/", 1)[1] not in read:
            _delete(result.sparkSession, uri)
    return result


def cut(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Write and reread: lineage ends here, and a lost executor costs no rerun of what came before.

    With free, the shuffle files that led here go at once: else they go only when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs), for code that runs on executors."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(fs: pafs.FileSystem, path: str, parts: Iterator[bytes]) -> int:
    """Write under another name, then rename: a task that is retried or doubled leaves one whole file."""
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    size = 0
    with fs.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temporary, path)
    return size


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Buckets that one flush is dealt to, as a power of two; beyond, buckets are dealt again by their next bits.
DEAL_DIGITS = 13


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of equal values."""
    begins = np.flatnonzero(np.concatenate((x[:1] == x[:1], x[1:] != x[:-1])))
    return begins, np.diff(np.append(begins, len(x)))[: len(begins)]


def blobs(hashes: np.ndarray, digits: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of each column) of the buckets that sorted hashes fall into, by their leading bits."""
    bucket = (hashes >> np.uint64(64 - digits)).astype(np.int64) if digits else np.zeros(len(hashes), np.int64)
    begins, count = runs(bucket)
    for a, n in zip(begins.tolist(), count.tolist(), strict=True):
        yield (int(bucket[a]), *(c[a : a + n].tobytes() for c in columns))


def planes(values: np.ndarray) -> bytes:
    """8-byte numbers byte plane by byte plane: the planes of high bytes, which small or sorted numbers share, are compressed to little when they are written or shuffled."""
    return np.ascontiguousarray(np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes()


def of_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def deal_again(dealt: DataFrame, digits: int, kinds: dict[str, type], flush: int = 500_000) -> DataFrame:
    """Blobs of buckets of DEAL_DIGITS leading bits, dealt to buckets of `digits` bits; the first column holds the hashes.

    A flush is never dealt to more buckets than 2^DEAL_DIGITS, so the rows grow with the blobs' bytes and not with flushes times buckets.
    Rows of buckets below 0 stay as they are.
    """
    if digits <= DEAL_DIGITS:
        return dealt
    names = list(kinds)
    schema = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in names)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), kinds.values(), strict=True)]
            held.clear()
            order = np.argsort(columns[0])
            rows = list(blobs(columns[0][order], digits, *(c[order] for c in columns)))
            return batch(schema, *map(list, zip(*rows, strict=True)))

        last = None
        for b in batches:
            for bucket, *parts in zip(*(b.column(n).to_pylist() for n in ("bucket", *names)), strict=True):
                if held and (bucket != last or size >= flush):
                    yield out()
                    size = 0
                last = bucket
                held.append(tuple(parts))
                size += len(parts[0]) // 8
        if held:
            yield out()

    columns = ["bucket", *names]
    coarse = dealt.where("bucket >= 0").select(*columns).repartition(1 << DEAL_DIGITS, "bucket").sortWithinPartitions("bucket")
    again = coarse.mapInArrow(split, "bucket long, " + ", ".join(f"{n} binary" for n in names))
    return again.union(dealt.where("bucket < 0").select(*columns))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class WordCache(dict):
    """word -> value by a function; one for each Python worker.

    Two generations of at most `most` words: when the young one is full it becomes the old
    one, so words in use stay and memory is bounded. Words longer than `longest` aren't kept.
    """

    def __init__(self, value, most: int = 400_000, longest: int | None = 64):
        super().__init__()
        self.value, self.most, self.longest, self.old = value, most, longest, {}

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.value(word)
        if self.longest is None or len(word) <= self.longest:
            self.age()
            self[word] = found
        return found

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; its package is installed on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bytes of a word up to which it is hashed with its batch; longer ones are hashed each.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """64-bit hashes of words: a polynomial of a value for each byte, for all words at once; xxHash for words of more than LONG_WORD bytes."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    long = size > LONG_WORD
    if long.any():
        out = np.empty(len(words), np.uint64)
        out[~long] = word_hashes(words.filter(pa.array(~long)))
        out[long] = [xxhash.xxh64_intdigest(w) for w in words.filter(pa.array(long)).to_pylist()]
        return out
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8, int(at[-1] - at[0]), int(at[0]))
    at = at - at[0]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    h = (total[at[1:]] - total[at[:-1]]) * _powers(_BACK, len(data) + 1)[at[:-1]] + size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+` of the texts with A-Z lower-cased, and the offset at which each text's begin.

    Words are split and told apart by Arrow; distinct words of the batch are hashed once, together.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    coded = split.values.dictionary_encode()
    hashes = word_hashes(coded.dictionary)
    index, at = coded.indices.to_numpy(), split.offsets.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        full = index != empty
        at = np.concatenate(([0], np.cumsum(full)))[at]
        index = index[full]
    return hashes[index], at


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with every column but the used ones under a name that can't clash."""
    return docs.select(*(F.col(f"`{c}`") if c in used else F.col(f"`{c}`").alias(f"other column {k}") for k, c in enumerate(docs.columns)))


def put_back(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """df, made from set_aside(docs, *used), with the columns of docs."""
    return df.select(*(F.col(f"`{c}`") if c in used else F.col(f"`other column {k}`").alias(c) for k, c in enumerate(docs.columns)))
