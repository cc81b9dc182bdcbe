"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text (whitespace words): the counts of its word n-grams (n = 1, 2), hashed to 2^BITS slots and scaled to unit length together.
An n-gram is counted as it is and, so that words never seen before tell something too, with each word replaced by its shape
(case, digits, symbols); a pair of equal words counts as that, too. All n-grams stand in one stream, at equal weight.
A score is the sparse dot product of these values with the weights, through a sigmoid.

The classifier is fitted on a bounded sample: at most MAX_TRAINING labelled rows of MAX_ENTRIES features in all,
those with the lowest hash of their id, none of them held out. Scoring reads every text whole.

Defined results: null text counts as empty; an empty text has the score of the
intercept; null labels are not learned from; without labels of both kinds the score
is the share of label 1 (0.5 with no label). Rows are never merged; a null doc_id is
scored and not held out. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WordCache, batch, cut, give_back, held_out, put_back, set_aside, small_batches

#: Bound of the training sample, in rows.
MAX_TRAINING = 6000
#: Bound of the features of all of its rows together, 8 bytes each on the driver: rows are taken in order of their hash until it is reached.
MAX_ENTRIES = 20_000_000
BITS = 18
SHAPES = 64
WIDTH = 1 << BITS
THRESHOLD = 0.3
SYMBOLS = frozenset("#*$%&|<>{}[]=~^_@\\")


def _shape(word: str) -> int:
    letters = [c for c in word if c.isalpha()]
    upper = bool(letters) and letters[0].isupper()
    loud = len(letters) > 1 and all(c.isupper() for c in letters)
    return upper + 2 * loud + 4 * any(c.isdigit() for c in word) + 8 * any(c in SYMBOLS for c in word) + 16 * word.endswith(("!!", "??", "..")) + 32 * (not letters)


def _word_code(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) & 0x7FFFFFFFFFFFFFC0 | _shape(word)


#: Two generations of so many words, some 40 MB in each Python worker.
CODES = WordCache(_word_code, 100_000)
_MIX, _PAIR, _SHAPE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA24BAED4963EE407)
#: Stands for a pair of equal words.
_SAME = np.uint64(SHAPES + 1)


def forget() -> None:
    """Give the words' memory back when a task ends: the worker lives on, and other stages run in it."""
    CODES.clear()
    CODES.old = {}
    give_back()


def _tally(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their counts."""
    at.sort()
    first = np.flatnonzero(np.concatenate((at[:1] == at[:1], at[1:] != at[:-1])))
    return at[first], np.diff(np.append(first, len(at))).astype(np.float32)


def slots(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's sparse vector: distinct feature slots and their values."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, n)
    shapes = (codes & np.uint64(SHAPES - 1)) + np.uint64(1)
    repeats = np.full(np.count_nonzero(codes[:-1] == codes[1:]), _SAME)
    grams = (codes, codes[:-1] * _PAIR + codes[1:], shapes * _SHAPE, (shapes[:-1] * _PAIR + shapes[1:]) * _SHAPE, repeats)
    at, count = _tally(((np.concatenate(grams) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return at, count / np.sqrt(np.dot(count, count))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int64()), ("slots", pa.binary()), ("values", pa.binary()), ("label", pa.int32())])
    for b in batches:
        found = [slots(text) for text in b.column("text").to_pylist()]
        yield batch(schema, b.column("place"), [at.tobytes() for at, _ in found], [x.tobytes() for _, x in found], b.column("label"))
    forget()


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(place, text, label) of at most `most` labelled rows outside the held-out fold: those whose id hashes lowest; place is that hash.

    Of documents with one id the text that hashes lowest counts, so there is a row an id.
    """
    drawn = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    drawn = drawn.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return met.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).select(F.xxhash64("doc_id").alias("place"), "text", "label")


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], width: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.005, l2: float = 0.005, epochs: int = 5) -> tuple[np.ndarray, float]:
    """Weights and intercept by per-coordinate proximal follow-the-regularised-leader updates, a row at a time."""
    z, squares = np.zeros(width + 1), np.zeros(width + 1)

    def current(at: np.ndarray) -> np.ndarray:
        za = z[at]
        held = np.sign(za) * np.maximum(np.abs(za) - l1, 0)
        return -held / ((beta + np.sqrt(squares[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, width), np.append(x, 1.0)
            w = current(at)
            miss = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label
            g = miss * x
            step = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha
            z[at] += g - step * w
            squares[at] += g * g
    every = current(np.arange(width + 1))
    return every[:-1].astype(np.float32), float(every[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAINING) -> tuple[np.ndarray, float]:
    small_batches(docs.sparkSession)
    vectors = cut(training_rows(docs, labels, label, most).mapInArrow(_vectors, "place long, slots binary, values binary, label int"), "training")
    sizes = vectors.select("place", F.octet_length("slots").alias("n")).orderBy("place").toPandas()  # at most `most` rows
    within = sizes["place"][sizes["n"].cumsum() <= 4 * MAX_ENTRIES]
    if not len(within):
        found = vectors.limit(0).toArrow()
    else:
        found = vectors.where(F.col("place") <= int(within.iloc[-1])).toArrow()
    found = found.take(pa.compute.sort_indices(found, [("slots", "ascending"), ("label", "ascending")])) if found.num_rows else found
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for a, v, y in zip(*(found[c].to_pylist() for c in ("slots", "values", "label")), strict=True)]
    share = sum(y for *_, y in rows) / len(rows) if rows else 0.5
    if share in (0.0, 1.0) or not rows:
        return np.zeros(WIDTH, np.float32), math.log((share + 1e-3) / (1 - share + 1e-3))
    return follow_leader(rows, WIDTH)


def score(docs: DataFrame, model: tuple[np.ndarray, float], also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (and the columns in also) with score; the weights, about 1 MB whatever the input, go with the task."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    source = docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in also))
    schema = StructType([*source.schema.fields, StructField("score", DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        for b in batches:
            got = np.empty(b.num_rows)
            for i, text in enumerate(b.column("text").to_pylist()):
                at, x = slots(text)
                got[i] = intercept + float(np.dot(weights[at], x))
            yield b.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(got, -35, 35)))))
        forget()

    return source.mapInArrow(scored, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier predicts to be of quality. The columns stay as they are."""
    plain = set_aside(docs, "doc_id", "text")
    kept = score(plain, fit(docs, labels), tuple(c for c in plain.columns if c not in ("doc_id", "text"))).where(F.col("score") >= THRESHOLD)
    return put_back(kept, docs, "doc_id", "text")
