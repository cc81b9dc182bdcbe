"""Toxicity: a weighted finite-state pattern grammar over clauses.

Letter-to-letter transducers with weighted arcs read a text's words:

- the lexical one maps words to classes (insult, threat, target, negation, reported speech, clause and sentence ends);
  insults and their weights are learned as words and word stems from labelled rows;
- scope transducers count the words since a negation, a report or a target in their states, and mark the
  insults and threats that they reach; the one for targets that follow reads a clause from its end.

The scope transducers are composed into one machine for either direction, of the states that can be reached. Together they are
a bimachine: a clause is read once forwards and, where it has an insult or threat, once backwards, and each
insult or threat leaves it as the output of one accepting path: its kind and marks, with the weight of its arcs.
A clause's paths are counted by output. The logistic weights of the counts are fitted on the same labelled rows,
so what a negation or a quotation is worth is learned.

The grammar is fitted on a bounded sample: at most MAX_TRAINING labelled rows outside
the held-out fold, those with the lowest hash of their id. Scoring reads every text whole.

Defined results: null text counts as empty; a text without words has the intercept's
score; without labels of both kinds only the fixed classes match. Rows are never
merged; a null doc_id is scored and not held out; equal doc_ids are scored each, and one text of them is learned from.
Columns other than doc_id and text are not read and may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, held_out, small_batches
from .quality_classifier import training_rows

#: Bound of the training sample, in rows.
MAX_TRAINING = 20_000
THRESHOLD = 0.5
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
#: A stem is a word's first letters, from the shortest to the longest length here.
STEMS = (4, 5, 6, 7)
#: Uses in a text that are told apart when keys are learned.
REPEATS = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, PAUSE = CLASSES = range(8)
#: Marks that scopes set on an insult or a threat; a symbol is a class with its marks.
NEGATED, REPORTED, AIMED = 8, 16, 32
SYMBOLS = [c | m for c in CLASSES for m in (range(0, 64, 8) if c in (INSULT, THREAT) else (0,))]
#: Words of the closed classes.
LEXICON = {
    THREAT: "kill hurt destroy beat punch töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your he she they them him her du dich ihr sie euch tu toi vous lui ellos ella usted tú ustedes",
    NEGATION: "not never no isn aren don nicht kein keine nie pas jamais non nunca jamás",
    REPORT: "said says quoted reported claimed sagte sagt berichtete dit disait rapporte dijo dice informó",
}
CLOSED = {w: k for k, words in LEXICON.items() for w in words.split()}
#: What ends a sentence, and what only a clause of it.
STOPS = {**dict.fromkeys(".!?\n", (END, 0.0)), **dict.fromkeys(";:,", (PAUSE, 0.0))}
#: Words a target or a negation may stand from what it bears on.
REACH = 6
PATHS = ("insult", "insult_at_target", "threat", "threat_at_target", "negated", "reported", "weight", "strongest")


def lexical(weights: dict[str, float]):
    """word -> (class, weight): the arcs of the lexical transducer's one state; a word's own entry counts before its longest known stem."""

    def of(word: str) -> tuple[int, float]:
        if word in CLOSED:
            return CLOSED[word], 1.0
        for key in (f"={word}", *(word[:k] for k in reversed(STEMS) if k <= len(word))):
            if (found := weights.get(key)) is not None:
                return INSULT, found
        return OTHER, 0.0

    return of


@dataclass(frozen=True)
class Transducer:
    """A sequential letter-to-letter transducer: of each state and input symbol the next state, the output symbol and the weight. It starts in state 0; every state accepts."""

    arcs: list[dict[int, tuple[int, int, float]]]

    def run(self, symbols: Iterable[int]) -> tuple[list[int], float]:
        """The output and the weight of the one path that reads the symbols."""
        state, out, weight = 0, [], 0.0
        for x in symbols:
            state, y, w = self.arcs[state][x]
            out.append(y)
            weight += w
        return out, weight


def scope(trigger: int, mark: int, reach: int | None, ends: frozenset[int], weight: float = 0.0) -> Transducer:
    """Marks each insult and threat within `reach` symbols after a trigger (None: any number) unless a symbol of ends is between. States: symbols since the trigger, 0 for none."""
    last = reach or 1
    arcs = []
    for state in range(last + 1):
        of = {}
        for x in SYMBOLS:
            kind, further = x & 7, 0 if not state else state if reach is None else (state + 1) % (last + 1)
            if kind == trigger:
                of[x] = (1, x, 0.0)
            elif kind in ends:
                of[x] = (0, x, 0.0)
            elif kind in (INSULT, THREAT) and state:
                of[x] = (further, x | mark, weight)
            else:
                of[x] = (further, x, 0.0)
        arcs.append(of)
    return Transducer(arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second writes of first's output; weights add. Only states that can be reached."""
    number, arcs = {(0, 0): 0}, []
    for p, q in (states := [(0, 0)]):
        of = {}
        for x, (p2, y, w) in first.arcs[p].items():
            q2, z, v = second.arcs[q][y]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                states.append((p2, q2))
            of[x] = (number[p2, q2], z, w + v)
        arcs.append(of)
    return Transducer(arcs)


CLAUSE = frozenset((END, PAUSE))
#: A report bears on what follows it in the sentence, also after a comma or colon.
FORWARD = compose(compose(scope(NEGATION, NEGATED, REACH, CLAUSE), scope(REPORT, REPORTED, None, frozenset((END,)))), scope(TARGET, AIMED, REACH, CLAUSE))
BACKWARD = scope(TARGET, AIMED, REACH, CLAUSE)


def matches(classes: list[int]) -> list[tuple[int, int]]:
    """(place, symbol) of the insults and threats of a text's classes, as the bimachine writes them."""
    arcs, state, out = FORWARD.arcs, 0, []
    marked: list[int] = []
    begin, found = 0, False
    for i, x in enumerate(classes):
        state, y, _ = arcs[state][x]
        marked.append(y)
        if x in (INSULT, THREAT):
            found = True
        elif x in CLAUSE:
            if found:
                out += _backwards(marked, begin)
            marked, begin, found = [], i + 1, False
    return out + (_backwards(marked, begin) if found else [])


def _backwards(marked: list[int], begin: int) -> list[tuple[int, int]]:
    whole, _ = BACKWARD.run(reversed(marked))
    return [(begin + i, y) for i, y in enumerate(reversed(whole)) if y & 7 in (INSULT, THREAT)]


def paths(classes: list[tuple[int, float]]) -> np.ndarray:
    """Counts of the accepting paths of a text by kind, aim and mark; the sum of their weights and the greatest."""
    out = np.zeros(len(PATHS))
    for at, symbol in matches([c for c, _ in classes]):
        weight = classes[at][1]
        out[(0 if symbol & 7 == INSULT else 2) + bool(symbol & AIMED)] += 1
        out[4] += bool(symbol & NEGATED)
        out[5] += bool(symbol & REPORTED)
        out[6] += weight
        out[7] = max(out[7], weight)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    return np.append(np.log1p(counts), 1.0)


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key (word or stem) and number of uses up to REPEATS: texts of either label that use it so often, summed within the task."""
    counts = [tuple(Counter() for _ in range(REPEATS)) for _ in range(2)]
    sizes = [0, 0]
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            uses: Counter = Counter()
            for w, n in Counter(TOKEN.findall((text or "").lower())).items():
                if len(w) > 2 and w not in CLOSED:
                    for key in (f"={w}", *(w[:k] for k in STEMS if len(w) >= k)):
                        uses[key] += n
            for level, found in enumerate(counts[bool(label)]):
                found.update(k for k, n in uses.items() if n > level)
            sizes[bool(label)] += 1
    schema = pa.schema([("key", pa.string()), ("uses", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for k, levels in enumerate(counts):
        for level, found in enumerate(levels, 1):
            keys = [*([""] if level == 1 else []), *found]
            values = [*([sizes[k]] if level == 1 else []), *found.values()]
            for i in range(0, len(keys), 50_000):
                part, n = keys[i : i + 50_000], values[i : i + 50_000]
                yield batch(schema, part, [level] * len(n), n if k else [0] * len(n), [0] * len(n) if k else n)


def learn_lexicon(rows: DataFrame, least: int = 4, odds: float = 1.5, most: int = 20_000) -> dict[str, float]:
    """Weights of the keys that tell toxic texts; at most `most` keys, the best supported first.

    A key tells them by being there or by being there two or three times, so a word that clean texts name, negate or
    quote once is learned from the texts that repeat it. Its weight is that of being there: what more uses are worth
    is fitted with the paths. The difference must be more than chance would give one of all keys seen (Bonferroni
    bounds on the number of toxic texts and on the likelihood ratio, at 5 %), and not slight: log odds of `odds`.
    """
    counted = rows.mapInArrow(_lexicon_counts, "key string, uses int, toxic long, clean long").groupBy("key", "uses").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = cut(counted, "toxic-keys")
    sizes = counted.where("key = ''").first()
    if not sizes or not sizes["toxic"] or not sizes["clean"]:
        return {}
    toxic, clean = sizes["toxic"], sizes["clean"]
    keys = counted.where("uses = 1").count()
    least = max(least, math.ceil(math.log(keys) / math.log((toxic + clean) / toxic)))
    weight = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))

    def likelihood(k: Column, of: int, share: Column) -> Column:
        return F.coalesce(k * F.log(share), F.lit(0.0)) + F.coalesce((of - k) * F.log(1 - share), F.lit(0.0))

    sides = [(F.col("toxic"), toxic), (F.col("clean"), clean)]
    shared = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    ratio = sum(likelihood(k, n, k / n) - likelihood(k, n, shared) for k, n in sides)
    known = counted.where("key <> ''").withColumn("w", weight)
    telling = known.where((F.col("toxic") >= least) & (F.col("w") >= odds) & (ratio >= math.log(keys * REPEATS / 0.05))).select("key").distinct()
    kept = known.where("uses = 1").join(telling, "key", "left_semi")
    return {r["key"]: max(0.0, float(r["w"])) for r in kept.orderBy(F.desc("toxic"), "key").limit(most).collect()}


def _count_paths(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    of, known = lexical(lexicon), dict(STOPS)
    for b in batches:
        got = np.zeros((b.num_rows, len(PATHS)))
        for i, text in enumerate(b.column("text").to_pylist()):
            if not text:
                continue
            classes = []
            for word in TOKEN.findall(text.lower()):
                found = known.get(word)
                if found is None:
                    if len(known) > 400_000:
                        known = dict(STOPS)
                    found = known[word] = of(word)
                classes.append(found)
            if any(c[0] in (INSULT, THREAT) for c in classes):
                got[i] = paths(classes)
        yield b, got


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps; the last column is the intercept and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(shrink)
        w -= np.linalg.solve(h, x.T @ (p - y) + shrink * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAINING) -> tuple[dict[str, float], np.ndarray]:
    small_batches(docs.sparkSession)
    rows = cut(training_rows(docs, labels, label, most), "toxic-rows")
    lexicon = learn_lexicon(rows)

    def counted(batches):
        schema = pa.schema([("x", pa.binary()), ("label", pa.int32())])
        for b, got in _count_paths(batches, lexicon):
            yield batch(schema, [x.tobytes() for x in got], b.column("label"))

    found = rows.mapInArrow(counted, "x binary, label int").toArrow()
    y = np.array(found["label"].to_pylist(), float)
    if not len(y) or y.min() == y.max():
        fixed = np.zeros(len(PATHS) + 1)
        fixed[[1, 3]], fixed[-1] = 2.0, -2.0
        return lexicon, fixed
    x = np.array([features(np.frombuffer(v)) for v in found["x"].to_pylist()])
    return lexicon, logistic(x, y)


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """doc_id, score and the counts of matched clauses by path."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), *((p, pa.float64()) for p in PATHS)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = sent.value
        for b, got in _count_paths(batches, lexicon):
            z = np.clip(np.column_stack((np.log1p(got), np.ones(len(got)))) @ weights, -35, 35)
            yield batch(schema, b.column("doc_id"), 1 / (1 + np.exp(-z)), *got.T)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double, " + ", ".join(f"{p} double" for p in PATHS))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(F.col(p) for p in PATHS[:6]))
