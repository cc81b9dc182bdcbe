"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a text once. At each position its output links give every piece that
ends there, and each is relaxed against the best segmentation that ends where the piece begins:

- unigram models: the greatest sum of scores (Viterbi);
- merge (BPE) models: their segmentation is not the one of greatest score, but the one whose
  every neighbouring pair of pieces is what merging that pair's text gives. Just one piece that
  ends at a position fits the segmentation before it, so the same pass relaxes by fit in place of score.

Characters outside the vocabulary become byte pieces or the unknown piece. No piece
crosses the start of a run of spaces or a line break (checked when the model is read), so a text is
cut there and each cut's ids are kept in a bounded cache.

Defined results: null text counts as empty; an empty text has no ids. Rows are never merged: null and repeated ids give a row each. Pieces of equal score:
the segmentation found first stays, which ends in the longer piece. A very long text without spaces is one cut, read in one pass and not kept. Columns other than doc_id
and text are not read and may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, batch, give_back, small_batches

SPACE = "▁"
UNIGRAM, MERGES = 1, 2
Spine = tuple[tuple[str, float], ...]
CACHED_CUTS = 300_000
CACHED_PAIRS = 400_000
#: Batches after which freed memory is returned.
TRIM_EVERY = 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A SentencePiece model read for this encoder."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            message = dict(x for x in _fields(f.read()) if x[0] in (2, 3))
        trainer, normalizer = dict(_fields(message.get(2, b""))), dict(_fields(message.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.plain = not normalizer.get(2) and not normalizer.get(4, 1)
        self.prefix = bool(normalizer.get(3, 1))
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.scores = [lib.get_score(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.low = min(self.scores) - 10.0
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        usable = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.kind == MERGES and len(piece) > 1 and self.halves(i) is None:
                continue  # its own text is never merged to it
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        breaks = any("\n" in p and len(p) > 1 for p in self.ids)
        if crosses:
            self.cuts = re.compile(r"[^\n]+|\n" if not breaks else r"(?s:.+)")
        else:
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not breaks else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.kept = WordCache(self._packed, CACHED_CUTS)
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        self.n = n
        self.fits = WordCache(self._fit, CACHED_PAIRS, None)
        self.spines: dict[int, tuple[Spine, Spine] | None] = {}

    def normalize(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merge(self, text: str) -> list[str]:
        """Merging by definition: join the best-scored neighbours, leftmost first, until none is a piece."""
        symbols = list(text)
        while True:
            best = None
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return symbols
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]

    def halves(self, i: int) -> tuple[str, str] | None:
        """What the last merge of a piece's own text joins; None for a character and for a piece that its text doesn't merge to."""
        symbols = list(self.pieces[i])
        while len(symbols) > 2:
            best = None
            for k in range(len(symbols) - 1):
                j = self.ids.get(symbols[k] + symbols[k + 1])
                if j is not None and (best is None or self.scores[j] > best[0]):
                    best = (self.scores[j], k)
            if best is None:
                return None
            k = best[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return (symbols[0], symbols[1]) if len(symbols) == 2 else None

    def spine(self, i: int) -> tuple[Spine, Spine] | None:
        """The symbols at a piece's left and right end while its text is merged, smallest first, each with the score of the merge that makes it.

        None if a merge does not score below those that made its halves: then the order of merges can't be told from scores alone.
        """
        if i in self.spines:
            return self.spines[i]
        made, score, out = self.halves(i), self.scores[i], None
        if made is None:
            out = (((self.pieces[i], score),),) * 2 if len(self.pieces[i]) == 1 else None
        else:
            sides = [self.ids.get(half) for half in made]
            below = [None if j is None else self.spine(j) for j in sides]
            if all(s is not None and (len(h) == 1 or self.scores[j] > score) for s, j, h in zip(below, sides, made, strict=True)):
                own = ((self.pieces[i], score),)
                out = (below[0][0] + own, below[1][1] + own)
        self.spines[i] = out
        return out

    def _fit(self, pair: int) -> bool:
        """Whether merging the text of two pieces gives just these two.

        While either side merges, only the symbols that meet between them could join. Both sides' symbols grow in the
        order of their merges' scores; the two are parted for good if no pair that meets has a better merge than the next one
        of either side. Of equal merges the leftmost is first: the left side's own, then the joining one, then the right's.
        """
        left, right = divmod(pair, self.n)
        a, b = self.spine(left), self.spine(right)
        if a is None or b is None:
            texts = [self.pieces[left], self.pieces[right]]
            return self.merge("".join(texts)) == texts
        (x, y), k, m = (a[1], b[0]), 0, 0
        while True:
            own = x[k + 1][1] if k + 1 < len(x) else -math.inf
            far = y[m + 1][1] if m + 1 < len(y) else -math.inf
            joined = self.ids.get(x[k][0] + y[m][0])
            if joined is not None and self.scores[joined] > own and self.scores[joined] >= far:
                return False
            if own == far == -math.inf:
                return True
            if own >= far:
                k += 1
            else:
                m += 1

    def fit(self, left: int, right: int) -> bool:
        return self.fits[left * self.n + right]

    def forget(self) -> None:
        """Give back what the caches hold: the worker outlives its task, and other stages run in it."""
        for cache in (self.kept, self.fits):
            cache.clear()
            cache.old = {}

    def _packed(self, cut: str) -> bytes:
        ids = self._fitted(cut) if self.kind == MERGES and self.single.issuperset(cut) else None
        return array("I", self._cut(cut) if ids is None else ids).tobytes()

    def _fitted(self, cut: str) -> list[int] | None:
        """One pass over a cut whose every character is a piece of a merge model: at each end the output links, longest first, until one fits."""
        last, size = [-1] * (len(cut) + 1), [0] * (len(cut) + 1)
        fits, n = self.fits, self.n
        for end, (i, long) in self.automaton.iter(cut):
            end += 1
            if size[end]:
                continue
            begin = end - long
            if begin:
                before = last[begin]
                if before < 0 or not fits[before * n + i]:
                    continue
            last[end], size[end] = i, long
        at = len(cut)
        if not size[at]:
            return None
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _cut(self, cut: str) -> list[int]:
        """One pass of the automaton over a cut; ids, with characters no piece has as bytes or unknown."""
        n = len(cut)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(cut):
            ends[end].append(found)
        last: list[int | None] = [None] * (n + 1)  # id of the piece that ends there; -1: a character no piece has
        start = [0] * (n + 1)
        best = [0.0] * (n + 1)
        merges = self.kind == MERGES
        for end in range(n):
            at = end + 1
            for i, size in ends[end]:
                begin = at - size
                if merges:
                    before = last[begin]
                    if begin and before is None:
                        continue
                    if not begin or before == -1 or self.fit(before, i):
                        last[at], start[at] = i, begin
                        break
                elif (not begin or last[begin] is not None) and (last[at] is None or best[begin] + self.scores[i] > best[at]):
                    last[at], start[at], best[at] = i, begin, best[begin] + self.scores[i]
            if last[at] is None and (not merges or cut[end] not in self.ids):
                last[at], start[at], best[at] = -1, end, best[end] + self.low
        if last[n] is None:  # a vocabulary whose merges have holes: merge by definition
            return [x for s in self.merge(cut) for x in self._ids(s)]
        out: list[list[int]] = []
        at = n
        while at:
            out.append([last[at]] if last[at] >= 0 else self._ids(cut[start[at] : at]))
            at = start[at]
        return [x for ids in reversed(out) for x in ids]

    def _ids(self, symbol: str) -> list[int]:
        if (i := self.ids.get(symbol)) is not None:
            return [i]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str | None) -> np.ndarray:
        cuts = self.cuts.findall(self.normalize(text or ""))
        ids = np.frombuffer(b"".join(map(self.kept.__getitem__, cuts)), "<u4")
        if not self.bytes and len(ids) > 1:  # neighbours that are unknown count as one
            ids = ids[~((ids == self.unknown) & np.concatenate(([False], ids[:-1] == self.unknown)))]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text of ids: byte pieces are joined into characters, control pieces are left out."""
        pieces, byte_of = self.pieces, self.byte_of
        out, pending = [], bytearray()
        if not byte_of or np.max(ids, initial=0) <= 2 or not np.isin(ids, self._byte_ids()).any():
            out = [pieces[i] for i in ids.tolist()]
        else:
            for i in ids.tolist():
                if (b := byte_of.get(i)) is not None:
                    pending.append(b)
                    continue
                if pending:
                    out.append(pending.decode("utf-8", "replace"))
                    pending.clear()
                out.append(pieces[i])
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _byte_ids(self) -> np.ndarray:
        return np.fromiter(self.byte_of, np.int64, len(self.byte_of))


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_crc32 and round_trip: decoding the ids gives the text."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for k, b in enumerate(batches, 1):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [own.encode(t) for t in texts]
            starts = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            same = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield batch(schema, b.column("doc_id"), np.diff(starts).astype(np.int64), lists, [zlib.crc32(i.tobytes()) for i in ids], same)
            if k % TRIM_EVERY == 0:
                give_back()
        own.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            yield batch(schema, b.column("doc_id"), [None if i is None else own.decode(np.array(i, np.int64)) for i in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
