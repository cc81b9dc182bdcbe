"""The nearest vectors of a block for each query of a block, by matrix products, with the distances that cosine_distance gives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and vectors of one product; by how much a product may differ from the sum in order; hits that are held before they are ranked.
QUERIES, ROWS, SLACK, HITS = 512, 4096, 1e-9, 1 << 20


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them have a null within."""
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) > 1 or (sizes and not sizes[0]):
        raise ValueError("vectors must be of one length and not empty")
    flat = pc.list_flatten(column)
    values = flat.to_numpy().astype(np.float64).reshape(len(column), -1)
    return values, pc.is_null(flat).to_numpy().reshape(values.shape).any(1) if flat.null_count else np.zeros(len(values), bool)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products row by row, in the order of the values."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As cosine_distance: 1 if either is zero, and a quotient that is no number counts as greatest."""
    with np.errstate(all="ignore"):
        size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
        value = dot(a, b) / size
    value = np.where(np.isnan(value), 1.0, np.minimum(np.maximum(value, -1.0), 1.0))
    return np.where(size == 0, 1.0, 1 - value)


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length, zeros as they are; which of them a product can't be trusted for."""
    with np.errstate(all="ignore"):
        length = np.sqrt(np.einsum("ij,ij->i", a, a))
        odd = ~((length > 1e-100) & (length < 1e100)) & a.any(1)
        unit = a / np.where(odd | (length == 0), 1.0, length)[:, None]
    unit[odd] = 0
    return unit, odd


def nearest(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], ids: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and distances of the k nearest of each query, ties by id; 2, the greatest, where either has a null within.

    Products tell which vectors can be among the k nearest; the distances of these are summed in order.
    """
    (queries, queries_lack), (vectors, vectors_lack) = asked, held
    none = np.empty(0, np.int64)
    if not len(queries) or not len(vectors):
        return none, none, np.empty(0)
    if queries.shape[1] != vectors.shape[1]:
        raise ValueError("vectors must be of one length and not empty")
    (units, odd_queries), (rows, odd_rows) = _scaled(queries), _scaled(vectors)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, len(queries), QUERIES):
        asked, odd = units[first : first + QUERIES], odd_queries[first : first + QUERIES, None]
        least = np.full(len(asked), -np.inf)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        best = (none, none, np.empty(0))

        def ranked(best: tuple, held: list) -> tuple:
            q, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            parts = [cosine(queries[q[s : s + HITS // 8]], vectors[x[s : s + HITS // 8]]) for s in range(0, len(q), HITS // 8)]
            d = np.where(queries_lack[q] | vectors_lack[x], 2.0, np.concatenate(parts)) if parts else np.empty(0)
            q, x, d = np.concatenate((best[0], q)), np.concatenate((best[1], x)), np.concatenate((best[2], d))
            table = pa.table({"q": q, "d": d, "i": ids.take(x)})
            order = pc.sort_indices(table, [("q", "ascending"), ("d", "ascending"), ("i", "ascending")], null_placement="at_start").to_numpy()
            q, x, d = q[order], x[order], d[order]
            begins = np.flatnonzero(np.concatenate((q[:1] == q[:1], q[1:] != q[:-1])))
            kept = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q)))) < k
            return q[kept], x[kept], d[kept]

        for begin in range(0, len(rows), ROWS):
            product = asked @ rows[begin : begin + ROWS].T
            can = product >= least[:, None] - SLACK
            many = np.flatnonzero(can.sum(1) > k)
            if len(many):
                sure = np.where(odd_rows[begin : begin + ROWS], -np.inf, product[many])
                least[many] = np.maximum(least[many], np.partition(sure, -k, axis=1)[:, -k])
                can[many] = product[many] >= least[many, None] - SLACK
            q, x = np.nonzero(can | odd | odd_rows[begin : begin + ROWS])
            held.append((q + first, x + begin))
            if sum(len(h[0]) for h in held) >= HITS:
                best, held = ranked(best, held), []
        out.append(ranked(best, held) if held else best)
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))
