"""Deterministic ids: the first 16 bytes of SHA-256 of a key, written as a GUID (first three groups little-endian)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guid(key: Column) -> Column:
    h = F.sha2(key, 256)
    cut = lambda *starts: F.concat(*(F.substring(h, s, 2) for s in starts))
    return F.concat_ws("-", cut(7, 5, 3, 1), cut(11, 9), cut(15, 13), F.substring(h, 17, 4), F.substring(h, 21, 12))


def key(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def evidence_key(path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("ev:"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def evidence_id(job: Column, path: Column, start: Column, end: Column, kind: Column, symbol: Column) -> Column:
    """Needs a job id: without one the id is null rather than random, so that reruns agree."""
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(F.length(job) > 0, guid(key("evidence", job, path, span, kind, F.coalesce(symbol, F.lit("")))))
