"""Which texts of a group contain which patterns, anywhere, longer words included.

The patterns of a group make an automaton that reads each text once, however many they are. Neither a group's texts nor its
patterns stand in one task: texts are dealt to slices of some CHARS characters, patterns to packs of some PATTERNS, and each
slice meets each pack of its group.
"""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import settle

#: Patterns of one automaton, some hundred bytes each; characters of the texts that are read with it in one go.
PATTERNS = 20_000
CHARS = 16 << 20
#: Groups up to which their numbers of slices and packs are broadcast.
GROUPS = 10_000


def met(keys: tuple, texts: pa.Table, patterns: pa.Table) -> pa.Table:
    """_g, _k and _p for each of the patterns (_p, compared as _f) that a text (_g, _k, _t) contains."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for n, f in enumerate(patterns.column("_f").to_pylist()):
        of.setdefault(f, []).append(n)
    automaton = ahocorasick.Automaton()
    for f in of:
        automaton.add_word(f, f)
    automaton.make_automaton()
    # A hit is two numbers: neither texts nor patterns are copied for it, and texts are decoded one by one.
    at, found = array("q"), array("q")
    if of:
        for k, t in enumerate(texts.column("_t")):
            for f in {f for _, f in automaton.iter(t.as_py())}:
                found.extend(of[f])
                at.extend([k] * len(of[f]))
    rows = texts.select(["_g", "_k"]).take(np.frombuffer(at, np.int64))
    return pa.table({"_g": rows.column("_g"), "_k": rows.column("_k"), "_p": patterns.column("_p").take(np.frombuffer(found, np.int64))})


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, group: str = "analysis_id", ignore_case: bool = False, most: int = PATTERNS, chars: int = CHARS) -> DataFrame:
    """group, key and pattern, once for each text that contains a pattern of its group.

    key: a column of texts; rows with one key count as one. Null texts and null or empty patterns match nothing, null groups neither. With ignore_case
    both are compared in lower case, and the pattern is returned as it is given.
    """
    fold: Column = F.lower(pattern) if ignore_case else F.col(pattern)
    known = patterns.where(F.col(group).isNotNull() & (F.col(pattern) != "")).select(F.col(group).alias("_g"), F.col(pattern).alias("_p"), fold.alias("_f")).distinct()
    read = texts.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_k"), (F.lower(text) if ignore_case else F.col(text)).alias("_t"))
    packs = known.groupBy("_g").agg(F.ceil(F.count("*") / most).cast("int").alias("_packs"))
    sizes = read.groupBy("_g").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("_t")) / chars)).cast("int").alias("_slices")).join(packs, "_g")
    sizes = settle(sizes, "mention-sizes")  # a row a group; few are broadcast, so that the texts of a group aren't dealt to one task
    sizes = F.broadcast(sizes) if sizes.limit(GROUPS + 1).count() <= GROUPS else sizes
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = read.join(sizes, "_g").select("_g", own("_k", "_slices").alias("_slice"), every("_packs").alias("_pack"), "_k", "_t")
    right = known.join(sizes, "_g").select("_g", every("_slices").alias("_slice"), own("_f", "_packs").alias("_pack"), "_p", "_f")
    types = dict(read.dtypes)
    by = ("_g", "_slice", "_pack")
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(met, f"_g {types['_g']}, _k {types['_k']}, _p string").distinct()
    return hits.select(F.col("_g").alias(group), F.col("_k").alias(key), F.col("_p").alias(pattern))


def mentioned(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, forms: dict[str, Column], group: str = "analysis_id", ignore_case: bool = False) -> DataFrame:
    """group, key, name and form, once for each text that contains a form of a name (such as the name, its interface, or its opening tag)."""
    spread = names.select(group, name, F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("_form")) for k, v in forms.items()))).alias("_x")).select(group, name, "_x.form", "_x._form").where("_form <> ''").distinct()
    hits = containing(texts, key, text, spread.select(group, "_form"), "_form", group, ignore_case)
    on = reduce(lambda a, b: a & b, (hits[c] == spread[c] for c in (group, "_form")))
    return hits.join(spread, on).select(hits[group], key, name, "form").distinct()
