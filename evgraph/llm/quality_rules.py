"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over the whole text, so the operator is
a scan, one projection and nothing else: no exchange, no user function.

Defined results: a null or empty text has no words, all counts 0, base_failed
true and kept false. Rows are never merged: repeated rows give repeated results.
Other columns of the input are left out of the result, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by from or an "
    "der die und das in den von zu mit ist des im nicht ein eine als auch auf für dem "
    "le la les de des et un une du que qui dans est pour par sur pas avec au elle "
    "el los las y en que del se por con una para al no es su lo como"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A row is kept where low <= measure <= high."""

    measure: str
    low: float
    high: float


#: The table of the method's verdict; all ratios are over words, or lines with a word.
RULES = (
    Rule("mean_word_chars", 1.5, 14.0),
    Rule("symbol_ratio", 0.0, 0.3),
    Rule("stop_ratio", 0.02, 1.0),
    Rule("dup_line_ratio", 0.0, 0.5),
    Rule("loud_ratio", 0.0, 0.4),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _repeat_words(words: Column) -> Column:
    """Words inside windows of 8 words that the text has twice or more.

    Window keys are 64-bit hashes, doubled in width three times (1, 2, 4, 8 words).
    Only texts with an equal pair of keys go on to the sorted list of (key, position).
    """

    def widen(keys: Column, by: int) -> Column:
        kept = F.greatest(F.size(keys) - by, F.lit(0))
        return F.zip_with(F.slice(keys, 1, kept), F.slice(keys, by + 1, kept), lambda a, b: F.xxhash64(a, b))

    def windows(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(widen(one, 1), lambda two: let(widen(two, 2), lambda four: widen(four, 4))))

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return let(ranked, lambda r: let(F.sort_array(F.filter(twice(r), lambda i: i.isNotNull())), union_length))

    def twice(ranked: Column) -> Column:
        size = F.size(ranked)
        nothing = F.array(F.lit(None).cast("struct<k: bigint, i: int>"))
        after_first = F.zip_with(
            ranked,
            F.concat(nothing, F.slice(ranked, 1, size - 1)),
            lambda x, y: F.struct(x["k"].alias("k"), x["i"].alias("i"), F.coalesce(x["k"] == y["k"], F.lit(False)).alias("same")),
        )
        return F.zip_with(after_first, F.concat(F.slice(ranked, 2, size - 1), nothing), lambda x, y: F.when(x["same"] | F.coalesce(x["k"] == y["k"], F.lit(False)), x["i"]))

    def union_length(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda s, g: s + g))

    repeats = let(windows(words), lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, repeats).otherwise(F.lit(0)).cast("long")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rule measures."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    out = docs.withColumn("_words", words).withColumn("_lines", lines)
    stop = sorted(set(STOP_WORDS))
    n = F.size("_words").cast("long")
    return out.select(
        *docs.columns,
        n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))).cast("long").alias("_n_stop"),
        F.regexp_count(whole, F.lit(r"!!(?=[\x20\x09-\x0D,.]|$)")).cast("long").alias("_n_loud"),
    )


def apply_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Compile the table: one boolean column base_failed and one kept."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    of = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("_n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "loud_ratio": F.col("_n_loud") / n,
    }
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & of[rule.measure].between(rule.low, rule.high)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return apply_rules(measure(docs.select("doc_id", "text")), rules).select("doc_id", *counts, "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
k AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS key FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS n FROM k),
g AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM c WHERE n >= 2),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat FROM g GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
      len(list_filter(words, lambda x: list_contains([STOP], lower(x)))) AS n_stop,
      len(regexp_extract_all(t || ' ', '!![\x20\x09-\x0D,.]')) AS n_loud
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n BETWEEN 1.5 AND 14 AND n_symbols / n BETWEEN 0 AND 0.3 AND n_stop / n BETWEEN 0.02 AND 1
       AND n_dup_lines / greatest(n_lines, 1) BETWEEN 0 AND 0.5 AND n_loud / n BETWEEN 0 AND 0.4 AS kept
FROM b
""".replace("STOP", ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS))))
