"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import decontamination
from . import html_extraction as html
from . import importance_resampling, mixing, ngram_join, pieces, quality_classifier, quality_rules, substring_dedup, token_codes, tokenizer_alignment, toxicity, warc
from .common import table, tokenizer_path


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _with_labels(operator):
    return lambda s, d: operator(_docs(s, d), table(s, d, "labels"))


QUERIES = {
    "op1_html_extraction": lambda s, d: html.html_extraction(table(s, d, "pages")),
    "op2_token_codes": lambda s, d: token_codes.token_codes(_docs(s, d), tokenizer_path("word_bpe_49k.json")),
    "op3_quality_rules": lambda s, d: quality_rules.quality_rules(_docs(s, d)),
    "op4_decontamination": lambda s, d: decontamination.decontamination(_docs(s, d), table(s, d, "benchmark")),
    "op5_quality_classifier": _with_labels(quality_classifier.quality_classifier),
    "op6_sentencepiece": lambda s, d: pieces.encode_pieces(_docs(s, d), tokenizer_path("piece_bpe_32k.model")),
    "op7_ngram_join": lambda s, d: ngram_join.ngram_join(_docs(s, d)),
    "op8_toxicity": _with_labels(toxicity.toxicity),
    "op9_warc": lambda s, d: warc.warc(table(s, d, "pages")),
    "op10_substring_dedup": lambda s, d: substring_dedup.substring_dedup(_docs(s, d)),
    "op11_importance_resampling": lambda s, d: importance_resampling.importance_resampling(_docs(s, d), table(s, d, "benchmark")),
    "op12_mixing": lambda s, d: mixing.mixture(_docs(s, d)),
    "op13_tokenizer_alignment": lambda s, d: tokenizer_alignment.tokenizer_alignment(_docs(s, d), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")),
}

ORACLE_SQL = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_importance_resampling": importance_resampling.ORACLE_SQL,
    "op12_mixing": mixing.ORACLE_SQL,
}
