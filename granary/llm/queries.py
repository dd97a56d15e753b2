"""The numbered queries: thin digests of this subpackage's operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, digests, importance, lexical, line_dedup, ngram_join, pii, repeats, sentence_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard": _over(ngram_join.op1_ngram_jaccard, "documents"),
        "op2_byte_bpe": _over(bpe.op2_byte_bpe, "documents"),
        "op3_nn_descent": _over(ann.op3_nn_descent, "embeddings"),
        "op4_suffix_array": _over(repeats.op4_suffix_array, "documents"),
        "op5_url_filter": _over(url_filter.op5_url_filter, "pages"),
        "op6_decontamination": _over(decontam.op6_decontamination, "documents", "benchmark"),
        "op7_pii": _over(pii.op7_pii, "documents"),
        "op8_line_dedup": _over(line_dedup.op8_line_dedup, "documents"),
        "op9_toxicity": _over(toxicity.op9_toxicity, "documents", "labels"),
        "op10_sentence_spans": _over(sentence_dedup.op10_sentence_spans, "documents"),
        "op11_improbable_digest": _over(digests.op11_improbable_digest, "documents"),
        "op12_importance": _over(importance.op12_importance, "documents", "benchmark"),
        "op13_lexical": _over(lexical.op13_lexical, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_join.ORACLE, "op4_suffix_array": repeats.ORACLE, "op5_url_filter": url_filter.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op10_sentence_spans": sentence_dedup.ORACLE, "op12_importance": importance.ORACLE, "op13_lexical": lexical.ORACLE}
