"""A training-text pipeline over ``documents``: each stage works on all that the one before it kept.

Stages: documents scored as toxic go; later copies of repeated runs of lines go; of near duplicates the one with the smallest
doc_id stays; documents that hold a benchmark item go; what is left is encoded. All but the last keep the columns
of ``documents`` (n_chars follows the text).

Defined results: null and empty texts pass every filter (they score as the model's bias, hold no lines, have no n-grams and no benchmark items)
and encode to no ids; rows with a null doc_id are kept by all stages. Rows alike in doc_id and text stand and fall together. An empty
table gives an empty result; without usable labels nothing is toxic, without benchmark items nothing leaks. Further columns, whatever
their names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from granary.llm.scratch import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels of the table; a document goes if it scores 0.5 or more."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, their number, and digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), *bpe.public_vocabulary(), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_near_duplicates),
    ("decontamination", drop_leaked),
    ("byte_bpe", encode),
]

#: SQL cannot express the trained score, the signatures or the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
