"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of ``documents``; ``n_chars`` follows the text. ORACLE_SQL is None, since neither a trained score nor
BPE can be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import op02_toxicity, op04_lines, op05_bpe, op07_mix, op08_minhash
from plumbline.llm.common import cut_lineage, lookup_join, table, word_count

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, does not reject at its own threshold."""
    model = op02_toxicity.learn(docs, op02_toxicity.training_labels(table(spark, sf_dir, "labels")))
    return op02_toxicity.reject(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals. A document goes if it loses all its words."""
    done = op04_lines.dedup_lines(docs, counts=("__lines", "__exact", "__near"))
    stays = (word_count(F.col("text")) > 0) | (F.col("__exact") + F.col("__near") == 0)
    kept = done.filter(stays).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (shingles of five words, similarity 0.8)."""
    gone = cut_lineage(op08_minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct())
    return lookup_join(docs, gone, "doc_id", "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it. Rows are numbered first, so rows without an id or of one id are told apart."""
    numbered = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    taken = op07_mix.mix(numbered, row_col="__row").select("__row", F.col("copies").cast("int").alias("__copies"))
    joined = lookup_join(numbered, cut_lineage(taken.filter("copies > 0")), "__row", "inner")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row."""
    return op05_bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
