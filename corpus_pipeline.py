"""From raw documents to packed training sequences: each stage is one operator, written and read again as Parquet.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the rows that go on. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm import block_naming, odd_sketches, packing, quality, sentence_spans
from tsforge.llm.common import stored, table, unused

def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id."""
    return block_naming.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest doc_id."""
    return odd_sketches.keep_one(docs, k=5, threshold=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occurred before; documents of which nothing is left go. n_chars follows the text."""
    removed = unused(docs, "_n_removed")
    left = sentence_spans.cleaned(docs, removed=removed, where=unused(docs, "_removed_bytes"))
    changed = F.col(removed) > 0
    left = left.filter(~changed | (F.length(F.trim("text")) > 0))
    kind = dict(docs.dtypes).get("n_chars")
    if kind:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their place in the packed sequences."""
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json")).withColumn("length", F.col("length").cast("long"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packed),
]

#: A fitted classifier and a tokenizer have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
