"""Corpus pipeline over ``documents``: what each stage keeps is the next one's input.

1. toxicity: rows whose whole text scores as toxic go.
2. n-gram Jaccard join: of each group of near-duplicates (five-word shingles, similarity 0.8 and more) the document with
   the smallest id stays; documents without words have no duplicates and stay.
3. benchmark decontamination: documents in which a test item leaks go.
4. secret scans: secret values are masked in the text, n_chars follows.
5. byte-level BPE: token counts and digests of ids and decoded bytes.

Stages 1 to 4 return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoloom.llm import byte_bpe, decontamination, jaccard_join, secrets, toxicity
from isoloom.llm.common import read_table, written
from isoloom.llm.queries import RANKS

#: Near-duplicates share this many per cent of their shingles of this many words.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(toxicity.sample_labelled(docs, read_table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, size=WORDS, percent=PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked_texts(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: No stage but the last can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result but the last is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
