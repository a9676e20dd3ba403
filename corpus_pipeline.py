"""From raw documents to tokens: each stage works on all that the one before it kept, and its decisions take effect.

1. quality: lines that fail a rule are removed, and documents that are rejected go;
2. near-duplicates: one document of each component of near copies stays, that with the smallest id. Copies are
   found in the cleaned texts, by five-word shingles, from a similarity of about 0.8;
3. personal data: every span is masked by its kind;
4. mixing: each document is repeated as often as its source's target takes it, in shuffled shards;
5. tokens: the ids of every row, with its other columns but the text.

Stages read only what they are given (``sf_dir`` is for stages that need another table; none does). Run by ``run``, a
stage's rows are written as Parquet in the shared folder and read again, so that a lost executor costs no more than the
stage it works on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, common, mix, pii, quality, simhash


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality.keep_clean(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled shards."""
    return mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of what they decode to."""
    return bpe.tokenise(docs)


STAGES = [
    ("quality", clean),
    ("near_duplicates", dedup),
    ("pii", private),
    ("mix", mixed),
    ("bpe", tokens),
]

#: SQL can't state line rules, near copies, the semi-Markov field or merges; the tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
