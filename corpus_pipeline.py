"""A training corpus from ``documents``: five stages, each written and read again.

Nulls and odd rows: a null text counts as empty and stays as long as the stages keep its group; a null doc_id stays
only where no row with an id stands for the same text or component; of repeated rows one stays; a null source is a
source of its own; an empty table gives an empty result; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, exact_dedup, mixing, simhash, toxicity
from llm.common import crc_mod, prepare, read_table, stage
from llm.queries import vocabulary_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model is learnt from the labelled rows of the tables, as in op10."""
    prepare(spark)
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), crc_mod(3) != 1)
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    prepare(spark)
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the document with the smallest doc_id stays."""
    prepare(spark)
    return simhash.thin_out(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every row of the mix."""
    prepare(spark)
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: A learnt model and a tokenizer can't be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
