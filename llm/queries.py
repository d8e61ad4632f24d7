"""Registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, exact_dedup, html_text, kneser_ney, merkle, mixing, quality, sentence_pieces, simhash, suffix_dedup, top_k, toxicity, turn_trie
from llm.common import crc_mod, read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def vocabulary_path() -> str:
    """The tokenizer file; TOKENIZER_FILE names another one."""
    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def model_path() -> str:
    """The merge-type model; PIECE_MODEL_FILE names another one."""
    return os.environ.get("PIECE_MODEL_FILE") or public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(documents(spark, sf_dir)).drop("spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.marked(documents(spark, sf_dir))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), crc_mod(5) == 0
    network = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return quality.scores(docs, network).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary_path())


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(read_table(spark, sf_dir, "embeddings"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.split_scores(documents(spark, sf_dir), crc_mod(7) == 2, kneser_ney.ORDER)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), crc_mod(3) == 1
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.nodes_of(read_table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(documents(spark, sf_dir), model_path())


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html": op4_html,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_top_k": op7_top_k,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_turn_trie": op11_turn_trie,
    "op12_merkle": op12_merkle,
    "op13_sentence_pieces": op13_sentence_pieces,
}

SQL = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op2_mixing": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_top_k": top_k.SQL,
    "op11_turn_trie": turn_trie.SQL,
    "op12_merkle": merkle.SQL,
}
