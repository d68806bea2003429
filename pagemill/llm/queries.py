"""Queries opN_<name> of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import mixing, topk
from pagemill.llm.common import table

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key_for_checks(spark: SparkSession) -> str:
    """The session's key; else a published one, fit for synthetic tables only: the operator itself has no default."""
    from pagemill.llm import pii

    return spark.conf.get(pii.CONF, "published key for synthetic tables")


def op8_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import dac

    return dac.roundtrip(table(spark, sf_dir, "documents"), WORDS)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import divergence

    return divergence.quality(table(spark, sf_dir, "documents"))


def op2_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import langid

    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_ordinal_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import ordinal

    return ordinal.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weighted_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import transducer

    return transducer.encoded(table(spark, sf_dir, "documents"), PIECES)


def op5_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import suffix

    return suffix.score(table(spark, sf_dir, "documents"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.llm import pii

    return pii.pseudonymised(table(spark, sf_dir, "documents"), key_for_checks(spark))


def op1_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_raked_mixture": op1_raked_mixture,
    "op2_hierarchical_svm": op2_hierarchical_svm,
    "op3_feistel_pseudonyms": op3_feistel_pseudonyms,
    "op4_distribution_divergence": op4_distribution_divergence,
    "op9_weighted_transducer": op9_weighted_transducer,
    "op10_ordinal_regression": op10_ordinal_regression,
    "op5_block_pruned_top_k": op5_block_pruned_top_k,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_simhash": op7_simhash,
    "op8_directly_addressable_codes": op8_directly_addressable_codes,
}

ORACLES: dict[str, str] = {
    "op1_raked_mixture": mixing.ORACLE,
    "op5_block_pruned_top_k": topk.ORACLE,
}
