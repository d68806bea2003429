"""A training corpus from ``documents``: quality rules, near-dedup, pseudonyms, mixing, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written and read again before the next stage. All but the last
return the columns of ``docs``.

Null and empty texts fail the quality rules and go. Repeated rows, and copies of a text,
leave one row; texts of one doc_id that are no copies all stay. Rows without a doc_id
are no one's copies and stay; the sample takes them or leaves them together. Very long
texts are read whole by every stage. Ties go to the smaller doc_id. Empty tables pass through all stages as
such. Columns beyond those of documents are carried, whatever their names, up to the
last stage, which returns doc_id, n_ids, ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import divergence, mixing, pii, simhash, transducer
from pagemill.llm.common import table, written
from pagemill.llm.queries import PIECES, key_for_checks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.in_place(docs, key_for_checks(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return transducer.encoded(docs, PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("mix", mix),
    ("encode", encode),
]

#: Fingerprints, permutations and transducers are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
