"""A corpus from raw documents to packed sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseweave.llm import exact_dedup, mixing, near_copies as near, packing, quality_rules
from pulseweave.llm.common import materialise, read


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules themselves nor come from a host that does."""
    return quality_rules.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the largest identifier."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest identifier. Candidates are SimHash fingerprints within the radius of the pigeonhole search and sets that share minima; those with a Jaccard similarity of five-word shingles of 0.8 or more are linked."""
    return near.drop_near_copies(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source near its target; a document that the mix takes twice is there twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing", mixing_sources),
    ("best-fit packing", packed),
]

#: Shingle sets, components, token ids and best-fit packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
