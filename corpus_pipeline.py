"""From raw documents to token ids in training order, stage by stage.

Each stage takes documents with whatever columns they have (columns whose names an operator uses itself come through
unchanged) and any rows: null ids, texts, languages or sources, repeated rows, ids shared by different texts, very long
texts, empty tables.

Defined results: a row without text, or without letters in it, is rejected by language_id; a document is known by doc_id
and text, so near_duplicates keeps different texts that share an id (or have none), and of rows alike in both one;
decontamination decides by a row's own text, so equal rows go or stay together; mixing repeats rows, ties in its order are
taken alike; token_ids gives every row that reaches it its sequences, a null doc_id included. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanquarry.llm import decontam, langid, mixing, simhash, tokens
from spanquarry.llm.common import read, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; what the models reject goes."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang")
    return langid.identified(rows).where("not lang_rejected").select("doc.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, each sequence at its slot."""
    return tokens.training_order(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_ids", in_training_order),
]

#: Language models, fingerprints' components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
