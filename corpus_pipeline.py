"""A training corpus from the documents table, in stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each
stage's rows as a table in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspark.llm.common import documents, small_batches, written
from wattspark.llm.exact_dedup import keep_unique
from wattspark.llm.jaccard_join import one_of_each
from wattspark.llm.language_id import fit_dictionaries, identify
from wattspark.llm.mixing import mixed_documents
from wattspark.llm.sentence_pieces import encode

#: Of the documents that the language stage sees; all but the last stage keep them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: without a letter, or as near to two languages."""
    small_batches(spark)
    dictionaries, counts = fit_dictionaries(docs)
    return identify(docs, dictionaries, counts).filter(~F.col("rejected")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles, three quarters in common."""
    small_batches(spark)
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated or left out, that bring each source near its target."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document of the mixture."""
    small_batches(spark)
    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("pieces", pieces)]

#: Compression, seeded hashes and piece lattices have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
