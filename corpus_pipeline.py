"""From raw documents to token ids: five stages, each one operator of the llm package.

Every stage takes what the one before it kept, written as Parquet and read again, and its decisions take effect: texts
far from every language go, of equal texts one stays, of near-equal texts one stays, the mix repeats and shortens
documents until each source has its share, and what is left becomes ids.

Empty tables, null and repeated rows go through as each operator defines. SQL expresses neither the near-dedup nor
the language model, so there is no ORACLE_SQL; tests/llm holds the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.llm import bpe, exact_dedup, language_id, mixing, simhash
from glosswright.llm.common import documents, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a language's centroid; those without a letter go."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of at least 0.8 on 5-word shingles the one with the smallest id: SimHash
    gives the candidates, to which MinHash adds what 3 of 64 bits cannot tell, and all are decided exactly."""
    return simhash.keep_one(docs, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole turn that the mix takes of a document, and its first words for the rest."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of what they decode to."""
    d = bpe.encode_documents(docs, decoded=True)
    return d.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), after=path)
    return STAGES[-1][1](spark, docs, sf_dir)
