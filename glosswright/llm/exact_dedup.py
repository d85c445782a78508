"""Exact dedup by skew-safe combining: local dedup, merged salted digest groups, then salt winners combined globally.

Every grouping key holds the whole normalised text next to its digest, so two texts are only ever called equal after
their full content was compared, at each of the three stages:

1. each task combines the equal texts it reads before anything is shuffled (map-side aggregation);
2. what is left meets by (digest, salt, text): a group of copies is spread over `salts` tasks;
3. the salt winners, at most `salts` rows a text, meet by digest.

Documents then find their winner by digest, the hot groups through a bounded broadcast (see common.join_hot). Should
two different texts ever share a digest, their documents find the winner by (digest, text) instead.

Cases: a null text equals an empty one; texts of white space only equal each other; rows that repeat the winner's id
and text are all kept, as the id cannot tell them apart; a null id is larger than any other (it wins only in a group
without ids); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, join_hot, text_of


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def normalised(column: str) -> Column:
    return F.regexp_replace(text_of(column), f"{SPACE}+", " ")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))
    members = cut(rows.select("doc_id", "digest"))
    # one salt a task: a task sends one row for all its copies of a text, and a text meets in `salts` tasks
    local = rows.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = local.repartition("digest").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = texts.groupBy("digest").agg(F.count("*").alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = cut(by_digest)
    total = members.count()
    single = classes.filter("n_texts = 1").drop("n_texts")
    found = join_hot(members, single, "digest", "group_size", total)
    shared = classes.filter("n_texts > 1").select("digest")
    if not shared.isEmpty():
        by_text = texts.join(shared, "digest", "left_semi")
        clash = rows.join(shared, "digest", "left_semi").join(by_text, ["digest", "norm"]).select("digest", "doc_id", "keep_id", "group_size")
        found = found.unionByName(clash)
    return found.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns, repeated rows once."""
    from pyspark.sql import Window as W

    winners = cut(exact_dedup(df, text_col, id_col).filter("kept").select("doc_id", "digest"))
    kept = cut(winners.distinct())
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), sha256(normalised(text_col)).alias("row_digest"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_digest") == F.col("digest")), "left_semi")
    if winners.count() == kept.count():  # no row repeats a winner, so the texts need no second shuffle
        return rows.select("row.*")
    w = W.partitionBy("id", "row_digest").orderBy(F.lit(0))
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
"""
