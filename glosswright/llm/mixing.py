"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of equal size. The highest quotients w / (2k - 1) first give every source an integer number
of blocks, then every shard of a source (about `shard_rows` documents of it, picked by a seeded hash). In a shard the
documents stand in a seeded order; its quota of blocks is the head of that stream of words, begun again when it ends.

No key gets into one task whole: a source is cut into shards before any window, and only a row per source (for the
code-point order, the water level and the quotas) or per shard is ever ranked together.

Cases: a null text has size 0; null is a source of its own, last in order; repeated rows and ids are mixed as rows of
their own; a source without words has target 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, join_hot, n_words

#: Up to so many rows of the source table (a name and five numbers each) are broadcast.
BROADCAST_SOURCES = 50_000


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """parties and `out`: the seats that go to each party of a group by the highest quotients weight / (2k - 1).

    With the divisor W / N rounding alone misses the N seats by half the number of parties at most. The seats by which
    it misses are the best (or worst) of a few quotients next to each party's rounded number: how many follows from the
    party's share, about 3.5 quotients a party in all, so nothing is enumerated seat by seat."""
    g = W.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(weight).over(g)).withColumn("_share", F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(0.0))
    p = p.withColumn("_base", F.floor(F.col("_share") * F.col(seats) + 0.5))
    p = p.withColumn("_off", F.when(F.col("_all") > 0, F.sum("_base").over(g) - F.col(seats)).otherwise(0)).withColumn("_n", F.count("*").over(g))
    near = (F.ceil(F.col("_share") * F.col("_n") * 1.5) + 2).cast("long")
    base, off = F.col("_base").cast("long"), F.col("_off")
    ks = F.when(off > 0, F.sequence(F.greatest(F.lit(1), base - near + 1), base)).otherwise(F.sequence(base + 1, base + near))
    q = p.filter((off != 0) & (F.col(weight) > 0) & ((off < 0) | (base > 0))).select(*group, *key, weight, "_off", F.explode(ks).alias("_k"))
    q = q.withColumn("_q", F.col(weight) / (2 * F.col("_k") - 1))
    best = [F.when(F.col("_off") < 0, -F.col("_q")).otherwise(F.col("_q")), *[F.col(k) for k in key], F.col("_k")]
    q = q.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*best))).filter("_r <= abs(_off)")
    moved = q.groupBy(*group, *key).agg(F.count("*").alias("_moved"))
    got = p.join(moved, [*group, *key], "left")
    move = F.coalesce("_moved", F.lit(0)) * F.when(off > 0, -1).otherwise(1)
    return got.withColumn(out, (base + move).cast("long")).drop("_all", "_share", "_base", "_off", "_n", "_moved")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source (columns nosrc, src): n_docs, source_size, target.

    The targets are min(most * size, level * weight); the water level is found where the sources that it caps, in
    order of cap to weight, leave the rest of the words to the others."""
    s = sizes.groupBy("nosrc", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy("nosrc", "src")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "nosrc", "src")
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("level_here", (F.sum("source_size").over(W.partitionBy()) * share - F.col("capped")) / F.col("left_w"))
    ok = F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))
    s = s.withColumn("level", F.min(ok).over(W.partitionBy())["level_here"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    return s.select("nosrc", "src", "n_docs", "source_size", target.alias("target"))


def _source(source_col: str) -> list[Column]:
    return [F.col(source_col).isNull().alias("nosrc"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")]


def mix_sources(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 17, block_words: int = 16, shard_rows: int = 1000, most: int = 2
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    return mix_rows(df, text_col, id_col, source_col, seed, block_words, shard_rows, most).drop("nosrc", "src")


def mix_rows(df: DataFrame, text_col: str, id_col: str, source_col: str, seed: int = 17, block_words: int = 16, shard_rows: int = 1000, most: int = 2) -> DataFrame:
    """mix_sources with the source, as columns nosrc and src."""
    sizes = cut(df.select(F.col(id_col).alias("doc_id"), *_source(source_col), F.coalesce(n_words(F.col(text_col)), F.lit(0).cast("long")).alias("size")))
    sources = targets(sizes, most=float(most))
    whole = F.round(F.sum("target").over(W.partitionBy()) / block_words).cast("long")
    sources = sources.withColumn("g", F.lit(0)).withColumn("blocks", whole)
    sources = sainte_lague(sources, ["g"], ["nosrc", "src"], "target", "blocks", "quota")
    sources = cut(sources.select("nosrc", "src", "source_size", "target", "quota", F.ceil(F.col("n_docs") / shard_rows).cast("long").alias("n_shards"), "n_docs"))
    if sources.count() <= BROADCAST_SOURCES:
        d = sizes.join(F.broadcast(sources), ["nosrc", "src"]).drop("n_docs")
    else:  # sources with a large share of all rows are broadcast, so none is one task's work
        key = F.struct("nosrc", "src")
        one = sources.select(key.alias("at"), *[c for c in sources.columns if c not in ("nosrc", "src")])
        d = join_hot(sizes.select(key.alias("at"), "doc_id", "size"), one, "at", "n_docs", sizes.count()).select("at.*", "*").drop("at", "n_docs")
    place = F.xxhash64("doc_id", F.lit(seed))
    d = d.withColumn("place", place).withColumn("shard", F.pmod(F.xxhash64("place"), F.col("n_shards")))
    d = cut(d.drop("n_shards"))
    shards = d.groupBy("nosrc", "src", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = sainte_lague(shards, ["nosrc", "src"], ["shard"], "shard_size", "quota", "shard_quota")
    d = d.drop("quota").join(shards.select("nosrc", "src", "shard", "shard_size", "shard_quota"), ["nosrc", "src", "shard"])
    words = F.least(F.col("shard_quota") * block_words, F.col("shard_size") * most)
    turns = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0)
    d = d.withColumn("words", words).withColumn("turns", turns)
    stream = W.partitionBy("nosrc", "src", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.sum("size").over(stream) - F.col("size")
    rest = F.col("words") - F.col("turns") * F.col("shard_size") - before
    taken = F.col("turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return d.select("nosrc", "src", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("turns").cast("int").alias("turns"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it was."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), n.cast("int")), "")


def mixed_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of df: a row for each whole turn of a document, and its head for the rest."""
    mix = mix_rows(df, text_col, id_col, source_col).filter("size > 0")
    mix = mix.select(*[F.col(c).alias(f"mix_{c}") for c in ("doc_id", "nosrc", "src", "size", "taken")])
    # rows of one id, source and size are paired off one by one; all are numbered, also those of which nothing is taken
    nth = lambda by, *order: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    mix = mix.withColumn("mix_n", nth(["mix_doc_id", "mix_nosrc", "mix_src", "mix_size"], F.desc("mix_taken"))).filter("mix_taken > 0")
    nosrc, src = _source(source_col)
    text = F.col("row")[text_col]
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), nosrc.alias("nosrc"), src.alias("src"), F.coalesce(n_words(F.col(text_col)), F.lit(0).cast("long")).alias("words")).filter("words > 0")
    rows = rows.withColumn("n", nth(["id", "nosrc", "src", "words"], F.xxhash64(text)))
    same = [("nosrc", "mix_nosrc"), ("src", "mix_src"), ("words", "mix_size"), ("n", "mix_n")]
    rows = rows.join(mix, reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in same], F.col("id").eqNullSafe(F.col("mix_doc_id"))))
    whole = F.floor(F.col("mix_taken") / F.col("mix_size")).cast("int")
    part = F.col("mix_taken") % F.col("mix_size")
    takes = F.concat(F.array_repeat(F.col("mix_size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("take", F.explode(takes))
    head = F.when(F.col("take") == F.col("mix_size"), text).otherwise(first_words(text, F.col("take")))
    return rows.select(*[(head if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
