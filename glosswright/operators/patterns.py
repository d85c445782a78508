"""Sentence templates: recurring pairs of abstracted sentences and their lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.session import workspace

SALTS, ROWS = 32, 10_000
MOST_CELLS = 1 << 29  # of one bit each in what is broadcast: 64 MB


def templates(pairs: DataFrame, en_col: str = "en_text", ko_col: str = "ko_text", id_col: str = "id", seq_col: str = "id") -> DataFrame:
    """(id, seq, pos, en_template, ko_template, h: a hash of the two) of the sentences of rows with equally many of them."""
    # one expression makes the templates of a row: filters between would have each sentence split and abstracted twice
    both = F.struct(T.sentences(F.col(en_col)).alias("es"), T.sentences(F.col(ko_col)).alias("ks"))
    made = lambda p: F.transform(F.arrays_zip(p["es"].alias("e"), p["ks"].alias("k")), lambda x: F.struct(T.template(x["e"]).alias("en"), T.template(x["k"]).alias("ko")))
    even = F.transform(F.array(both), lambda p: F.when(F.size(p["es"]) == F.size(p["ks"]), made(p)))[0]
    s = pairs.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), F.posexplode_outer(even).alias("pos", "z"))
    t = s.select("id", "seq", "pos", F.col("z.en").alias("en_template"), F.col("z.ko").alias("ko_template")).filter("en_template <> '' and ko_template <> ''")
    return t.withColumn("h", F.xxhash64("en_template", "ko_template"))


def able(rows: DataFrame, least: int, n_rows: int, most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows whose `h` may stand in `least` of them; all rows of such a hash are among them.

    Hashes share cells, eight for each row up to `most_cells`, and a cell counts no fewer rows than each of its hashes has. Only
    cells are shuffled, added up in each task first; those that reach `least` are one bit each in bitmaps that every task gets
    (most_cells / 8 bytes at most). More hashes in a cell let more rows through and never lose one. rows is read twice, once
    for h alone."""
    if least <= 1:
        return rows
    cells = min(most_cells, 1 << max(15, (8 * n_rows).bit_length()))
    cell = F.pmod("h", F.lit(cells))
    often = rows.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    bits = often.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    asked = rows.withColumn("cell", cell)
    at = F.bitmap_bit_position("cell")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return asked.join(F.broadcast(bits), F.bitmap_bucket_number("cell") == F.col("bucket")).filter(held).drop("cell", "bucket", "bits")


def extract(pairs: DataFrame, en_col: str = "en_text", ko_col: str = "ko_text", id_col: str = "id", seq_col: str = "id", least: int = 3, examples: int = 3) -> DataFrame:
    """en_template, ko_template, count and the first example ids, from rows with equally many sentences.

    Templates are made once, into a table in the workspace; most stand in one sentence only, and those are dropped by their
    hashes (see `able`) before any text is shuffled. What is left is counted exactly."""
    spark, path = pairs.sparkSession, workspace(pairs.sparkSession, "templates")
    templates(pairs, en_col, ko_col, id_col, seq_col).write.parquet(path)
    t = spark.read.parquet(path)
    n_rows = t.count()
    # salts grow with the rows, so the places of a common template are gathered in parts of bounded size
    salts = max(SALTS, n_rows // ROWS)
    first = F.slice(F.array_sort(F.collect_list(F.struct("seq", "pos", "id"))), 1, examples)
    part = able(t, least, n_rows).withColumn("salt", F.pmod(F.xxhash64("seq", "pos"), F.lit(salts))).groupBy("en_template", "ko_template", "salt").agg(F.count("*").alias("n"), first.alias("some"))
    # parts of parts, so that no more than SALTS short lists meet at once
    g = part
    while salts > SALTS:
        salts = -(-salts // SALTS)
        g = g.withColumn("salt", F.pmod("salt", F.lit(salts))).groupBy("en_template", "ko_template", "salt").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, examples).alias("some"))
    g = g.groupBy("en_template", "ko_template").agg(F.sum("n").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, examples).alias("some"))
    return g.filter(F.col("count") >= least).select("en_template", "ko_template", "count", F.transform("some", lambda x: x["id"]).alias("examples"))


def lookup(requests: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """Each request with the most frequent pattern of its template, or nulls. Of equally frequent ones the first in the
    patterns' order (column seq) or, without one, the first by target template."""
    order = F.col("seq") if "seq" in patterns.columns else F.col("ko_template")
    best = patterns.groupBy("en_template").agg(F.min_by(F.struct("ko_template", "count"), F.struct(-F.col("count"), order)).alias("b"))
    best = best.select("en_template", "b.ko_template", "b.count")
    return requests.withColumn("en_template", T.template(F.col(text_col))).join(best, "en_template", "left")
