"""Scans of the parallel corpus: cards of two languages, printings, sets, legacy keywords, glossaries, gold terms.

Every read has an explicit schema; malformed JSON becomes null rows that the joins drop. Paths are resolved by Spark's
readers, so any store works."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.session import workspace

# ---- fixed values ---------------------------------------------------------------------------------------------------
GLOSSARY_CATEGORIES = ("card_subtypes", "card_types", "factions", "card_cycles", "card_sets")
GOLD_SOURCES = ("unaided", "aided")
FIRST_YEAR, LAST_YEAR, HOLD_OUT, SEED = 2012, 2016, 100, 42
# ---- end of fixed values --------------------------------------------------------------------------------------------


def cards(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of one JSON object per file; the id is the file's stem."""
    d = spark.read.schema("text string").option("multiLine", True).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return d.select(stem.alias("id"), "text")


def printings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, card_id string, card_set_id string, flavor string").option("multiLine", True).json(path)


def card_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, date_release string").option("multiLine", True).json(path)


def legacy_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(code, keywords), blank ones dropped; nothing if there is no such folder."""
    schema = "code string, keywords string"
    try:
        d = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return d.filter(T.squeeze_ends(F.col("keywords")) != "")


def earliest_release(prints: DataFrame, sets: DataFrame) -> DataFrame:
    """(card_id, date): the first release of any printing; blank dates do not count."""
    s = sets.filter(T.squeeze_ends(F.col("date_release")) != "").select(F.col("id").alias("card_set_id"), "date_release")
    return prints.join(s, "card_set_id").groupBy("card_id").agg(F.min("date_release").alias("date"))


def code_to_card(prints: DataFrame) -> DataFrame:
    return prints.groupBy(F.col("id").alias("code")).agg(F.max("card_id").alias("card_id"))


def bilingual_keywords(en: DataFrame, ko: DataFrame, codes: DataFrame) -> DataFrame:
    """(card_id, en_keywords, ko_keywords): of each card's codes with keywords in both languages the lowest."""
    words = lambda c: F.transform(F.split(c, " - "), lambda w: T.squeeze_ends(w))
    j = en.select("code", words(F.col("keywords")).alias("en_keywords")).join(ko.select("code", words(F.col("keywords")).alias("ko_keywords")), "code").join(codes, "code")
    first = W.partitionBy("card_id").orderBy("code")
    return j.withColumn("n", F.row_number().over(first)).filter("n = 1").select("card_id", "en_keywords", "ko_keywords")


def bilingual_flavor(en: DataFrame, ko: DataFrame, has_target: Column | None = None) -> DataFrame:
    """(card_id, en_flavor, ko_flavor) of each card's lowest printing id that has both, the target one translated."""
    e = en.filter(F.col("flavor") != "").select("id", "card_id", F.col("flavor").alias("en_flavor"))
    k = ko.filter(F.col("flavor") != "").select("id", F.col("flavor").alias("ko_flavor"))
    j = e.join(k, "id").filter(has_target if has_target is not None else T.has_hangul(F.col("ko_flavor")))
    return j.groupBy("card_id").agg(F.min_by(F.struct("en_flavor", "ko_flavor"), "id").alias("f")).select("card_id", "f.en_flavor", "f.ko_flavor")


def translated_only(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose column is there and translated."""
    return rows.filter(T.is_translated(F.col(column)))


def in_order(corpus: DataFrame) -> DataFrame:
    """A corpus in its order: by date, then by id."""
    return corpus.orderBy("date", "id")


def head(corpus: DataFrame, n: int) -> DataFrame:
    """The first n rows in the corpus's order."""
    return in_order(corpus).limit(n)


def clean_corpus(en: DataFrame, ko: DataFrame, dates: DataFrame, keywords: DataFrame | None = None, flavor: DataFrame | None = None, years: tuple[int, int] = (FIRST_YEAR, LAST_YEAR), translated=T.is_translated) -> DataFrame:
    """The clean pairs: released in `years`, with a source text and a translated target text. Untranslated rows go
    before anything is counted. Order it by date and id where order matters."""
    e = en.filter(T.squeeze_ends(F.col("text")) != "").select("id", F.col("text").alias("en_text"))
    k = (translated_only(ko, "text") if translated is T.is_translated else ko.filter(translated(F.col("text")))).select("id", F.col("text").alias("ko_text"))
    d = dates.filter(F.substring("date", 1, 4).cast("int").between(*years)).select(F.col("card_id").alias("id"), "date")
    out = e.join(k, "id").join(d, "id")
    for extra in (keywords, flavor):
        if extra is not None:
            out = out.join(extra.withColumnRenamed("card_id", "id"), "id", "left")
    return out


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """(the order's columns, place): 0-based places in that order, without a window over everything. Rows are sorted in ranges,
    written once, and a row's place is its place in its range and the number of rows before that; one row a range is collected."""
    path = workspace(rows.sparkSession, "numbered")
    ranged = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(*order, F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id() % (1 << 33)).alias("_nth")).write.parquet(path)
    made, before = rows.sparkSession.read.parquet(path), [(-1, 0)]
    for r in made.groupBy("_range").count().orderBy("_range").collect():
        before.append((r["_range"], before[-1][1] + r["count"]))
    starts = rows.sparkSession.createDataFrame([(b[0], a[1]) for a, b in zip(before, before[1:], strict=False)], "_range int, _start long")
    return made.join(F.broadcast(starts), "_range").select(*order, (F.col("_start") + F.col("_nth")).alias("place"))


def shuffled_places(n: int, heads: int, seed: int, stretch: int = 1 << 20) -> list[int]:
    """Which of n places come first, in order, when the standard library shuffles them with this seed.

    The draws of a shuffle depend on n and the seed only. They are followed backwards for the first places, a stretch at a
    time from states of the generator kept on the way, so memory is the heads and a state a stretch; time is n draws, twice."""
    import random

    rng, states = random.Random(seed), []

    def drawn(top: int) -> list[int]:
        out = []
        for i in range(top, max(top - stretch, 0), -1):
            bits = (i + 1).bit_length()
            j = rng.getrandbits(bits)
            while j > i:
                j = rng.getrandbits(bits)
            out.append(j)
        return out

    tops = list(range(n - 1, 0, -stretch))
    for top in tops:
        states.append(rng.getstate())
        drawn(top)
    at = {i: i for i in range(min(heads, n))}  # place so far -> place at the end
    for top in reversed(tops):
        rng.setstate(states.pop())
        swaps = drawn(top)
        for k in range(len(swaps) - 1, -1, -1):
            i, j = top - k, swaps[k]
            if i != j and (i in at or j in at):
                a, b = at.pop(i, None), at.pop(j, None)
                if b is not None:
                    at[i] = b
                if a is not None:
                    at[j] = a
    return [place for place, _ in sorted(at.items(), key=lambda x: x[1])]


def seeded_split(corpus: DataFrame, hold_out: int = HOLD_OUT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(hold-out with its place `pos`, train) by the standard library's shuffle of the ordered ids, which are unique. The driver
    gets the number of ids and draws as often (see shuffled_places), never an id; hash_split needs no draws."""
    places = numbered(corpus, "date", "id")
    heads = shuffled_places(places.count(), hold_out, seed)
    spark = corpus.sparkSession
    held = places.join(F.broadcast(spark.createDataFrame([(p, i) for i, p in enumerate(heads)], "place long, pos int")), "place").select("id", "pos")
    return corpus.join(F.broadcast(held), "id"), corpus.join(F.broadcast(held), "id", "left_anti")


def hash_order(id_col: Column) -> Column:
    return F.pmod(id_col * F.lit(2654435761), F.lit(1000003))


def hash_split(rows: DataFrame, hold_out: int, id_col: str = "id") -> DataFrame:
    """rows with `held`: whether the row is among the first `hold_out` by a hash of its id."""
    top = rows.select(id_col, hash_order(F.col(id_col)).alias("_h")).orderBy("_h", id_col).limit(hold_out)
    return rows.join(F.broadcast(top.select(id_col, F.lit(True).alias("_held"))), id_col, "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")


def official_glossary(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(category, id, name) of one JSON array per category; a missing file raises."""
    out = None
    for category, path in paths.items():
        d = spark.read.schema("id string, name string").option("multiLine", True).json(path)
        d = d.select(F.lit(category).alias("category"), "id", F.when(F.assert_true(F.col("id").isNotNull() & F.col("name").isNotNull(), f"bad entry in {category}").isNull(), F.col("name")).alias("name"))
        out = d if out is None else out.unionByName(d)
    return out


def flat_official(glossary: DataFrame, categories: tuple[str, ...] = GLOSSARY_CATEGORIES) -> DataFrame:
    """(id, name): of an id in several categories the last category's name stays."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    return glossary.groupBy("id").agg(F.max_by("name", place).alias("name"))


def glossary_asset(spark: SparkSession, path: str) -> DataFrame:
    """(section, en, ko) from the asset's three maps."""
    maps = ", ".join(f"{s} map<string,string>" for s in ("official", "subtype_extracted", "extracted"))
    d = spark.read.schema(maps).option("multiLine", True).json(path)
    parts = [d.select(F.lit(s).alias("section"), F.explode(s).alias("en", "ko")) for s in ("official", "subtype_extracted", "extracted")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gold_terms(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(en, ko, source, note) of a versioned gold file; another version, or an entry without en, ko or a known source, raises."""
    schema = "schema_version int, entries array<struct<en:string,ko:array<string>,source:string,note:string>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    d = d.filter(F.assert_true(F.col("schema_version") == version, "unknown schema_version").isNull())
    d = d.select(F.explode("entries").alias("e")).select("e.*")
    good = (F.col("en") != "") & (F.size("ko") > 0) & F.col("source").isin(*GOLD_SOURCES)
    return d.filter(F.assert_true(F.coalesce(good, F.lit(False)), "bad gold entry").isNull()).select("en", "ko", "source", F.coalesce("note", F.lit("")).alias("note"))
