"""Term statistics over parallel text: document frequencies, candidates, keyword pairs, conflicts, extraction scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from glosswright.functions import text as T

PAIRS, STEP = 4_000_000, 1_000_000  # pairs of a bucket, and pairs that are counted at once

def frequencies(pairs: DataFrame, grams, id_col: str = "id", out: str = "term") -> DataFrame:
    """(id, term), each term once per row: counts over it are document frequencies."""
    return pairs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(grams)).alias(out))


def document_frequency(pairs: DataFrame, grams, id_col: str = "id", out: str = "term") -> DataFrame:
    return frequencies(pairs, grams, id_col, out).groupBy(out).agg(F.count("*").alias("df"))


def numbered(pairs: DataFrame, grams, id_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, terms: hashes of the row's frequent terms) and (h, term, df) of the terms with a frequency of `least`.

    No pair can occur together more often than its rarer half occurs, so dropping rare terms before they are paired
    changes nothing. Terms are 64-bit hashes until the end."""
    each = frequencies(pairs, grams, id_col).select("id", "term", F.xxhash64("term").alias("h"))
    counts = each.groupBy("h", "term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
    rows = each.select("id", "h").join(counts.select("h"), "h").groupBy("id").agg(F.collect_list("h").alias("terms"))
    return rows, counts


def counted_pairs(rows: DataFrame, least: int, pairs_a_task: int = PAIRS) -> DataFrame:
    """(e, k, cooccurrence) of at least `least`, from rows (es, ks) of distinct hashes.

    Pairs are dealt to a square of buckets by both hashes, so a row sends each side once per column or row of the square,
    never its pairs. A bucket has its pairs whole: they are counted there, in steps whose counts are added up whenever they
    have grown, and only frequent ones leave it. The more pairs there are, the more buckets, so a long row or a frequent term
    is spread; one pair that stands in very many rows is counted in its bucket, in memory that does not grow with them."""
    import numpy as np
    import pyarrow as pa

    total = rows.agg(F.sum(F.size("es").cast("long") * F.size("ks"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(total / pairs_a_task)))

    def steps(es: list, ks: list) -> tuple:
        ue, ie = np.unique(np.concatenate(es), return_inverse=True)
        uk, ik = np.unique(np.concatenate(ks), return_inverse=True)
        codes, x, y = [], 0, 0
        for e, k in zip(es, ks, strict=True):
            codes.append((ie[x : x + len(e), None] * len(uk) + ik[None, y : y + len(k)]).ravel())
            x, y = x + len(e), y + len(k)
        c, n = np.unique(np.concatenate(codes), return_counts=True)
        return ue[c // len(uk)], uk[c % len(uk)], n

    def added(parts: list[tuple]) -> tuple:
        """Counts of the same pair added up."""
        e, k, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((k, e))
        e, k, n = e[order], k[order], n[order]
        first = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (k[1:] != k[:-1]))) if len(e) else np.zeros(0, np.int64)
        return e[first], k[first], np.add.reduceat(n, first) if len(e) else n

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, es, ks, size, done = None, [], [], 0, []

        def settled() -> pa.RecordBatch:
            e, k, n = added(done + ([steps(es, ks)] if es else []))
            ok = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (e, k, n)], ["e", "k", "cooccurrence"])

        for b in batches:
            for at, e, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if at != key:
                    yield settled()
                    key, es, ks, size, done = at, [], [], 0, []
                es.append(e.values.to_numpy())
                ks.append(k.values.to_numpy())
                size += len(es[-1]) * len(ks[-1])
                if size >= STEP:
                    done.append(steps(es, ks))
                    es, ks, size = [], [], 0
                    if sum(len(p[0]) for p in done[1:]) > max(STEP, len(done[0][0])):
                        done = [added(done)]
        yield settled()

    places = F.sequence(F.lit(0), F.lit(side - 1))
    dealt = rows.select("ks", F.explode(places).alias("i"), "es").select("i", "ks", F.filter("es", lambda x: F.pmod(x, F.lit(side)) == F.col("i")).alias("es")).filter("size(es) > 0")
    dealt = dealt.select("i", "es", F.explode(places).alias("j"), "ks").select("i", "j", "es", F.filter("ks", lambda x: F.pmod(x, F.lit(side)) == F.col("j")).alias("ks")).filter("size(ks) > 0")
    dealt = dealt.select((F.col("i") * side + F.col("j")).alias("bucket"), "es", "ks").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(counted, "e long, k long, cooccurrence long")


def _of(pairs: DataFrame, column: str, n_max: int, from_text) -> Column:
    """n-grams of a text, or of a column that has its tokens already, such as normalised ones."""
    if isinstance(pairs.schema[column].dataType, ArrayType):
        return T.ngrams(F.coalesce(F.col(column), F.array().cast("array<string>")), n_max)
    return from_text(F.col(column))


def candidates(pairs: DataFrame, source_col: str = "en_text", target_col: str = "ko_text", id_col: str = "id", n_max: int = 3, least: int = 5, normalise=None) -> DataFrame:
    """en_term, ko_term, cooccurrence, dice, pmi of all pairs of n-grams that share at least `least` rows. Either side is a text
    or an array of its tokens (see morphology.normalised); null has none."""
    total = pairs.select(F.count("*").alias("n_rows"))
    en, ef = numbered(pairs, _of(pairs, source_col, n_max, lambda c: T.source_ngrams(c, n_max)), id_col, least)
    ko, kf = numbered(pairs, _of(pairs, target_col, n_max, lambda c: T.target_ngrams(c, n_max, normalise)), id_col, least)
    rows = en.withColumnRenamed("terms", "es").join(ko.withColumnRenamed("terms", "ks"), "id")
    both = counted_pairs(rows.select("es", "ks"), least)
    both = both.join(ef.select(F.col("h").alias("e"), F.col("term").alias("en_term"), F.col("df").alias("ef")), "e")
    both = both.join(kf.select(F.col("h").alias("k"), F.col("term").alias("ko_term"), F.col("df").alias("kf")), "k").crossJoin(F.broadcast(total))  # one row
    n, c = F.col("n_rows").cast("double"), F.col("cooccurrence").cast("double")
    dice = 2 * c / (F.col("ef") + F.col("kf"))
    pmi = F.log2((c / n) / ((F.col("ef") / n) * (F.col("kf") / n)))
    return both.select("en_term", "ko_term", "cooccurrence", dice.alias("dice"), pmi.alias("pmi"))


def cap(cands: DataFrame, most_terms: int = 1500, per_term: int = 3) -> DataFrame:
    """The `most_terms` source terms by highest co-occurrence, each with its `per_term` best targets by dice.

    The first ranking is over distinct source terms only, never over the pairs."""
    tops = cands.groupBy("en_term").agg(F.max("cooccurrence").alias("mx")).orderBy(F.desc("mx"), "en_term").limit(most_terms).select("en_term")
    best = W.partitionBy("en_term").orderBy(F.desc("dice"), F.desc("cooccurrence"), "ko_term")
    kept = cands.join(tops, "en_term", "left_semi")
    return kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_term).drop("rank")


def in_order(cands: DataFrame) -> DataFrame:
    """Candidates as they are reported: best dice first, then co-occurrence, then by term."""
    return cands.orderBy(F.desc("dice"), F.desc("cooccurrence"), "en_term", "ko_term")


def keyword_pairs(pairs: DataFrame, en_col: str, ko_col: str, id_col: str = "id", translated=T.is_translated) -> DataFrame:
    """(en_term, ko_term, card_ids): keywords at equal places of two lists of equal length; ids in order."""
    rows = pairs.filter(F.size(en_col) == F.size(ko_col)).select(F.col(id_col).alias("id"), F.explode(F.arrays_zip(F.col(en_col).alias("e"), F.col(ko_col).alias("k"))).alias("z"))
    z = rows.select("id", F.lower(F.trim(F.col("z").getField("e"))).alias("en_term"), F.trim(F.col("z").getField("k")).alias("ko_term"))
    z = z.filter((F.col("en_term") != "") & (F.col("ko_term") != "") & translated(F.col("ko_term")))
    return z.groupBy("en_term", "ko_term").agg(F.sort_array(F.collect_set("id")).alias("card_ids"))


def keyword_counters(pairs: DataFrame, en_col: str, ko_col: str, translated=T.is_translated) -> DataFrame:
    """One row: rows with keywords in both languages, those of unequal length, and keywords without a translation."""
    has, even = (F.size(en_col) > 0) & (F.size(ko_col) > 0), F.size(en_col) == F.size(ko_col)
    dropped = F.size(F.filter(ko_col, lambda x: ~translated(x)))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pairs.agg(
        n(F.when(has, 1).otherwise(0)).alias("with_keywords"), n(F.when(has & ~even, 1).otherwise(0)).alias("skipped_mismatch"),
        n(F.when(has & even, dropped).otherwise(0)).alias("dropped_untranslated"),
    )


def conflicts(term_pairs: DataFrame, source: str) -> DataFrame:
    """One row per source term: its variants in order and, where the pairs have card_ids, the ids of each variant's rows;
    clean if there is one variant, a conflict if there are more."""
    rows = term_pairs.filter((F.col("en_term") != "") & (F.col("ko_term") != ""))
    ids = F.col("card_ids") if "card_ids" in term_pairs.columns else F.array().cast("array<string>")
    each = rows.select("en_term", "ko_term", F.explode_outer(ids).alias("card_id")).groupBy("en_term", "ko_term").agg(F.sort_array(F.collect_list("card_id")).alias("ids"))
    each = each.groupBy("en_term").agg(F.array_sort(F.collect_list(F.struct("ko_term", "ids"))).alias("v"))
    named = F.map_from_entries(F.filter("v", lambda x: F.size(x["ids"]) > 0))
    variants = F.transform("v", lambda x: x["ko_term"])
    return each.select("en_term", variants.alias("ko_variants"), F.size("v").alias("n_variants"), (F.size("v") > 1).alias("is_conflict"), named.alias("source_card_ids"), F.lit(source).alias("source"))


def all_conflicts(*lists: DataFrame) -> DataFrame:
    """The conflicts of several lists, one after another; clean terms are left out."""
    out = None
    for one in lists:
        one = one.filter("is_conflict").select("en_term", "ko_variants", "source_card_ids", "source")
        out = one if out is None else out.unionByName(one)
    return out


def exclude(cands: DataFrame, official: DataFrame, column: str = "en_term", key: str = "id", normalised: bool = False) -> DataFrame:
    """Candidates whose lower-case term is not an official id, literally or with the id's separators as spaces."""
    ids = official.select((T.id_words(F.col(key)) if normalised else F.col(key)).alias("_official")).distinct()
    return cands.join(ids, F.lower(F.col(column)) == F.col("_official"), "left_anti")


def extraction_scores(found: DataFrame, gold: DataFrame, column: str = "term") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over distinct normalised terms; 0 where a denominator is."""
    f = found.select(T.id_words(F.col(column)).alias("t")).distinct().withColumn("f", F.lit(1))
    g = gold.select(T.id_words(F.col(column)).alias("t")).distinct().withColumn("g", F.lit(1))
    n = f.join(g, "t", "full").agg(
        F.coalesce(F.sum(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)), F.lit(0)).alias("fn"),
    )
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# ---- fixed values: words that carry no term at an n-gram's edge -----------------------------------------------------
FUNCTION_WORDS = """
the a an this that these those it its of to in on for from at by with as into and or if when whenever then than but not
is are was be been do does did has have had you your he she they their his her may can must will would any all each other
another up out off only also more most one there here who which what how so no nor
""".split()
# ---- end of fixed values --------------------------------------------------------------------------------------------
REACH = ("found", "missed", "official_excluded", "over_max_n", "below_min_cooccur", "below_rank_cut")


def rank_cut(df_terms: DataFrame, most_terms: int = 1500, least: int = 5) -> DataFrame:
    """One row, `boundary`: the frequency of the term at the cap among those of at least `least`; null if all fit."""
    top = df_terms.filter(F.col("df") >= least).select("df").orderBy(F.desc("df")).limit(most_terms)
    n = df_terms.filter(F.col("df") >= least).agg(F.count("*").alias("n"))
    low = top.agg(F.min("df").alias("low"))
    return n.crossJoin(low).select(F.when(F.col("n") > most_terms, F.col("low")).alias("boundary"))


def gold_scorecard(gold: DataFrame, found: DataFrame, df_terms: DataFrame, official: DataFrame, least: int = 5, n_max: int = 3, most_terms: int = 1500, ko_key=F.lower) -> DataFrame:
    """Each gold term (en, ko list, source) with its reach, whether a target agrees (null unless found), and whether its
    form was mangled by tokens. `ko_key` is what targets of both sides are compared by."""
    f = found.select(T.eval_term(F.col("en_term")).alias("key"), ko_key(F.col("ko_term")).alias("ko_term"))
    g = gold.withColumn("key", T.eval_term(F.col("en"))).withColumn("mangled", T.symbol_mangled(F.col("en"))).withColumn("ko", F.transform("ko", ko_key))
    hit = g.join(f, "key", "left").groupBy("en", "source", "key", "mangled").agg(
        F.max(F.col("ko_term").isNotNull()).alias("is_found"), F.max(F.array_contains("ko", F.col("ko_term"))).alias("ko_match")
    )
    off = official.select(T.eval_term(F.col("id")).alias("key")).distinct().withColumn("is_official", F.lit(True))
    hit = hit.join(off, "key", "left").join(df_terms.select(F.col("term").alias("key"), "df"), "key", "left")
    hit = hit.crossJoin(F.broadcast(rank_cut(df_terms, most_terms, least)))
    reach = (
        F.when(F.col("is_found"), "found").when(F.col("is_official"), "official_excluded").when(F.size(F.split("key", " ")) > n_max, "over_max_n")
        .when(F.coalesce("df", F.lit(0)) < least, "below_min_cooccur").when(F.col("df") < F.col("boundary"), "below_rank_cut").otherwise("missed")
    )
    return hit.select("en", "source", reach.alias("reach"), "ko_match", "mangled")


def frequency_sheet(pairs: DataFrame, text_col: str, id_col: str = "id", least: int = 5, most: int = 500, in_cap: int = 1500) -> DataFrame:
    """The `most` most frequent n-grams whose edge words carry meaning, with the first row as example and whether they
    are among the `in_cap` most frequent of all."""
    t = frequencies(pairs, T.source_ngrams(F.col(text_col)), id_col)
    d = t.groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("example")).filter(F.col("df") >= least)
    words = F.split("term", " ")
    edge = lambda w: w.isin(FUNCTION_WORDS) | w.rlike("^[0-9]+$")
    inside = d.orderBy(F.desc("df"), "term").limit(in_cap).select("term", F.lit(True).alias("_in"))
    top = d.filter(~edge(F.element_at(words, 1)) & ~edge(F.element_at(words, -1))).orderBy(F.desc("df"), "term").limit(most)
    return top.join(inside, "term", "left").select("term", "df", "example", F.coalesce("_in", F.lit(False)).alias("in_cap"))
