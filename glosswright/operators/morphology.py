"""Target words in dictionary form, by an injected tagger.

A tagger is a plain callable from a text to (form, tag) pairs. A word is cut into pieces at symbols, bracketed ASCII and
registered words, which stay as they are; only what is left is tagged: particles, endings and other tags without content
go, verbs get their dictionary ending, light verbs go. The pieces then stand together again. Cutting and joining are
Spark expressions; each distinct piece is tagged once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswright.functions import text as T

# ---- fixed values ---------------------------------------------------------------------------------------------------
KEPT = r"\[[^\]]+\]|\([A-Za-z0-9&/.\-]+\)"
CONTENT_TAGS = ("NNG", "NNP", "NNB", "VV", "VA", "VX", "XR", "SL", "SH", "SN", "MAG")
VERB_TAGS = ("VV", "VA", "VX")
LIGHT_VERBS = ("하", "되")
ENDING = "다"
# ---- end of fixed values --------------------------------------------------------------------------------------------

Tagger = Callable[[str], list[tuple[str, str]]]


def content(piece: str, tagger: Tagger) -> str:
    """The forms with content of a piece of text, verbs with their ending."""
    forms = []
    for form, tag in tagger(piece):
        kind = tag.split("-", 1)[0]
        if kind in VERB_TAGS and form not in LIGHT_VERBS:
            forms.append(form + ENDING)
        elif kind in CONTENT_TAGS and kind not in VERB_TAGS:
            forms.append(form)
    return " ".join(f for f in forms if f)


def kept_pattern(registered: Iterable[str] = ()) -> str:
    """What stays as it is: symbols, bracketed ASCII and registered words, of which the longest stands first."""
    quoted = [rf"\Q{w}\E" for w in sorted({w for w in registered if w and r"\E" not in w}, key=lambda w: (-len(w), w))]
    return "|".join([KEPT, *quoted])


def dictionary(words: DataFrame, tagger: Tagger, registered: Iterable[str] = ()) -> DataFrame:
    """(word, norm) for the distinct words of a column `word`."""
    import pyarrow as pa

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm = [content(p, tagger) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(norm, pa.string())], ["piece", "tagged"])

    kept = kept_pattern(registered)
    pieces = F.regexp_extract_all("word", F.lit(rf"(?s)(?:{kept})|(?:(?!{kept}).)+"), F.lit(0))
    distinct = words.filter("word is not null").select("word").distinct()
    cut = distinct.select("word", F.posexplode_outer(pieces).alias("i", "piece")).withColumn("stays", F.regexp_like("piece", F.lit(rf"(?s)^(?:{kept})$")))
    known = cut.filter("not stays").select("piece").distinct().mapInArrow(tagged, "piece string, tagged string")
    whole = cut.join(known, "piece", "left").withColumn("part", F.when(F.col("stays"), F.col("piece")).otherwise(F.coalesce("tagged", F.lit(""))))
    ordered = whole.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("part", F.lit("")).alias("part")))).alias("p"))
    return ordered.select("word", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("norm"))


def normalised(rows: DataFrame, text_col: str, tagger: Tagger, id_col: str = "id", out: str = "norm_tokens", registered: Iterable[str] = ()) -> DataFrame:
    """(id, out): each row's target words in dictionary form, in order, empty ones dropped; ids must be unique."""
    words = rows.select(F.col(id_col).alias("id"), F.posexplode(T.target_tokens(F.col(text_col))).alias("pos", "word"))
    found = words.join(dictionary(words, tagger, registered), "word").filter("norm != ''").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "norm"))).alias("_w"))
    return rows.select(F.col(id_col).alias("id")).join(found, "id", "left").select("id", F.coalesce(F.transform("_w", lambda x: x["norm"]), F.array().cast("array<string>")).alias(out))


def normalised_terms(terms: DataFrame, term_col: str, tagger: Tagger, registered: Iterable[str] = ()) -> DataFrame:
    """terms with `norm`: a target term as scoring compares it, its words in dictionary form."""
    distinct = terms.select(F.col(term_col).alias("id")).distinct()
    norm = normalised(distinct.filter("id is not null").withColumn("_t", F.col("id")), "_t", tagger, registered=registered).select(F.col("id").alias("_term"), F.array_join("norm_tokens", " ").alias("norm"))
    return terms.join(norm, terms[term_col] == norm["_term"], "left").drop("_term")
