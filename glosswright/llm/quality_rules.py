"""Quality rules: one projection of length, symbol, stop-word and line ratios, judged by a table of thresholds.

Everything is computed inside one Spark projection, without a shuffle and without user functions; each document is
judged by itself, so partitions of any kind give the same result.

Cases: null, empty and blank texts have no words and fail as too short; very long texts are whole arrays of one row;
repeated rows and ids are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, text_of

#: Common function words of the supported languages (fixed values).
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an have not a "
    "der die das und ist nicht von zu mit den dem ein eine auf für im sich auch "
    "le la les de des un une et est que pas pour dans en du au par sur qui avec "
    "el los las del y en que es una por con para su al se no lo como"
).split()
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})

#: rule name -> (metric, lowest, highest); None leaves a side open. A document is kept if every rule holds.
THRESHOLDS: dict[str, tuple[str, float | None, float | None]] = {
    "enough_words": ("n_words", 10, None),
    "repeated_windows": ("repeat_word_ratio", None, 0.20),
    "mean_word_length": ("mean_word_length", 2.0, 25.0),
    "symbols_to_words": ("symbol_word_ratio", None, 0.30),
    "duplicate_lines": ("dup_line_ratio", None, 0.50),
    "mostly_letters": ("mark_char_ratio", None, 0.50),
    "bullet_lines": ("bullet_line_ratio", None, 0.90),
    "ellipsis_lines": ("ellipsis_line_ratio", None, 0.50),
    "shouting": ("upper_ratio", None, 0.70),
    "stop_words": ("stop_word_ratio", 0.01, None),
}


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside a window of `width` words that the text has twice or more, by 64-bit window hashes.

    Texts whose hashes all differ end there; in the others sorted (hash, place) pairs put equal windows side by
    side, and the places found cover the words between them."""
    last = F.size(words) - width  # 0-based start of the last window
    starts = F.sequence(F.lit(0), last)
    hash_at = lambda i: F.xxhash64(*[words[i + k] for k in range(width)])
    hashes = F.transform(starts, hash_at)
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(hash_at(i).alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        hit = F.transform(p, lambda x, k: F.when(near(x, k - 1) | near(x, k + 1), x["i"]))
        return F.sort_array(F.array_compact(hit))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["at"])).alias("n"), i.alias("at")),
            lambda acc: acc["n"].cast("long"),
        )

    # a one-element array binds a value that a lambda then uses more than once
    found = F.transform(F.transform(F.array(pairs), places), covered)[0]
    none = F.lit(0).cast("long")
    return F.when(last < 1, none).when(F.size(F.array_distinct(hashes)) == last + 1, none).otherwise(found)


def metrics(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5) -> DataFrame:
    """One row per input row: the id and every metric that THRESHOLDS may name."""
    bare = F.btrim("_t", F.lit(" \t\n\x0b\f\r"))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+", -1))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    d = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t")).select("doc_id", "_t", words.alias("_w"), lines.alias("_l"))
    only = lambda kept: F.length(F.regexp_replace("_t", f"[^{kept}]+", "")).cast("long")
    d = d.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), width).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"[\p{L}\x20\x09-\x0D]+", "")).alias("_marks"),
        F.size(F.filter("_l", lambda x: x.rlike(rf"^{SPACE}*(?:[-*•]|[0-9]+[.)]){SPACE}"))).alias("_bullets"),
        F.size(F.filter("_l", lambda x: x.rlike(rf"(?:\.\.\.|…){SPACE}*$"))).alias("_dots"),
        F.size(F.filter("_w", lambda w: w.isin(STOP_FORMS))).alias("n_stop_words"),
        only(r"\p{Lu}").alias("_upper"),
    )
    n, ratio = F.col("n_words"), lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_words").alias("symbol_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("_marks", "word_chars").alias("mark_char_ratio"),
        ratio("_bullets", "n_lines").alias("bullet_line_ratio"),
        ratio("_dots", "n_lines").alias("ellipsis_line_ratio"),
        ratio("_upper", "word_chars").alias("upper_ratio"),
        # a share of stop words tells little about a short text
        F.when(n < 50, F.lit(1.0)).otherwise(ratio("n_stop_words", "n_words")).alias("stop_word_ratio"),
    )


def verdict(thresholds: dict[str, tuple[str, float | None, float | None]]) -> tuple[Column, Column]:
    """(kept, names of the rules that failed) from a table of thresholds."""
    broken = []
    for name, (metric, low, high) in thresholds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(metric) < low)
        if high is not None:
            bad = bad | (F.col(metric) > high)
        broken.append(F.when(bad, F.lit(name)))
    failed = F.array_compact(F.array(*broken))
    return F.size(failed) == 0, failed


def quality_rules(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", thresholds: dict | None = None) -> DataFrame:
    """The metrics of each row, kept, and failed_rules (which rules it broke)."""
    kept, failed = verdict(thresholds or THRESHOLDS)
    return metrics(df, text_col, id_col).select("*", kept.alias("kept"), failed.alias("failed_rules"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )
