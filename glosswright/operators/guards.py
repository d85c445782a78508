"""Rule-based guards over (source, draft) pairs: glossary, conflicts, fidelity, injection, new terms, triggers.

Inputs have id, en_text, ko_text; each guard returns its violations as rows, so that guards combine by joins on id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.session import workspace

# ---- fixed values ---------------------------------------------------------------------------------------------------
STOP_WORDS = """
a an the and or but if in on to of for at by as with from into onto upon over under about between among without via per
than after before during until while unless when whenever where once although because though since except out off up
down this that which who what it its you your they their he she his her him we us them those these each any all no one
both either other another same such is are was were be been being has have had do does did will would can could may
might shall should must make makes made take takes took give gives gave get gets got use uses used pay pays paid add
adds place places placed move moves moved choose chooses chose look looks play plays end ends start starts begin begins
became put let lets gain gains lose loses lost deal deals dealt avoid spend spends spent become becomes not new first
last next only just also even still more most less much many some few own then so too very now here there instead
rather turn phase action player players time type side number amount effect effects ability abilities name target group
copy copies text
""".split()
SECTIONS = ("official", "subtype_extracted", "extracted")
GUARD_TOKEN = r"\[[^\]]+\]|[a-zA-Z][a-zA-Z'-]*[a-zA-Z]|[a-zA-Z]"
LEAST_LETTERS = 3
# ---- end of fixed values --------------------------------------------------------------------------------------------
#: What stands before a token: neither a letter nor a bracket that closes.
LEAD = r"(?:[^a-zA-Z\[]|\[(?![^\]]+\]))*+"


def flat_glossary(sections: DataFrame) -> DataFrame:
    """(en, ko, source) from rows (section, en, ko): keys normalised, empties dropped, the first section wins."""
    prio = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    g = sections.select(T.glossary_key(F.col("en")).alias("en"), "ko", F.col("section").alias("source"), prio.alias("prio"))
    g = g.filter((F.col("en") != "") & (F.col("ko") != ""))
    first = W.partitionBy("en").orderBy("prio", "ko")
    return g.withColumn("n", F.row_number().over(first)).filter(F.col("n") == 1).select("en", "ko", "source")


def anchored(terms: DataFrame, term_col: str, occurs: DataFrame) -> DataFrame:
    """terms with _anchor: of what every text that holds the term has among its runs, the one that fewest texts have.
    occurs: (_anchor, n) of runs; one that is not there occurs nowhere."""
    parts = terms.select(F.col(term_col).alias("_term")).distinct().select("_term", F.explode(T.anchors(F.col("_term"))).alias("_anchor"))
    found = parts.join(occurs, "_anchor", "left").groupBy("_term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("_anchor").alias("a"))).alias("m"))
    return terms.join(found.select("_term", F.col("m.a").alias("_anchor")), F.col(term_col) == F.col("_term")).drop("_term")


def phrase_hits(texts: DataFrame, terms: DataFrame, text_col: str = "en_text", term_col: str = "en", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep` columns and the columns of every term (distinct rows) that stands in the text as a whole phrase.

    Texts and terms meet by the term's rarest word run by the number of texts that have it (a term without one by its
    first character), so neither a term nor a text meets more than what that run brings; the exact test follows. Runs of
    texts that are a run of some term are written to the workspace once (a job), counted and joined. Only ids and hashes
    take part in that join; its few rows then find the texts by id and hash, so ids may repeat."""
    cols = ["id", text_col, *[c for c in keep if c != text_col]]
    rows = texts.select(*cols, F.xxhash64(*cols).alias("_row"))
    wanted = terms.select(F.explode(T.anchors(F.col(term_col))).alias("_anchor")).distinct()
    path = workspace(texts.sparkSession, "runs")
    rows.select("id", "_row", F.explode(T.runs(F.col(text_col))).alias("_anchor")).join(wanted, "_anchor", "left_semi").write.parquet(path)
    runs = texts.sparkSession.read.parquet(path)
    met = runs.join(anchored(terms, term_col, runs.groupBy("_anchor").agg(F.count("*").alias("n"))), "_anchor").drop("_anchor").distinct()
    same = rows["id"].eqNullSafe(F.col("_id")) & (rows["_row"] == F.col("_of"))
    hits = rows.join(met.withColumnsRenamed({"id": "_id", "_row": "_of"}), same).drop("_id", "_of", "_row")
    inside = F.contains(F.lower(F.col(text_col)), F.lower(F.col(term_col)))  # cheap, before a pattern is made
    return hits.filter(inside & T.has_phrase(F.col(text_col), F.col(term_col)))


def glossary_violations(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, en, ko, source): terms in the source whose target is not in the draft."""
    hits = phrase_hits(pairs, glossary, keep=("ko_text",))
    missing = ~F.contains(T.tight_parens(F.col("ko_text")), T.tight_parens(F.col("ko")))
    return hits.filter(missing).select("id", "en", "ko", "source")


def conflict_hits(texts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, en_term, ko_variants): conflicts with two variants or more whose term stands in the text, once by case."""
    c = conflicts.filter(F.size("ko_variants") >= 2).withColumn("k", F.lower("en_term"))
    c = c.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("en_term"))).filter(F.col("n") == 1).select("en_term", "ko_variants")
    return phrase_hits(texts, c, term_col="en_term").select("id", "en_term", "ko_variants")


def _compared(pairs: DataFrame, of, name: str) -> DataFrame:
    """(id, item, en_n, ko_n) of two multisets."""
    side = lambda c, out: pairs.select("id", F.explode(of(F.col(c))).alias(name)).groupBy("id", name).agg(F.count("*").alias(out))
    both = side("en_text", "en_n").join(side("ko_text", "ko_n"), ["id", name], "full")
    return both.select("id", name, F.coalesce("en_n", F.lit(0)).alias("en_n"), F.coalesce("ko_n", F.lit(0)).alias("ko_n"))


def fidelity_violations(pairs: DataFrame) -> DataFrame:
    """(id, kind, item, en_n, ko_n): numbers and symbols that differ in number, and conditions that are lost."""
    n = _compared(pairs, T.numbers, "item").filter("en_n != ko_n")
    n = n.select("id", F.when(F.col("en_n") > F.col("ko_n"), "omitted_number").otherwise("added_number").alias("kind"), "item", "en_n", "ko_n")
    s = _compared(pairs, T.guard_symbols, "item").filter("en_n != ko_n").select("id", F.lit("symbol_mismatch").alias("kind"), "item", "en_n", "ko_n")
    count = T.condition_count(F.col("en_text")).cast("long")
    c = pairs.filter((count > 0) & ~T.has_target_condition(F.col("ko_text")))
    c = c.select("id", F.lit("omitted_condition").alias("kind"), F.lit("").alias("item"), count.alias("en_n"), F.lit(0).cast("long").alias("ko_n"))
    return n.unionByName(s).unionByName(c)


def injection_hits(pairs: DataFrame, sides: tuple[tuple[str, str], ...] = (("en_text", "source"), ("ko_text", "draft_ko"))) -> DataFrame:
    """(id, side, pattern, matched): the first match of each pattern on each side."""
    found = F.flatten(F.array(*[T.injections(F.coalesce(F.col(c), F.lit("")), side) for c, side in sides]))
    return pairs.select("id", F.explode(found).alias("m")).select("id", "m.side", "m.pattern", "m.matched")


def new_terms(texts: DataFrame, glossary: DataFrame, route_col: str = "route", keywords_col: str | None = None) -> DataFrame:
    """(id, en_term, blocking, pos): unregistered terms, each once per text. Keywords block; so do capitalised words
    inside a sentence of rule text; everything else is only recorded."""
    covered = glossary.select(F.explode(F.split("en", " ")).alias("word")).unionByName(glossary.select(F.col("en").alias("word"))).distinct()
    plain = F.regexp_replace(F.col("en_text"), r"<[^>]+>", " ")
    # white space, then marks, before each token: what stands before the token decides whether it opens a sentence
    token_and_lead = F.regexp_extract_all(F.col("_plain"), F.lit(rf"{LEAD}(?:{GUARD_TOKEN})"), F.lit(0))
    t = texts.select("id", F.col(route_col).alias("route"), plain.alias("_plain"))
    t = t.select("id", "route", F.posexplode(token_and_lead).alias("pos", "chunk"))
    raw = F.regexp_extract("chunk", rf"^{LEAD}({GUARD_TOKEN})$", 1)
    before = F.substring(F.col("chunk"), F.lit(1), F.length("chunk") - F.length("raw"))
    t = t.withColumn("raw", raw).withColumn("lead", F.regexp_replace(before, rf"{T.S}+$", "")).withColumn("en_term", F.lower("raw"))
    opens = ((F.col("pos") == 0) & (F.col("lead") == "")) | F.col("lead").rlike(r"[.!?]$")
    t = t.filter(~F.col("raw").startswith("[") & (F.length("raw") >= LEAST_LETTERS) & ~F.col("en_term").isin(STOP_WORDS))
    t = t.withColumn("blocking", (F.col("route") == "rule") & F.col("raw").rlike("^[A-Z]") & ~opens)
    first = t.groupBy("id", "en_term").agg(F.min(F.struct("pos", "blocking")).alias("f"))
    words = first.select("id", "en_term", F.col("f.blocking").alias("blocking"), F.col("f.pos").cast("long").alias("pos"))
    if keywords_col:
        k = texts.select("id", F.posexplode(F.transform(keywords_col, lambda x: F.lower(F.trim(x)))).alias("p", "en_term"))
        k = k.filter(F.length("en_term") >= LEAST_LETTERS).groupBy("id", "en_term").agg(F.min("p").alias("p"))
        k = k.select("id", "en_term", F.lit(True).alias("blocking"), (F.col("p") - 1_000_000_000).cast("long").alias("pos"))
        words = k.unionByName(words.join(k, ["id", "en_term"], "left_anti"))
    return words.join(covered, F.col("en_term") == F.col("word"), "left_anti")


def triggers(pairs: DataFrame, glossary: DataFrame, conflicts: DataFrame | None = None, threshold: float = 0.01, score_col: str | None = None, keywords_col: str | None = None) -> DataFrame:
    """(id, reasons, should_interrupt, recording_terms), reasons in the order new_term, term_conflict, rule_violation,
    low_tm_confidence. A missing conflict list or score skips its trigger."""
    nt = new_terms(pairs, glossary, keywords_col=keywords_col)
    blocking = nt.filter("blocking").select("id").distinct().withColumn("r1", F.lit(True))
    recording = nt.filter("not blocking").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "en_term"))), lambda x: x["en_term"]).alias("recording_terms"))
    rule = glossary_violations(pairs, glossary).select("id").unionByName(fidelity_violations(pairs).select("id")).distinct().withColumn("r3", F.lit(True))
    d = pairs.join(blocking, "id", "left").join(rule, "id", "left").join(recording, "id", "left")
    r2 = F.lit(None).cast("boolean")
    if conflicts is not None:
        d = d.join(conflict_hits(pairs, conflicts).select("id").distinct().withColumn("r2", F.lit(True)), "id", "left")
        r2 = F.col("r2")
    low = F.coalesce(F.col(score_col) < threshold, F.lit(False)) if score_col else F.lit(False)
    reasons = F.array_compact(F.array(F.when(F.col("r1"), "new_term"), F.when(r2, "term_conflict"), F.when(F.col("r3"), "rule_violation"), F.when(low, "low_tm_confidence")))
    return d.select("id", reasons.alias("reasons"), (F.size(reasons) > 0).alias("should_interrupt"), F.coalesce("recording_terms", F.array().cast("array<string>")).alias("recording_terms"))
