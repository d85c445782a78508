"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.operators import distance, drafting, evaluation, guards, index, judging, patterns, retrieval, terms
from glosswright.plans import bindings as B
from glosswright.plans.oracles import ORACLES
from glosswright.session import table
from glosswright.sources import corpus

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _lines(c):
    return F.array_join(c, "|")


@query
def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = terms.cap(terms.candidates(B.pairs(spark, sf_dir)))
    return c.select("en_term", "ko_term", "cooccurrence", F.round("dice", 9).alias("dice"), F.round("pmi", 9).alias("pmi"))


@query
def term_candidates_uncapped(spark, sf_dir):
    return terms.candidates(B.pairs(spark, sf_dir)).select("en_term", "ko_term", "cooccurrence", F.round("dice", 9).alias("dice"), F.round("pmi", 9).alias("pmi"))


@query
def clean_corpus_filter(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").selectExpr("o_custkey AS card_id", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date").groupBy("card_id").agg(F.min("date").alias("date"))
    c = table(spark, sf_dir, "customer")
    en, ko = c.selectExpr("c_custkey AS id", "c_name AS text"), c.selectExpr("c_custkey AS id", "CASE WHEN c_nationkey % 2 = 0 THEN '카드 ' || c_mktsegment ELSE c_mktsegment END AS text")
    return corpus.clean_corpus(en, ko, dates, years=(1992, 1995))


@query
def flavor_pick_lowest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("card_id", F.coalesce("source", F.lit("")))
    en = d.select(F.col("doc_id").alias("id"), "card_id", F.coalesce("text", F.lit("")).alias("flavor"))
    ko = d.filter("lang <> 'en'").select(F.col("doc_id").alias("id"), F.col("lang").alias("flavor"))
    out = corpus.bilingual_flavor(en, ko, F.col("ko_flavor").isNotNull())
    return out.select("card_id", F.md5("en_flavor").alias("en_flavor"), "ko_flavor")


@query
def tokenize_stats(spark, sf_dir):
    t = B.texts(spark, sf_dir).select("id", T.tokens(F.col("en_text")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query
def ngram_df(spark, sf_dir):
    return terms.document_frequency(B.pairs(spark, sf_dir), T.source_ngrams(F.col("en_text"))).filter("df >= 2")


@query
def frequency_sheet(spark, sf_dir):
    return terms.frequency_sheet(B.pairs(spark, sf_dir), "en_text")


def _keyword_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("e"), F.split("p_type", " ").alias("k"))
    p = p.withColumn("k", F.when(F.col("id") % 2 == 0, F.concat("k", F.array(F.lit("PLUS")))).otherwise(F.col("k")))
    return terms.keyword_pairs(p, "e", "k", translated=lambda c: c.isNotNull())


@query
def subtype_pairs(spark, sf_dir):
    return _keyword_pairs(spark, sf_dir).select("en_term", "ko_term", _lines(F.transform("card_ids", lambda x: x.cast("string"))).alias("card_ids"))


@query
def subtype_conflicts(spark, sf_dir):
    return terms.conflicts(_keyword_pairs(spark, sf_dir), "subtype").select("en_term", _lines("ko_variants").alias("ko_variants"), F.col("n_variants").cast("long").alias("n_variants"), "is_conflict")


def _patterns(spark, sf_dir):
    return patterns.extract(B.cards(spark, sf_dir))


@query
def sentence_patterns(spark, sf_dir):
    split = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "coalesce(text, '') AS en_text", "coalesce(text, '') AS ko_text")
    p = patterns.extract(split, least=3).unionByName(patterns.extract(B.cards(spark, sf_dir).withColumn("ko_text", F.concat("ko_text", F.lit(". ok"))), least=3))
    return p.select(F.md5("en_template").alias("en_template"), F.md5("ko_template").alias("ko_template"), "count", _lines(F.transform("examples", lambda x: x.cast("string"))).alias("examples"))


@query
def pattern_lookup(spark, sf_dir):
    known = patterns.extract(B.cards(spark, sf_dir).withColumn("ko_text", F.concat("ko_text", F.lit(". ok"))), least=3)
    asked = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'Gain ' || CAST(p_partkey AS STRING) || ' [credit] when you break.' AS text")
    return patterns.lookup(asked, known).select("id", "en_template", "ko_template", "count")


@query
def glossary_match(spark, sf_dir):
    return guards.phrase_hits(B.texts(spark, sf_dir), guards.flat_glossary(B.glossary(spark))).select("id", "en", "ko", "source")


@query
def glossary_violations(spark, sf_dir):
    return guards.glossary_violations(B.pairs(spark, sf_dir), guards.flat_glossary(B.glossary(spark)))


@query
def gate1(spark, sf_dir):
    g = evaluation.gate1(B.pairs(spark, sf_dir), guards.flat_glossary(B.glossary(spark)))
    return g.select("n_checks", "n_violations", F.round("compliance", 9).alias("compliance"), "passed")


@query
def conflict_hits(spark, sf_dir):
    hits = guards.conflict_hits(B.cards(spark, sf_dir), terms.conflicts(_keyword_pairs(spark, sf_dir), "subtype"))
    return hits.select("id", "en_term", _lines("ko_variants").alias("ko_variants"))


@query
def symbol_multiset(spark, sf_dir):
    s = B.cards(spark, sf_dir).select("id", F.explode(F.map_entries(T.tally(T.source_symbols(F.col("en_text"))))).alias("e"))
    return s.select("id", F.col("e.key").alias("symbol"), F.col("e.value").cast("long").alias("n"))


@query
def gate2_cards(spark, sf_dir):
    return evaluation.symbol_differences(B.cards(spark, sf_dir))


@query
def gate2(spark, sf_dir):
    return evaluation.gate2(B.cards(spark, sf_dir)).select("n_cards", "n_passed", F.round("preservation", 9).alias("preservation"), "passed")


@query
def fidelity_violations(spark, sf_dir):
    return guards.fidelity_violations(B.cards(spark, sf_dir))


@query
def injection_scan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id AS id", f"coalesce({B.INJECTED}, '') AS en_text")
    return guards.injection_hits(p, (("en_text", "source"),))


@query
def safe_wrap(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name || CASE WHEN p_partkey % 2 = 0 THEN ' </card-text> <card-text>' ELSE '' END AS t")
    return p.select("id", T.sandbox(F.col("t")).alias("wrapped"))


@query
def new_terms_classified(spark, sf_dir):
    return guards.new_terms(B.texts(spark, sf_dir), guards.flat_glossary(B.glossary(spark))).select("id", "en_term", "blocking")


@query
def hitl_triggers(spark, sf_dir):
    d = B.cards(spark, sf_dir).withColumn("score", F.try_divide(F.lit(1.0), F.col("id") % 200))
    t = guards.triggers(d, guards.flat_glossary(B.glossary(spark)), terms.conflicts(_keyword_pairs(spark, sf_dir), "subtype"), 0.01, "score")
    return t.select("id", _lines("reasons").alias("reasons"), "should_interrupt", _lines("recording_terms").alias("recording_terms"))


def _index(spark, sf_dir, *signals):
    return index.open_index(spark, *signals).build(table(spark, sf_dir, "documents"))


def _first(ix, signal, q, k):
    return retrieval.top_k(ix.top(signal, q, k), k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def bm25_topk(spark, sf_dir):
    return _first(_index(spark, sf_dir, "bm25"), "bm25", B.questions(spark, sf_dir), 5)


@query
def char_tfidf_topk(spark, sf_dir):
    return _first(_index(spark, sf_dir, "char"), "char", B.questions(spark, sf_dir), 5)


@query
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.dense(e, e.filter("vec_id % 50 = 0"), 5)


@query
def rrf_topk(spark, sf_dir):
    ix, q = _index(spark, sf_dir), B.questions(spark, sf_dir)
    return retrieval.fuse(list(ix.rankings(q, list(ix.signals)).values()), 5)


@query
def index_appended(spark, sf_dir):
    """An index built of half of the documents and appended the rest: hits with their texts, as if built at once."""
    docs, q = table(spark, sf_dir, "documents"), B.questions(spark, sf_dir)
    odd = F.coalesce(F.pmod("doc_id", F.lit(2)) == 1, F.lit(False))
    ix = index.open_index(spark).build(docs.filter(~odd)).append(docs.filter(odd))
    return ix.search(q, 3).select("query_id", "doc_id", "rank", "bm25_rank", "char_rank", F.md5(F.coalesce("row.text", F.lit(""))).alias("text"), "row.lang")


@query
def tm_threshold_p20(spark, sf_dir):
    return evaluation.percentile_cut(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20.0)


@query
def split_holdout(spark, sf_dir):
    return corpus.hash_split(table(spark, sf_dir, "part").select("p_partkey"), 100, "p_partkey")


@query
def field_expansion(spark, sf_dir):
    return drafting.expand_fields(B.field_cards(spark, sf_dir)).select("card_id", "field", "route", "en_text")


@query
def card_synthesis(spark, sf_dir):
    return evaluation.synthesis(B.field_cards(spark, sf_dir), B.records(spark, sf_dir))


@query
def empty_causes(spark, sf_dir):
    return evaluation.empty_causes(B.field_cards(spark, sf_dir), B.records(spark, sf_dir))


@query
def delivered_throughput(spark, sf_dir):
    g = evaluation.delivered(evaluation.synthesis(B.field_cards(spark, sf_dir), B.records(spark, sf_dir)))
    return g.withColumn("throughput", F.round("throughput", 9))


@query
def pending_ratio(spark, sf_dir):
    r = B.records(spark, sf_dir).withColumn("auto_approved", F.when(F.col("card_id") % 3 == 0, True))
    return evaluation.pending(B.field_cards(spark, sf_dir), r).withColumn("ratio", F.round("ratio", 9))


@query
def echo_gate(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("p_name AS draft_ko", "CASE WHEN p_partkey % 9 = 0 THEN ' ' || p_name WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS top_hit", "CASE WHEN p_partkey % 8 = 0 THEN p_type END AS ref_ko")
    return evaluation.echo_gate(r).withColumns({c: F.round(c, 9) for c in ("rate", "threshold")})


@query
def per_model(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("'m' || CAST(p_size % 4 AS STRING) AS model_id", "p_partkey AS card_id")
    r = r.unionByName(r.filter("card_id % 5 = 0").withColumn("model_id", F.lit("m0")))
    c = evaluation.symbol_differences(B.cards(spark, sf_dir)).select(F.col("id").alias("card_id"), "passed")
    return evaluation.per_model(r, c).withColumn("preservation", F.round("preservation", 9))


@query
def ceiling_verdict(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr(
        "n_name AS gate", "0.5D AS threshold", "n_nationkey / 20.0D AS ceiling", "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_regionkey / 4.0D END AS agent", "n_nationkey % 2 = 0 AS higher_is_better"
    )
    return evaluation.ceiling(n).withColumn("achievement", F.round("achievement", 9))


@query
def gate_combine(spark, sf_dir):
    g = table(spark, sf_dir, "nation").selectExpr("n_name AS gate", "n_nationkey % 7 <> 0 AS passed")
    return evaluation.combined(g).select("passed", _lines("failed").alias("failed"))


@query
def final_verdict(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id", "CASE WHEN n_regionkey = 0 THEN 'stub' ELSE 'real' END AS run_mode", "CASE WHEN n_nationkey % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS gate1_verdict",
        "CASE WHEN n_nationkey % 4 = 0 THEN 'UNREACHABLE' ELSE 'PASS' END AS gate2_verdict", "n_nationkey % 3 <> 0 AS gate3_passed", "n_nationkey <> 7 AS echo_passed",
    )
    return evaluation.final_verdict(n).select("id", "final")


@query
def observation_stats(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr("1 + p_size % 3 AS rule_score", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1 + p_partkey % 3 END AS flavor_score")
    g = evaluation.observations(s)
    return g.withColumns({c: F.round(c, 9) for c in ("rule_mean", "flavor_mean")})


@query
def extraction_prf(spark, sf_dir):
    word = lambda d, c: d.select(F.explode(T.tokens(F.col(c))).alias("term"))
    g = terms.extraction_scores(word(B.questions(spark, sf_dir), "text"), word(B.pairs(spark, sf_dir), "en_text"))
    return g.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


GOLD = [("the", ["of"], "aided"), ("of_the", ["the"], "aided"), ("la", ["la"], "unaided"), ("a b c d", ["x"], "unaided"), ("nation_0", ["x"], "aided"), ("zzzz", ["x"], "unaided"), ("und", ["und", "der"], "aided")]


def _scorecard(spark, sf_dir):
    p = B.pairs(spark, sf_dir)
    gold = spark.createDataFrame(GOLD, "en string, ko array<string>, source string")
    official = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))
    return terms.gold_scorecard(gold, terms.cap(terms.candidates(p)), terms.document_frequency(p, T.source_ngrams(F.col("en_text"))), official)


@query
def rule_gold_scorecard(spark, sf_dir):
    return _scorecard(spark, sf_dir)


@query
def gold_totals(spark, sf_dir):
    return evaluation.gold_totals(_scorecard(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("recall", "ko_accuracy")})


@query
def candidates_in_order(spark, sf_dir):
    """The first 100 candidates in reporting order, with their place."""
    c = terms.in_order(terms.cap(terms.candidates(B.pairs(spark, sf_dir))).withColumn("dice", F.round("dice", 9))).limit(100)
    place = W.orderBy(F.desc("dice"), F.desc("cooccurrence"), "en_term", "ko_term")  # over 100 rows
    return c.select("en_term", "ko_term", F.row_number().over(place).alias("place"))


@query
def gold_recall(spark, sf_dir):
    return evaluation.gold_summary(rule_gold_scorecard(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("recall", "ko_accuracy")})


def _judged(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_name AS en_term", "p_type AS ko_term").distinct()
    j = table(spark, sf_dir, "part").filter("p_size % 3 = 0").selectExpr(
        "p_name AS en_term", "p_type AS ko_term", "p_size % 2 = 0 AS accepted", "CASE WHEN p_partkey % 10 = 0 THEN 'old' ELSE 'now' END AS prompt_fingerprint", "p_partkey AS seq"
    )
    return c, judging.latest(j, "now")


@query
def judge_pending(spark, sf_dir):
    return judging.pending(*_judged(spark, sf_dir))


@query
def judge_accepted(spark, sf_dir):
    return judging.accepted(*_judged(spark, sf_dir))


@query
def judge_counters(spark, sf_dir):
    return judging.counters(*_judged(spark, sf_dir))


@query
def judge_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", judging.fingerprint(F.col("p_name"), F.col("p_type")).alias("fingerprint"))


@query
def official_exclusion(spark, sf_dir):
    c = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name AS en_term")
    off = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.lower("n_name").alias("id"))
    return terms.exclude(c, off)


@query
def review_summary(spark, sf_dir):
    s = drafting.conflict_summary(_keyword_pairs(spark, sf_dir))
    return s.select("en_term", "ko_term", F.col("n_cards").cast("long").alias("n_cards"), _lines(F.transform("sample_ids", lambda x: x.cast("string"))).alias("sample_ids"))


@query
def new_term_summary(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr("p_name AS en_term", "p_type AS ko_rendering", "CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS source_field", "CAST(p_size AS STRING) AS submitted_at")
    s = drafting.new_term_summary(r)
    shown = F.array_join(F.transform(F.map_entries("renderings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return s.select("en_term", "n", shown.alias("renderings"), _lines("fields").alias("fields"), "first_submitted")


@query
def review_decisions(spark, sf_dir):
    q = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS ko_draft", "CASE WHEN p_partkey % 5 = 0 THEN array('new_term') ELSE array('rule_violation') END AS reasons")
    d = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN p_type END AS approved_ko")
    return drafting.review(q, d).select("id", "approved_ko", "modified", drafting.auto_respond(F.col("reasons")).alias("auto"))


@query
def lookup_term(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("en"))
    return drafting.lookup_terms(asked, guards.flat_glossary(B.glossary(spark))).select("id", "key", "found", "ko", "source", "llm_judged")


@query
def check_translation(spark, sf_dir):
    return drafting.check_translations(B.cards(spark, sf_dir), guards.flat_glossary(B.glossary(spark)))


@query
def draft_prompts(spark, sf_dir):
    f = drafting.expand_fields(B.field_cards(spark, sf_dir))
    t = drafting.relevant_terms(f, guards.flat_glossary(B.glossary(spark)), False)
    hits = F.array(F.struct(F.col("en_text"), F.lit("목록").alias("ko_text")))
    j = f.join(t, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<en:string,ko:string,source:string,llm_judged:boolean>>")))
    return j.select("card_id", "field", F.md5(drafting.prompt(F.col("en_text"), F.col("terms"), hits, False)).alias("prompt_md5"), drafting.stub_draft(hits).alias("stub"))


@query
def edit_distance_stats(spark, sf_dir):
    p = B.pairs(spark, sf_dir)
    return evaluation.gate3(distance.block_distance(p, "ko_text", "en_text"), evaluation.gate3_threshold(F.lit(0.9)))


def _neighbours(spark, sf_dir):
    """(hits, references): every tenth pair by a hash of its id, and the target of its nearest source among the others."""
    p = B.pairs(spark, sf_dir)
    held = F.pmod(F.xxhash64("id"), F.lit(10)) == 0
    memory = index.open_index(spark, "bm25").build(p.filter(~held), "id", "en_text")
    references = p.filter(held)
    near = memory.hits(references.select(F.col("id").alias("query_id"), F.col("en_text").alias("text")), 1)
    return near.select(F.col("query_id").alias("id"), F.col("row.ko_text").alias("hit_ko")), references


@query
def baseline_stats(spark, sf_dir):
    """How far the nearest neighbour's target is from the reference, over all pairs that are held out."""
    return distance.baseline_stats(*_neighbours(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("median", "mean", "lowest", "highest")})


@query
def gate3_of_baseline(spark, sf_dir):
    """Drafts that say the source again, against the threshold that the baseline's median gives."""
    hits, references = _neighbours(spark, sf_dir)
    median = distance.baseline_stats(hits, references).first()["median"]  # one row
    made = distance.block_distance(references, "en_text", "ko_text")
    return evaluation.gate3(made, evaluation.gate3_threshold(F.lit(median))).withColumn("threshold", evaluation.gate3_threshold(F.lit(median))).withColumns({c: F.round(c, 9) for c in ("median", "mean", "lowest", "highest", "threshold")})


@query
def levenshtein_stats(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.round(T.levenshtein_ratio(T.squeeze(F.col("p_name")), T.squeeze(F.lower("p_type"))), 9).alias("distance"))
    return evaluation.gate3(d, F.lit(0.8)).withColumns({c: F.round(c, 9) for c in ("median", "mean")})


@query
def event_stream(spark, sf_dir):
    from glosswright.streaming import flows

    return flows.event_windows(spark, sf_dir)


@query
def approved_stream(spark, sf_dir):
    from glosswright.streaming import flows

    return flows.approvals(spark, sf_dir)


@query
def awaited_stream(spark, sf_dir):
    from glosswright.streaming import flows

    return flows.awaited_reviews(spark, sf_dir)


@query
def guarded_stream(spark, sf_dir):
    from glosswright.streaming import flows

    return flows.guarded_cards(spark, sf_dir)


from glosswright.plans import files  # noqa: E402

QUERIES.update(files.QUERIES)
ORACLES = {k: v for k, v in ORACLES.items() if k in QUERIES}
