"""Queries over files: driver tables are written as the corpus and the stores lie on disk, and read back by the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.operators import drafting, evaluation, guards, index, judging, morphology, patterns, terms
from glosswright.plans import bindings as B
from glosswright.session import table, workspace
from glosswright.sources import corpus, stores

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _lines(c):
    return F.array_join(c, "|")


FILE_ROWS = 5000


def _each(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Rows as files of one JSON array each, of about FILE_ROWS rows, as Spark's reader takes one JSON value a file."""
    path = workspace(spark, name)
    key = F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, -(-rows.count() // FILE_ROWS))))
    got = rows.groupBy(key.alias("_f")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    got.write.partitionBy("_f").text(path)
    return path


def _prints(spark, sf_dir):
    p = table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey AS STRING) AS card_id", "CAST(o_orderkey % 97 AS STRING) AS card_set_id", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS flavor")
    return corpus.printings(spark, _each(spark, p, "printings"))


@query
def release_dates(spark, sf_dir):
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 97 AS n").distinct().selectExpr("CAST(n AS STRING) AS id", "CASE WHEN n % 10 = 0 THEN ' ' ELSE CAST(2000 + n AS STRING) || '-01-02' END AS date_release")
    return corpus.earliest_release(_prints(spark, sf_dir), corpus.card_sets(spark, _each(spark, s, "sets")))


@query
def code_cards(spark, sf_dir):
    return corpus.code_to_card(_prints(spark, sf_dir))


@query
def printing_flavor(spark, sf_dir):
    p = _prints(spark, sf_dir)
    k = p.filter("CAST(id AS INT) % 5 <> 0").withColumn("flavor", F.concat(F.lit("글 "), "flavor"))
    return corpus.bilingual_flavor(p, k)


@query
def keyword_codes(spark, sf_dir):
    side = lambda where, words: corpus.legacy_keywords(spark, _each(spark, table(spark, sf_dir, "part").filter(where).selectExpr("CAST(p_partkey AS STRING) AS code", f"{words} AS keywords"), "pack"))
    en, ko = side("p_partkey % 2 = 0", "CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_brand || ' - ' || p_type END"), side("p_partkey % 3 = 0", "p_brand || ' - x'")
    codes = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS code", "CAST(p_size AS STRING) AS card_id")
    out = corpus.bilingual_keywords(en, ko, codes).unionByName(corpus.bilingual_keywords(en, corpus.legacy_keywords(spark, workspace(spark, "absent")), codes))
    return out.select("card_id", _lines("en_keywords").alias("en_keywords"), _lines("ko_keywords").alias("ko_keywords"))


@query
def official_flat(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    paths = {c: _each(spark, n.filter(f"n_nationkey % {i + 2} = 0").selectExpr("lower(n_name) AS id", f"'{c}:' || n_name AS name"), c) for i, c in enumerate(corpus.GLOSSARY_CATEGORIES)}
    return corpus.flat_official(corpus.official_glossary(spark, paths))


@query
def gold_load(spark, sf_dir):
    path = workspace(spark, "gold")
    e = table(spark, sf_dir, "nation").selectExpr("n_name AS en", "array('가', lower(n_name)) AS ko", "CASE WHEN n_regionkey = 0 THEN 'aided' ELSE 'unaided' END AS source", "n_name AS note")
    e.agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.collect_list(F.struct("*")).alias("entries"))).alias("value")).write.text(path)
    return corpus.gold_terms(spark, path).select("en", _lines("ko").alias("ko"), "source", "note")


def _run_file(spark, sf_dir) -> str:
    """One file: a header line, then records, then a broken line and a header that comes too late."""
    path = workspace(spark, "run")
    r = B.records(spark, sf_dir).withColumn("card_id", F.col("card_id").cast("string")).select(F.lit(1).alias("o"), F.to_json(F.struct("card_id", "route", "draft_ko", "interrupted", "empty_cause")).alias("value"))
    extra = spark.createDataFrame([(0, '{"_meta":"run_pipeline_header","run_mode":"real","primary_model_id":"m1","mixed_run":false}'), (2, '{"card_id":'), (3, ""), (4, '{"_meta":"run_pipeline_header","run_mode":"stub"}')], "o int, value string")
    r.unionByName(extra).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


@query
def draft_scan(spark, sf_dir):
    d = stores.draft_records(spark, _run_file(spark, sf_dir))
    return d.groupBy("route", "interrupted").agg(F.count("*").alias("n"), F.count("draft_ko").alias("n_drafts"), F.sum(F.col("card_id").cast("long")).alias("ids"))


@query
def run_header(spark, sf_dir):
    return stores.run_header(spark, _run_file(spark, sf_dir))


@query
def predictions_scan(spark, sf_dir):
    path = workspace(spark, "predictions")
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").selectExpr("CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS value").write.text(path)
    return stores.predictions(spark, path)


@query
def predictions_matched(spark, sf_dir):
    """A file of predictions and one of references, a line for each order, matched by the lines' places."""
    o, got = table(spark, sf_dir, "orders"), []
    for name, value in (("prediction", "CONCAT(o_orderpriority, ' ', o_orderkey)"), ("reference", "CAST(o_orderkey AS STRING)")):
        path = workspace(spark, name)
        o.repartition(1).sortWithinPartitions("o_orderkey", "o_orderpriority").selectExpr(f"{value} AS value").write.text(path)  # one file
        got.append(stores.predictions(spark, path).withColumnRenamed("prediction", name))
    return evaluation.checked_pairs(*got, key="pos").select("pos", "prediction", "reference")


@query
def split_sink(spark, sf_dir):
    path = workspace(spark, "split")
    d = corpus.hash_split(table(spark, sf_dir, "part").select("p_partkey", "p_name"), 100, "p_partkey")
    stores.write_split(d.filter("held").drop("held"), d.filter("not held").drop("held"), path)
    read = lambda side: spark.read.schema("p_partkey long, p_name string").json(f"{path}/{side}").withColumn("side", F.lit(side))
    return read("hold_out").unionByName(read("train"))


def _keywords(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("e"), F.split("p_type", " ").alias("k"))
    return p.withColumn("k", F.when(F.col("id") % 2 == 0, F.concat("k", F.array(F.lit("PLUS")))).otherwise(F.col("k")))


def _conflicts(spark, sf_dir):
    there = lambda c: c.isNotNull()
    brands = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("en_term"), F.col("p_type").alias("ko_term")).distinct()
    return terms.conflicts(terms.keyword_pairs(_keywords(spark, sf_dir), "e", "k", translated=there), "subtype"), terms.conflicts(brands, "rule")


@query
def conflict_union(spark, sf_dir):
    c = terms.all_conflicts(*_conflicts(spark, sf_dir))
    ids = F.aggregate(F.map_values("source_card_ids"), F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return c.select("en_term", _lines("ko_variants").alias("ko_variants"), F.size("source_card_ids").cast("long").alias("n_with_ids"), ids.alias("n_ids"), "source")


@query
def keyword_counts(spark, sf_dir):
    return terms.keyword_counters(_keywords(spark, sf_dir), "e", "k", lambda c: ~c.startswith("P"))


@query
def asset_sink(spark, sf_dir):
    path = workspace(spark, "assets")
    subtype, rule = _conflicts(spark, sf_dir)
    official = table(spark, sf_dir, "nation").selectExpr("lower(n_name) AS id", "n_name AS name")
    found, gold = subtype.select(F.col("en_term").alias("term")), table(spark, sf_dir, "part").selectExpr("split(p_name, ' ')[0] AS term")
    g = stores.glossary_asset(official, subtype, rule, terms.extraction_scores(found, gold))
    found = patterns.extract(B.cards(spark, sf_dir).withColumn("ko_text", F.concat("ko_text", F.lit(". ok"))), least=3)
    stores.write_assets(g, found.select("en_template", "ko_template", "count"), terms.all_conflicts(subtype, rule), path)
    counts = "struct<official:long,subtype_extracted:long,extracted:long,subtype_conflicts_held_back:long,conflicts_held_back:long>"
    r = spark.read.schema(f"official map<string,string>, counts {counts}, subtype_evaluation struct<tp:long,fp:long,fn:long>, llm_judged boolean").json(f"{path}/glossary")
    kept = spark.read.schema("en_template string, ko_template string, count long").json(f"{path}/patterns").agg(F.count("*").alias("n_patterns"), F.sum("count").alias("n_sentences"))
    return r.crossJoin(F.broadcast(kept)).select("n_patterns", "n_sentences", F.col("counts.official").alias("n_official"), F.size("official").cast("long").alias("n_map"), F.col("counts.subtype_extracted").alias("n_subtype"), F.col("counts.extracted").alias("n_extracted"),
                    F.col("counts.subtype_conflicts_held_back").alias("held_subtype"), F.col("counts.conflicts_held_back").alias("held"), "subtype_evaluation.tp", "subtype_evaluation.fp", "subtype_evaluation.fn", "llm_judged")


def _reviewed(spark, sf_dir):
    named = "CASE WHEN p_partkey % 4 = 0 THEN array(named_struct('en', p_brand, 'ko_rendering', ''), named_struct('en', p_type, 'ko_rendering', '')) ELSE array() END AS new_terms"
    q = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey AS card_id", "'text' AS field", "'rule' AS route", "' ' || p_name AS en_text", "p_type || ' ' AS draft_ko", named,
        "CASE WHEN p_partkey % 4 = 0 THEN array(named_struct('guard', 'new_term', 'detail', array(p_brand))) ELSE array(named_struct('guard', 'rule_violation', 'detail', array(p_name))) END AS guard_violations")
    d = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN p_name END AS approved_ko", "CASE WHEN p_partkey % 8 = 0 THEN map(p_brand, p_name) END AS term_renderings")
    return drafting.approved_records(q, d)


def _as_text(d: DataFrame, *columns: str) -> DataFrame:
    return d.withColumns({c: F.col(c).cast("string") for c in columns})


@query
def approved_store(spark, sf_dir):
    """Approvals appended twice to one store and read back."""
    path = workspace(spark, "approved")
    a = _as_text(_reviewed(spark, sf_dir)[0].withColumn("n", F.col("id") % 2), "card_id").drop("new_terms", "id")
    for half in (0, 1):
        stores.append(a.filter(F.col("n") == half).drop("n"), path)
    return stores.read(spark, "approved", path).select("card_id", "field", "en_text", "ko_draft", "approved_ko", "modified", _lines("interrupt_reasons").alias("reasons"))


@query
def new_term_store(spark, sf_dir):
    path = workspace(spark, "new-terms")
    stores.append(_as_text(_reviewed(spark, sf_dir)[1], "source_card_id"), path)
    empty = stores.read(spark, "new_terms", workspace(spark, "absent"))
    return stores.read(spark, "new_terms", path).unionByName(empty).select("en_term", "ko_rendering", "source_card_id", "source_field", "approved_ko_context")


def decide(part):
    return [(e, k, len(e) % 2 == 0, "by length") for e, k in part if not e.startswith("a")]


def _down(part):
    raise RuntimeError("a judged pair was asked for again")


def _picky(part):
    """Fails on some pairs, and so on every chunk that holds one."""
    if any(e.startswith("b") for e, _, _ in part):
        raise RuntimeError("a pair that cannot be judged")
    return [(e, k, s["cooccurrence"] % 2 == 0, "by count") for e, k, s in part if not e.startswith("a")]


@query
def judged_store(spark, sf_dir):
    """Judged with the pairs' scores by a judge that fails on some; what is judged is not asked again, so that one that is
    down changes nothing; then some pairs are judged anew, and their last judgment counts."""
    path = workspace(spark, "judgments")
    c = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("en_term"), F.col("p_type").alias("ko_term")).agg(F.sum("p_size").alias("cooccurrence"))
    judging.judge_and_keep(c, _picky, "now", path, scored=True)
    judging.judge_and_keep(c, _down, "now", path)
    return judging.judge_and_keep(c.filter("cooccurrence % 5 = 0"), decide, "now", path, again=True).select("en_term", "ko_term", "accepted", "reason")


@query
def judged_counts(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_name AS en_term", "p_type AS ko_term").distinct()
    return judging.counters(c, judging.judge(c, decide, "now"))


def shouting(prompt: str) -> tuple[str, str, int]:
    """A stand-in for a model: the card's text in capitals; it fails on steel."""
    text = prompt.rsplit("<card-text>\n", 1)[1].split("\n</card-text>")[0]
    if "steel" in text:
        raise ValueError("no steel")
    return f" {text.upper()} ", "m1", 1


@query
def draft_records(spark, sf_dir):
    f = drafting.expand_fields(B.field_cards(spark, sf_dir))
    h = f.filter("card_id % 3 <> 0").selectExpr("id AS query_id", "CAST(card_id % 2 AS INT) AS rank", "CAST(card_id AS STRING) AS id", "en_text", "field AS ko_text", "1.0D / (1 + card_id % 150) AS score")
    r = drafting.run(f, h, guards.flat_glossary(B.glossary(spark)), shouting)
    path = workspace(spark, "drafts")
    stores.write_run(r.withColumn("card_id", F.col("card_id").cast("string")), spark.createDataFrame([("real", "m1", False)], "run_mode string, primary_model_id string, mixed_run boolean"), path)
    d = spark.read.schema("id string, draft_ko string, model_id string, attempts long, empty_cause string, model_error string, tm_hits array<struct<id:string>>, injected_terms array<struct<en:string>>, tm_confidence double, "
                          "recording_new_terms array<string>, guard_violations array<struct<guard:string>>, interrupted boolean").json(f"{path}/records")  # fmt: skip
    return d.select("id", "draft_ko", "model_id", "empty_cause", "model_error", F.size("tm_hits").cast("long").alias("n_hits"), _lines(F.transform("injected_terms", lambda t: t["en"])).alias("terms"), F.round("tm_confidence", 9).alias("tm_confidence"),
                    _lines("recording_new_terms").alias("recording"), _lines(F.transform("guard_violations", lambda v: v["guard"])).alias("guards"), "interrupted")


@query
def drafts_from_memory(spark, sf_dir):
    """Drafts of all fields whose hits come from an index over the pairs of the conversations."""
    f, pairs = drafting.expand_fields(B.field_cards(spark, sf_dir)), B.pairs(spark, sf_dir)
    memory = index.open_index(spark).build(pairs, "id", "en_text")
    r = drafting.run(f, drafting.remembered(f, memory), guards.flat_glossary(B.glossary(spark)), shouting)
    ids = _lines(F.transform("tm_hits", lambda h: h["id"]))
    return r.select("id", "draft_ko", ids.alias("hits"), F.md5(_lines(F.transform("tm_hits", lambda h: h["ko_text"]))).alias("targets"), F.round("tm_confidence", 9).alias("tm_confidence"))


@query
def model_counters(spark, sf_dir):
    f = drafting.expand_fields(B.field_cards(spark, sf_dir)).selectExpr("id", "'<card-text>\n' || en_text || '\n</card-text>' AS prompt")
    return evaluation.run_counters(drafting.draft(f, shouting)).select(F.coalesce("model_id", F.lit("")).alias("model_id"), "n", "succeeded", "failed")


def refusing(n: int):
    """A stand-in for a model: the card's text as it is; it fails on lengths that n divides."""

    def model(prompt: str) -> str:
        text = prompt.rsplit("<card-text>\n", 1)[1].split("\n</card-text>")[0]
        if len(text) % n == 0:
            raise ValueError("refused")
        return text

    return model


@query
def fallback_counters(spark, sf_dir):
    """Which model of a chain answered, when the first fails on lengths that 2 divides and the second on those that 3 divides."""
    f = drafting.expand_fields(B.field_cards(spark, sf_dir)).selectExpr("id", "'<card-text>\n' || en_text || '\n</card-text>' AS prompt")
    chain = drafting.with_fallback([("m1", refusing(2)), ("m2", refusing(3))], tries=2, wait=0.0)
    return evaluation.run_counters(drafting.draft(f, chain)).select(F.coalesce("model_id", F.lit("")).alias("model_id"), "n", "succeeded", "failed")


@query
def observation_scores(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS en_text", "p_type AS ko_text", "CASE WHEN p_size % 2 = 0 THEN p_brand END AS ko_flavor", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS flavor_ko")
    return judging.observe(c, lambda en, ko: 1 + (len(en) + len(ko)) % 3, lambda ko: 1 + len(ko) % 3)


@query
def scoring_view(spark, sf_dir):
    """Of a glossary with an entry for each part, what scoring compares."""
    own = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'official' ELSE 'extracted' END AS section", "concat(p_brand, '_', p_size) AS en", "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE concat('카드 ', p_type) END AS ko")
    return evaluation.scoring_view(guards.flat_glossary(B.glossary(spark).select("section", "en", "ko").unionByName(own))).select("en", "ko", "source")


def tagger(word: str) -> list[tuple[str, str]]:
    """A stand-in for an analyser: letters are nouns, but verbs in -en and particles of two letters; digits are numbers."""
    import re

    kind = lambda w: "SN" if w.isdigit() else "JX" if len(w) == 2 else "VV-I" if w.endswith("en") else "NNG"
    return [(w, kind(w)) for w in re.findall(r"[a-zA-Z]+|[0-9]+", word)]


@query
def morphology_terms(spark, sf_dir):
    t = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "coalesce(text, '') AS text")
    n = morphology.normalised(t, "text", tagger)
    return n.select("id", F.size("norm_tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("norm_tokens", " ")).alias("tokens"))


@query
def normalised_candidates(spark, sf_dir):
    """Term candidates whose target side is in dictionary form."""
    p = B.pairs(spark, sf_dir)
    both = p.select("id", "en_text").join(morphology.normalised(p, "ko_text", tagger), "id")
    c = terms.candidates(both, target_col="norm_tokens")
    return c.select("en_term", "ko_term", "cooccurrence", F.round("dice", 9).alias("dice"), F.round("pmi", 9).alias("pmi"))


@query
def morphology_gold(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name || ' [credit]en (ABC) 12' AS term")
    return morphology.normalised_terms(t, "term", tagger).select("id", "norm")


@query
def matched_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS prediction")
    return evaluation.checked_pairs(p, table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_type AS reference")).select("id", "prediction", "reference")


@query
def record_references(spark, sf_dir):
    c = table(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").selectExpr("p_partkey AS id", "p_type || '  x' AS ko_text", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS ko_flavor")
    return evaluation.with_references(B.records(spark, sf_dir), c).select("card_id", "field", "route", "ref_ko")


@query
def per_model_gates(spark, sf_dir):
    cards = B.cards(spark, sf_dir)
    r = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_size % 4 < 3 THEN 'm' || CAST(p_size % 4 AS STRING) END AS model_id", "p_partkey AS card_id", "p_name AS draft_ko", "CASE WHEN p_partkey % 9 = 0 THEN ' ' || p_name WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS top_hit")
    g = evaluation.symbol_differences(cards).join(evaluation.card_compliance(cards, guards.flat_glossary(B.glossary(spark))), "id", "left")
    g = g.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(T.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 9).alias("distance")), "id").withColumnRenamed("id", "card_id")
    return evaluation.per_model(r, g).withColumns({c: F.round(c, 9) for c in ("preservation", "compliance", "median_distance", "echo_rate")})


@query
def seeded_split(spark, sf_dir):
    """The exact shuffle of the standard library, over the ordered ids of a curated corpus."""
    c = table(spark, sf_dir, "supplier").selectExpr("s_name AS id", "CAST(s_nationkey AS STRING) AS date")
    held, train = corpus.seeded_split(c, 5)
    return held.select("id", F.lit(True).alias("held")).unionByName(train.select("id", F.lit(False).alias("held")))


@query
def corpus_head(spark, sf_dir):
    c = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date")
    return corpus.head(c, 50)


@query
def hangul_flags(spark, sf_dir):
    c = B.cards(spark, sf_dir).withColumn("ko_text", F.when(F.col("id") % 5 == 0, F.lit("plain")).when(F.col("id") % 5 == 1, F.lit(None)).otherwise(F.col("ko_text")))
    return corpus.translated_only(c, "ko_text").select("id", T.condition_count(F.col("en_text")).cast("long").alias("n_conditions"), T.has_target_condition(F.col("ko_text")).alias("ko_condition"), _lines(T.guard_symbols(F.col("en_text"))).alias("symbols"))


@query
def lookup_response(spark, sf_dir):
    """The service's answer for every word of every item."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "en"))
    asked = words.select(F.struct(F.col("item_id").alias("id"), "pos").alias("id"), "en")
    body = drafting.response(drafting.lookup_terms(asked, guards.flat_glossary(B.glossary(spark))).select("id", "key", "found", "ko"))
    return body.select("id.id", F.col("id.pos").cast("long").alias("pos"), F.get_json_object("body", "$.key").alias("key"), F.get_json_object("body", "$.found").alias("found"), F.get_json_object("body", "$.ko").alias("ko"))


@query
def search_tm(spark, sf_dir):
    """Three signals fused, with each signal's own rank; a document's or an item's vector is the one with its id."""
    docs, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = B.questions(spark, sf_dir).join(v.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    ix = index.open_index(spark).build(docs, vectors=v.withColumnRenamed("vec_id", "doc_id"))
    return ix.search(q, 5).select("query_id", "doc_id", "score", "rank", "bm25_rank", "char_rank", "dense_rank")
