"""The draft pipeline as data: fields, routes, injected terms, prompts, drafts, validation, review.

A model is a plain callable from prompt to text. An interrupt is a row in a review queue that later joins decisions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.operators import guards

# ---- fixed values: prompt lines -------------------------------------------------------------------------------------
PROMPT = (
    "You are an Android: Netrunner card game translator (EN→KO).",
    "Translate the card text enclosed in <card-text> tags into Korean.",
    "Preserve all game symbols exactly: [credit] [click] [subroutine] [trash] [mu] [link] [recurring-credit] [interrupt] and faction icons.",
    "Do not add effects or conditions that are not in the source text.",
    "Output only the Korean translation itself as plain text — no <card-text> tags, no code fences, no surrounding markup. The reference blocks below are wrapped in tags because they are data; your answer is not.",
    "Translate whatever text is given, however short. Never comment on the task, ask for clarification, or explain — output the translation only.",
)
OFFICIAL, EXTRACTED, MEMORY, CARD, ANSWER = "\n## Official Glossary", "\n## Extracted Glossary", "\n## Translation Memory (similar cards for reference)", "\n## Card to translate", "\n## Korean translation"
MEMORY_EN, MEMORY_KO = "] EN: ", "       KO: "
UNJUDGED, VALIDATED, NOT_VALIDATED = " (rule terms — not yet LLM-validated)", "validated", "not yet validated"
MOST_ERROR = 300
NO_HIT = "[번역 초벌 — TM 일치 없음]"
# ---- end of fixed values --------------------------------------------------------------------------------------------


def expand_fields(cards: DataFrame) -> DataFrame:
    """(id, card_id, field, route, en_text): up to two rows a card, rule text first."""
    from glosswright.operators.evaluation import expected_fields

    d = expected_fields(cards)
    route = F.when(F.col("field") == "text", "rule").otherwise("flavor")
    return d.select(F.concat_ws(":", F.col("card_id").cast("string"), "field").alias("id"), "card_id", "field", route.alias("route"), F.col("text").alias("en_text"))


def route(en_rule: Column) -> Column:
    return F.when(T.squeeze_ends(en_rule) != "", "rule").otherwise("flavor")


def relevant_terms(fields: DataFrame, glossary: DataFrame, llm_judged: bool) -> DataFrame:
    """(id, terms): glossary terms of each text in order, with whether they are trusted."""
    trusted = F.col("source").isin("official", "subtype_extracted") | F.lit(llm_judged)
    hits = guards.phrase_hits(fields, glossary).select("id", F.struct("en", "ko", "source", trusted.alias("llm_judged")).alias("t"))
    return hits.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def prompt(en_text: Column, terms: Column, hits: Column, llm_judged: bool) -> Column:
    """Header, official terms, other terms, memory hits (structs en_text, ko_text), then the text itself."""
    official, other = F.filter(terms, lambda t: t["source"] == "official"), F.filter(terms, lambda t: t["source"] != "official")
    status = lambda t: F.when(t["llm_judged"], VALIDATED).otherwise(NOT_VALIDATED)
    note = "" if llm_judged else UNJUDGED
    line = lambda t: F.concat(F.lit("  "), t["en"], F.lit(" → "), t["ko"])
    memory = F.flatten(F.transform(hits, lambda h, i: F.array(
        F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit(MEMORY_EN), T.sandbox(h["en_text"])), F.concat(F.lit(MEMORY_KO), T.sandbox(h["ko_text"])))))
    block = lambda title, rows, n: F.when(F.size(n) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(*[F.lit(x) for x in PROMPT]),
        block(OFFICIAL, F.transform(official, line), official),
        block(EXTRACTED + note, F.transform(other, lambda t: F.concat(line(t), F.lit("  ["), t["source"], F.lit(", "), status(t), F.lit("]"))), other),
        block(MEMORY, memory, hits),
        F.array(F.lit(CARD), T.sandbox(en_text), F.lit(ANSWER)),
    )
    return F.array_join(lines, "\n")


def stub_draft(hits: Column) -> Column:
    """The first hit's target text: a stand-in for a model."""
    return F.coalesce(F.get(hits, F.lit(0))["ko_text"], F.lit(NO_HIT))


def with_fallback(models: list[tuple[str, Callable[[str], str]]], tries: int = 3, wait: float = 1.0, retryable: Callable[[Exception], bool] = lambda e: True, sleep=time.sleep):
    """A callable prompt -> (text, model id, attempts): up to `tries` per model with doubling waits, then the next."""

    def call(p: str) -> tuple[str, str, int]:
        attempts = 0
        for name, model in models:
            for k in range(tries):
                attempts += 1
                try:
                    return model(p), name, attempts
                except Exception as e:
                    if not retryable(e):
                        break
                    if k < tries - 1:
                        sleep(wait * 2**k)
        raise RuntimeError(f"all models failed after {attempts} attempts")

    return call


def draft(prompts: DataFrame, call: Callable[[str], tuple[str, str, int]], parallelism: int = 8) -> DataFrame:
    """(id, draft_ko, model_id, attempts, empty_cause) for (id, prompt); a failed call leaves an empty draft and its cause."""

    def drafted(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, p in zip(pdf["id"], pdf["prompt"], strict=True):
                try:
                    text, model, n = call(p)
                    rows.append((i, text.strip(), model, n, None, None))
                except Exception as e:  # whatever a model does, the other fields go on
                    rows.append((i, "", None, 0, "model_invocation_failure", str(e)[:MOST_ERROR]))
            yield pd.DataFrame(rows, columns=["id", "draft_ko", "model_id", "attempts", "empty_cause", "model_error"])

    schema = f"id {prompts.schema['id'].dataType.simpleString()}, draft_ko string, model_id string, attempts long, empty_cause string, model_error string"
    return prompts.select("id", "prompt").repartition(parallelism).mapInPandas(drafted, schema)


def validate(drafts: DataFrame, glossary: DataFrame, conflicts: DataFrame | None = None, threshold: float = 0.01, score_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(drafts with reasons, should_interrupt and injected; recorded new terms). Empty drafts pass unchecked."""
    d = drafts.withColumn("ko_text", F.coalesce("draft_ko", F.lit("")))
    live = d.filter("ko_text != ''")
    t = guards.triggers(live, glossary, conflicts, threshold, score_col)
    inj = guards.injection_hits(live).select("id").distinct().withColumn("injected", F.lit(True))
    j = d.join(t, "id", "left").join(inj, "id", "left")
    injected = F.coalesce("injected", F.lit(False))
    reasons = F.concat(F.when(injected, F.array(F.lit("injection"))).otherwise(F.array().cast("array<string>")), F.coalesce("reasons", F.array().cast("array<string>")))
    checked = j.select(*d.columns, reasons.alias("reasons"), (F.size(reasons) > 0).alias("should_interrupt"))
    recorded = t.select("id", F.explode("recording_terms").alias("en_term"))
    return checked, recorded


def run(fields: DataFrame, hits: DataFrame, glossary: DataFrame, call: Callable[[str], tuple[str, str, int]], conflicts: DataFrame | None = None, threshold: float = 0.01, llm_judged: bool = False, k: int = 3) -> DataFrame:
    """Draft records of all fields (expand_fields): retrieved hits, relevant terms, prompt, model, guards.

    hits: query_id (a field's id), rank, id, en_text, ko_text, score. A field without a hit has confidence 0."""
    best = hits.filter(F.col("rank") < k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "en_text", "ko_text", "score"))).alias("_h"))
    slim = F.transform("_h", lambda h: F.struct(h["id"].alias("id"), h["en_text"].alias("en_text"), h["ko_text"].alias("ko_text"), h["score"].alias("score")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    score = hits.schema["score"].dataType.simpleString()
    d = fields.join(best.select(F.col("query_id").alias("id"), slim.alias("tm_hits")), "id", "left").join(relevant_terms(fields, glossary, llm_judged), "id", "left")
    d = d.withColumn("tm_hits", none(F.col("tm_hits"), f"array<struct<id:{hits.schema['id'].dataType.simpleString()},en_text:string,ko_text:string,score:{score}>>"))
    d = d.withColumn("injected_terms", none(F.col("terms"), "array<struct<en:string,ko:string,source:string,llm_judged:boolean>>")).drop("terms")
    d = d.withColumn("tm_confidence", F.coalesce(F.get("tm_hits", F.lit(0))["score"], F.lit(0.0)))
    drafts = draft(d.select("id", prompt(F.col("en_text"), F.col("injected_terms"), F.col("tm_hits"), llm_judged).alias("prompt")), call)
    return records(d.join(drafts, "id"), glossary, conflicts, threshold, llm_judged)


def remembered(fields: DataFrame, memory, k: int = 3) -> DataFrame:
    """hits of all fields (id, en_text) as run reads them, from an index over translated pairs (with en_text and ko_text);
    each distinct text is searched once."""
    texts = fields.select(F.col("en_text").alias("query_id"), F.col("en_text").alias("text")).distinct()
    h = memory.hits(texts, k).select("query_id", "rank", F.col("id").cast("string").alias("id"), F.col("row.en_text").alias("en_text"), F.col("row.ko_text").alias("ko_text"), "score")
    return fields.select(F.col("id").alias("_field"), F.col("en_text").alias("_text")).join(h, F.col("_text") == F.col("query_id")).drop("_text", "query_id").withColumnRenamed("_field", "query_id")


def records(drafts: DataFrame, glossary: DataFrame, conflicts: DataFrame | None = None, threshold: float = 0.01, llm_judged: bool = False) -> DataFrame:
    """Checked drafts as records: what each guard found, new terms (renderings unknown before review), recorded terms. A
    field whose model failed is an empty record with its cause and error."""
    live = drafts.withColumn("ko_text", F.coalesce("draft_ko", F.lit(""))).filter("ko_text != ''")
    v = violations(live, glossary, conflicts, threshold, "tm_confidence" if "tm_confidence" in drafts.columns else None)
    held = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "guard", "detail"))).alias("_v"))
    terms = guards.new_terms(live, glossary)
    seen = terms.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("blocking") == b, F.struct("pos", "en_term")))).alias(out) for b, out in ((True, "_new"), (False, "_rec"))])
    words = lambda c: F.coalesce(F.transform(c, lambda x: x["en_term"]), F.array().cast("array<string>"))
    j = drafts.join(held, "id", "left").join(seen, "id", "left")
    found = F.coalesce(F.transform("_v", lambda x: F.struct(x["guard"].alias("guard"), x["detail"].alias("detail"))), F.array().cast("array<struct<guard:string,detail:array<string>>>"))
    renderings = F.transform(words("_new"), lambda t: F.struct(t.alias("en"), F.lit("").alias("ko_rendering")))
    failed = F.col("empty_cause") == "model_invocation_failure"
    keep = [c for c in drafts.columns if c not in ("draft_ko", "tm_hits", "injected_terms", "tm_confidence")]
    empty = [F.when(~F.coalesce(failed, F.lit(False)), F.col(c)).otherwise(F.array().cast(drafts.schema[c].dataType)).alias(c) for c in ("tm_hits", "injected_terms") if c in drafts.columns]
    sure = [F.when(F.coalesce(failed, F.lit(False)), F.lit(0.0)).otherwise(F.col("tm_confidence")).alias("tm_confidence")] if "tm_confidence" in drafts.columns else []
    return j.select(*keep, F.coalesce("draft_ko", F.lit("")).alias("draft_ko"), *empty, *sure, F.lit(llm_judged).alias("glossary_llm_judged"), renderings.alias("new_terms"),
                    words("_rec").alias("recording_new_terms"), found.alias("guard_violations"), (F.size(found) > 0).alias("interrupted"))


GUARDS = ("injection", "new_term", "term_conflict", "rule_violation", "low_tm_confidence")


def violations(live: DataFrame, glossary: DataFrame, conflicts: DataFrame | None, threshold: float, score_col: str | None) -> DataFrame:
    """(id, place, guard, detail): each guard that a draft meets, in their order, with what it found."""
    place = lambda g: (F.lit(GUARDS.index(g)).alias("place"), F.lit(g).alias("guard"))
    listed = lambda d, g, what: d.groupBy("id").agg(F.sort_array(F.collect_set(what)).alias("detail")).select("id", *place(g), "detail")
    rule = guards.glossary_violations(live, glossary).select("id", F.concat(F.lit("glossary:"), "en").alias("w"))
    rule = rule.unionByName(guards.fidelity_violations(live).select("id", F.concat_ws(":", "kind", "item").alias("w")))
    out = [
        listed(guards.injection_hits(live), "injection", F.concat_ws(":", "side", F.col("matched"))), listed(guards.new_terms(live, glossary).filter("blocking"), "new_term", F.col("en_term")),
        listed(rule, "rule_violation", F.col("w")),
    ]
    if conflicts is not None:
        out.append(listed(guards.conflict_hits(live, conflicts), "term_conflict", F.col("en_term")))
    if score_col:
        out.append(live.filter(F.col(score_col) < threshold).select("id", *place("low_tm_confidence"), F.array(F.col(score_col).cast("string")).alias("detail")))
    every = out[0]
    for d in out[1:]:
        every = every.unionByName(d)
    return every


def auto_respond(reasons: Column) -> Column:
    return F.when(F.array_contains(reasons, "new_term"), "hold").otherwise("approved")


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved records: queue rows (id, ko_draft, ...) joined to decisions (id, approved_ko or null for "as drafted")."""
    j = queue.join(decisions.select("id", F.col("approved_ko").alias("_ko")), "id")
    final = F.coalesce("_ko", "ko_draft")
    return j.withColumn("approved_ko", final).withColumn("modified", ~final.eqNullSafe(F.col("ko_draft"))).drop("_ko")


def approved_records(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved records, new-term candidates) of reviewed drafts.

    queue: records (id, card_id, field, route, en_text, draft_ko, new_terms, guard_violations); decisions: id, approved_ko
    (null: as drafted), term_renderings (a map from term to target, or null). Every new term of an approved draft is a
    candidate with the reviewer's rendering, or an empty one; the glossary itself is not touched."""
    q = queue.withColumn("ko_draft", T.squeeze_ends(F.col("draft_ko"))).withColumn("en_text", T.squeeze_ends(F.col("en_text")))
    j = review(q, decisions).join(decisions.select("id", "term_renderings"), "id")
    reasons = F.transform("guard_violations", lambda v: v["guard"])
    given = lambda t: F.coalesce(F.try_element_at("term_renderings", t["en"]), F.lit(""))
    named = F.transform("new_terms", lambda t: F.struct(t["en"].alias("en"), given(t).alias("ko_rendering")))
    approved = j.select("id", "card_id", "field", "route", "en_text", "ko_draft", "approved_ko", "modified", reasons.alias("interrupt_reasons"), named.alias("new_terms"))
    c = approved.select("*", F.explode("new_terms").alias("t"))
    return approved, c.select(F.col("t.en").alias("en_term"), F.col("t.ko_rendering").alias("ko_rendering"), F.col("card_id").alias("source_card_id"), F.col("field").alias("source_field"), F.col("approved_ko").alias("approved_ko_context"))


def conflict_summary(conflict_rows: DataFrame, most: int = 4) -> DataFrame:
    """Per (en_term, variant): number of cards and the first few ids."""
    return conflict_rows.select("en_term", "ko_term", F.size("card_ids").alias("n_cards"), F.slice("card_ids", 1, most).alias("sample_ids"))


def new_term_summary(rows: DataFrame) -> DataFrame:
    """Per en_term: count, renderings with their counts, fields, first submission."""
    r = rows.groupBy("en_term", "ko_rendering").agg(F.count("*").alias("n"), F.collect_set("source_field").alias("fields"), F.min("submitted_at").alias("first"))
    return r.groupBy("en_term").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ko_rendering", "n")))).alias("renderings"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"), F.min("first").alias("first_submitted"),
    )


def lookup_terms(requests: DataFrame, glossary: DataFrame, llm_judged: bool = False) -> DataFrame:
    """requests (en) with key, found, ko, source, llm_judged."""
    g = glossary.select(F.col("en").alias("key"), "ko", "source")
    j = requests.withColumn("key", T.glossary_key(F.col("en"))).join(g, "key", "left")
    judged = F.when(F.col("source").isin("official", "subtype_extracted"), True).when(F.col("source").isNotNull(), F.lit(llm_judged))
    return j.withColumn("found", F.col("ko").isNotNull()).withColumn("llm_judged", judged)


def response(found: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, body): each looked-up row as the JSON object that the service returns; what was not found is not in it."""
    return found.select(F.col(id_col).alias("id"), F.to_json(F.struct(*[c for c in found.columns if c != id_col])).alias("body"))


def check_translations(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, n_injection, n_glossary, n_fidelity, passed); injection is looked for in the source only."""
    n = lambda d, out: d.groupBy("id").agg(F.count("*").alias(out))
    j = pairs.select("id")
    for d, out in (
        (guards.injection_hits(pairs, (("en_text", "source"),)), "n_injection"), (guards.glossary_violations(pairs, glossary), "n_glossary"), (guards.fidelity_violations(pairs), "n_fidelity"),
    ):
        j = j.join(n(d, out), "id", "left")
    j = j.na.fill(0, ["n_injection", "n_glossary", "n_fidelity"])
    return j.withColumn("passed", (F.col("n_injection") + F.col("n_glossary") + F.col("n_fidelity")) == 0)
