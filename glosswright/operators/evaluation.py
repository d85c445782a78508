"""Hard gates, ceilings, verdicts and the reports around them. Per-row frames in, one-row aggregates out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.operators import guards, selection
from glosswright.session import workspace

PASS, FAIL, UNREACHABLE = "PASS", "FAIL", "UNREACHABLE"
# ---- fixed values ---------------------------------------------------------------------------------------------------
CAUSES = ("tm_search_failure", "guard_rejected_in_review_queue", "approval_incomplete", "model_invocation_failure")
G1_LEAST, G2_LEAST, G3_FACTOR = 0.95, 1.0, 0.70
ECHO_FLOOR, RULE_TARGET, FLAVOR_TARGET = 0.05, 2.5, 2.0
# ---- end of fixed values --------------------------------------------------------------------------------------------


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a, b))


def _n(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def checked_pairs(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Predictions joined to references by key. A row without its counterpart fails the job, as a zip of lists of
    different lengths would."""
    p, r = predictions.withColumn("_p", F.lit(True)), references.withColumn("_r", F.lit(True))
    both = F.col("_p").isNotNull() & F.col("_r").isNotNull()
    return r.join(p, key, "full").filter(F.assert_true(both, "a prediction without its reference, or the reverse").isNull()).drop("_p", "_r")


def with_references(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Draft records (card_id, route or field) with the reference text of their field (empty without one), white space
    squeezed; cards: id, ko_text, ko_flavor."""
    of = F.array(F.struct(F.lit("text").alias("field"), F.col("ko_text").alias("t")), F.struct(F.lit("flavor").alias("field"), F.col("ko_flavor").alias("t")))
    refs = cards.select(F.col("id").alias("card_id"), F.explode(of).alias("r")).select("card_id", F.col("r.field").alias("field"), T.squeeze(F.coalesce("r.t", F.lit(""))).alias("ref_ko"))
    by_route = F.when(F.coalesce("route", F.lit("rule")) == "rule", "text").otherwise("flavor")
    field = F.coalesce(F.col("field"), by_route) if "field" in records.columns else by_route
    return records.withColumn("field", field).join(refs, ["card_id", "field"], "left").na.fill("", ["ref_ko"])


def scoring_view(glossary: DataFrame) -> DataFrame:
    return glossary.filter(T.has_syllable(F.col("ko")))


def gate1(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row: n_checks, n_violations, compliance, passed, over (row, term) pairs in which the term occurs."""
    hits = guards.phrase_hits(pairs, glossary, keep=("ko_text",))
    bad = ~F.contains(T.tight_parens(F.col("ko_text")), T.tight_parens(F.col("ko")))
    g = hits.agg(F.count("*").alias("n_checks"), _n(bad).alias("n_violations"))
    g = g.withColumn("compliance", _share(F.col("n_checks") - F.col("n_violations"), F.col("n_checks"), 1.0))
    return g.withColumn("passed", F.col("compliance") >= G1_LEAST)


def symbol_differences(pairs: DataFrame) -> DataFrame:
    """(id, passed, n_missing, n_extra) for every row."""
    side = lambda c, of, out: pairs.select("id", F.explode(of(F.col(c))).alias("sym")).groupBy("id", "sym").agg(F.count("*").alias(out))
    both = side("en_text", T.source_symbols, "e").join(side("ko_text", T.target_symbols, "k"), ["id", "sym"], "full")
    gap = F.coalesce("e", F.lit(0)) - F.coalesce("k", F.lit(0))
    d = both.groupBy("id").agg(F.sum(F.greatest(gap, F.lit(0))).alias("m"), F.sum(F.greatest(-gap, F.lit(0))).alias("x"))
    d = pairs.select("id").join(d, "id", "left").select("id", F.coalesce("m", F.lit(0)).alias("n_missing"), F.coalesce("x", F.lit(0)).alias("n_extra"))
    return d.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def gate2(pairs: DataFrame) -> DataFrame:
    """One row: n_cards, n_passed, preservation, passed."""
    g = symbol_differences(pairs).agg(F.count("*").alias("n_cards"), _n(F.col("passed")).alias("n_passed"))
    g = g.withColumn("preservation", _share(F.col("n_passed"), F.col("n_cards"), 1.0))
    return g.withColumn("passed", F.col("preservation") >= G2_LEAST)


def gate3(distances: DataFrame, threshold: Column, column: str = "distance") -> DataFrame:
    """One row: median, mean, lowest and highest distance (0 for none), passed if the median is at most the threshold. The
    median is selected by jobs of its own (see selection)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    path = workspace(distances.sparkSession, "distances")
    distances.select(column).write.parquet(path)  # every distance is made once
    distances = distances.sparkSession.read.parquet(path)
    median = selection.medians(distances, column).get(None)
    g = distances.agg(zero(F.lit(median).cast("double")).alias("median"), zero(F.avg(column)).alias("mean"), zero(F.min(column)).alias("lowest"), zero(F.max(column)).alias("highest"))
    return g.withColumn("passed", F.col("median") <= threshold)


def gate3_threshold(baseline_median: Column, factor: float = G3_FACTOR) -> Column:
    return baseline_median * factor


def percentile_cut(values: DataFrame, column: str, p: float = 20.0) -> DataFrame:
    """One row: threshold (the value at index floor(p / 100 * n), clamped, in order), lowest, highest, median, n. Selecting
    runs jobs; without a value all but n are null."""
    schema = "threshold double, n long, lowest double, highest double, median double"
    kind = values.schema[column].dataType.simpleString()
    got = selection.at_places(values, column, lambda n: [int(p / 100 * n), *selection.middle(n)])
    n, lowest, highest, at = got.get(None, (0, None, None, [None] * 3))
    row = [(at[0], n, lowest, highest, selection.mean_of(at[1:]) if n else None)]
    return values.sparkSession.createDataFrame(row, schema).withColumns({c: F.col(c).cast(kind) for c in ("threshold", "lowest", "highest")})


def ceiling(rows: DataFrame) -> DataFrame:
    """rows (gate, threshold, ceiling, agent, higher_is_better) with reachable, verdict and achievement."""
    up = F.col("higher_is_better")
    meets = lambda c: F.when(up, c >= F.col("threshold")).otherwise(c <= F.col("threshold"))
    reachable = meets(F.col("ceiling"))
    verdict = F.when(~reachable | F.col("agent").isNull(), UNREACHABLE).when(meets(F.col("agent")), PASS).otherwise(FAIL)
    ratio = F.when(up, F.try_divide("agent", "ceiling")).otherwise(F.try_divide("ceiling", "agent"))
    return rows.select("*", reachable.alias("reachable"), verdict.alias("verdict"), F.when(F.col("ceiling") != 0, ratio).alias("achievement"))


def combined(gates: DataFrame) -> DataFrame:
    """One row from (gate, passed): passed if all are, and the failed gates in order."""
    return gates.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))


def final_verdict(runs: DataFrame) -> DataFrame:
    """runs (run_mode, gate1_verdict, gate2_verdict, gate3_passed, echo_passed and, if there, overall_passed) with final:
    null unless the run is real. With ceiling verdicts a gate that fails outright or gate 3 decides; without any (both
    null) all gates together do. An echo gate that was not run decides nothing."""
    overall = F.coalesce("overall_passed", F.lit(False)) if "overall_passed" in runs.columns else F.coalesce("gate3_passed", F.lit(False))
    checked = F.col("gate1_verdict").isNotNull() | F.col("gate2_verdict").isNotNull()
    fails = (F.coalesce("gate1_verdict", F.lit("")) == FAIL) | (F.coalesce("gate2_verdict", F.lit("")) == FAIL)
    gates = F.when(checked, ~fails & F.coalesce("gate3_passed", F.lit(False))).otherwise(overall)
    return runs.withColumn("final", F.when(F.col("run_mode") == "real", gates & F.coalesce("echo_passed", F.lit(True))))


def echo_gate(records: DataFrame, floor: float = ECHO_FLOOR) -> DataFrame:
    """One row over records (draft_ko, top_hit, ref_ko): n_with_hits, n_echo, n_coincidence, rate, threshold, passed.

    An echo is a draft that equals its own first hit. How often the first hit is the reference itself says how many
    echoes are right by coincidence; the threshold is that rate, or the floor if that is higher."""
    flat = lambda c: T.squeeze(F.coalesce(F.col(c), F.lit("")))
    live = records.filter(F.col("top_hit").isNotNull() & (flat("draft_ko") != ""))
    right = (flat("ref_ko") != "") & (flat("top_hit") == flat("ref_ko"))
    g = live.agg(F.count("*").alias("n_with_hits"), _n(flat("draft_ko") == flat("top_hit")).alias("n_echo"), _n(right).alias("n_coincidence"))
    g = g.withColumn("rate", _share(F.col("n_echo"), F.col("n_with_hits"), 0.0))
    g = g.withColumn("threshold", F.greatest(F.lit(floor), _share(F.col("n_coincidence"), F.col("n_with_hits"), 0.0)))
    return g.withColumn("passed", F.col("rate") <= F.col("threshold"))


def expected_fields(cards: DataFrame) -> DataFrame:
    """(card_id, seq, field, text): the fields of a card that are not blank, rule text first."""
    f = F.array(F.struct(F.lit("text").alias("field"), T.squeeze_ends(F.col("en_text")).alias("text")), F.struct(F.lit("flavor").alias("field"), T.squeeze_ends(F.col("en_flavor")).alias("text")))
    d = cards.select(F.col("id").alias("card_id"), F.posexplode(f).alias("seq", "f"))
    return d.select("card_id", "seq", "f.field", "f.text").filter("text != ''")


def field_outcomes(cards: DataFrame, records: DataFrame) -> DataFrame:
    """(card_id, field, draft_ko, cause): a cause for each expected field without a draft."""
    r = records.select("card_id", F.when(F.col("route") == "rule", "text").otherwise("flavor").alias("field"), T.squeeze_ends(F.coalesce("draft_ko", F.lit(""))).alias("draft_ko"), "interrupted", "empty_cause", F.lit(True).alias("there"))
    j = expected_fields(cards).join(r, ["card_id", "field"], "left")
    told = F.when(F.col("empty_cause").isin(*CAUSES), F.col("empty_cause"))
    inferred = F.when(F.coalesce("interrupted", F.lit(False)), "guard_rejected_in_review_queue").otherwise("tm_search_failure")
    cause = F.when(F.col("there").isNull(), "approval_incomplete").when(F.col("draft_ko") == "", F.coalesce(told, inferred))
    return j.select("card_id", "field", F.coalesce("draft_ko", F.lit("")).alias("draft_ko"), cause.alias("cause"))


def synthesis(cards: DataFrame, records: DataFrame) -> DataFrame:
    """(card_id, field_count, compliant, card_prediction): a card complies if none of its fields is empty; then its
    prediction is its text draft (empty for cards that only have flavor)."""
    o = field_outcomes(cards, records).groupBy("card_id").agg(
        F.count("*").alias("field_count"), F.bool_and(F.col("cause").isNull()).alias("compliant"), F.max(F.when(F.col("field") == "text", F.col("draft_ko"))).alias("t")
    )
    j = cards.select(F.col("id").alias("card_id")).join(o, "card_id", "left")
    ok = F.coalesce("compliant", F.lit(True))
    return j.select("card_id", F.coalesce("field_count", F.lit(0)).alias("field_count"), ok.alias("compliant"), F.when(ok, F.coalesce("t", F.lit(""))).otherwise("").alias("card_prediction"))


def empty_causes(cards: DataFrame, records: DataFrame) -> DataFrame:
    """One row with a count for every cause, zero included."""
    return field_outcomes(cards, records).agg(*[_n(F.col("cause") == c).alias(c) for c in CAUSES])


def delivered(cards: DataFrame) -> DataFrame:
    """One row: total, delivered (predictions that are not blank), throughput."""
    g = cards.agg(F.count("*").alias("total"), _n(T.squeeze(F.col("card_prediction")) != "").alias("delivered"))
    return g.withColumn("throughput", _share(F.col("delivered"), F.col("total"), 0.0))


def pending(cards: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many cards (id) there are, with or without records, how many of them have a field that is interrupted
    and was not approved automatically, and their share."""
    wait = records.filter(F.coalesce("interrupted", F.lit(False)) & ~F.coalesce("auto_approved", F.lit(False))).select(F.col("card_id").alias("id"), F.lit(True).alias("waits")).distinct()
    g = cards.select("id").join(wait, "id", "left").agg(F.count("*").alias("n_cards"), _n(F.col("waits")).alias("n_pending"))
    return g.withColumn("ratio", _share(F.col("n_pending"), F.col("n_cards"), 0.0))


def per_model(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Gate numbers by model over the cards that it produced; a card may belong to several models. cards: card_id and any
    of passed (gate 2), n_checks and n_violations (gate 1), distance (gate 3). A share of nothing is null. Records with
    draft_ko and top_hit give the model's echo rate."""
    known = records.filter("model_id is not null")
    got = known.select("model_id", "card_id").distinct().join(cards, "card_id")
    of = [F.countDistinct("card_id").alias("n_cards")]
    if "passed" in cards.columns:
        of += [_n(F.col("passed")).alias("n_passed"), F.avg(F.col("passed").cast("double")).alias("preservation")]
    if "n_checks" in cards.columns:
        of.append(F.try_divide(F.sum("n_checks") - F.sum("n_violations"), F.sum("n_checks")).alias("compliance"))
    out = got.groupBy("model_id").agg(*of)
    if "distance" in cards.columns:
        medians = records.sparkSession.createDataFrame(list(selection.medians(got, "distance", "model_id").items()), "model_id string, median_distance double")
        out = out.join(F.broadcast(medians), "model_id", "left")  # a row for each model
    if {"draft_ko", "top_hit"} <= set(records.columns):
        flat = lambda c: T.squeeze(F.coalesce(F.col(c), F.lit("")))
        live = F.col("top_hit").isNotNull() & (flat("draft_ko") != "")
        echo = known.groupBy("model_id").agg(F.count("*").alias("n_records"), F.try_divide(_n(live & (flat("draft_ko") == flat("top_hit"))), _n(live)).alias("echo_rate"))
        out = out.join(echo, "model_id")
    return out


def card_compliance(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, n_checks, n_violations) of the rows in which a term occurs: gate 1 row by row."""
    hits = guards.phrase_hits(pairs, glossary, keep=("ko_text",))
    bad = ~F.contains(T.tight_parens(F.col("ko_text")), T.tight_parens(F.col("ko")))
    return hits.groupBy("id").agg(F.count("*").alias("n_checks"), _n(bad).alias("n_violations"))


def run_counters(records: DataFrame) -> DataFrame:
    """By model (null for none): records, those with a draft, those whose model failed."""
    drafted = T.squeeze(F.coalesce("draft_ko", F.lit(""))) != ""
    return records.groupBy("model_id").agg(F.count("*").alias("n"), _n(drafted).alias("succeeded"), _n(F.col("empty_cause") == "model_invocation_failure").alias("failed"))


def observations(scores: DataFrame, targets: tuple[float, float] = (RULE_TARGET, FLAVOR_TARGET)) -> DataFrame:
    """One row: count, mean and median of rule and flavor scores (0 for none); null flavors do not count, and a target
    is only met by a score that was measured."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = scores.agg(*[f for c in ("rule", "flavor") for f in (F.count(f"{c}_score").alias(f"{c}_n"), zero(F.avg(f"{c}_score")).alias(f"{c}_mean"), zero(F.lit(selection.medians(scores, f"{c}_score").get(None)).cast("double")).alias(f"{c}_median"))])
    for c, target in zip(("rule", "flavor"), targets, strict=True):
        g = g.withColumn(f"{c}_meets", (F.col(f"{c}_n") > 0) & (F.col(f"{c}_mean") >= target))
    return g


def gold_summary(scorecard: DataFrame) -> DataFrame:
    """By source: scored terms (found or missed; the others could not be found), found ones, recall, and the share of
    found terms with an agreeing target."""
    scored = F.col("reach").isin("found", "missed")
    g = scorecard.groupBy("source").agg(_n(scored).alias("scored"), _n(F.col("reach") == "found").alias("found"), _n(F.coalesce("ko_match", F.lit(False))).alias("ko_correct"))
    return g.withColumn("recall", _share(F.col("found"), F.col("scored"), 0.0)).withColumn("ko_accuracy", _share(F.col("ko_correct"), F.col("found"), 0.0))


def gold_totals(scorecard: DataFrame) -> DataFrame:
    """One row over all sources: gold_size, scored, found, ko_correct, recall, ko_accuracy, and how many terms could not
    be reached for each reason."""
    reasons = ("official_excluded", "over_max_n", "below_min_cooccur", "below_rank_cut")
    g = scorecard.agg(
        F.count("*").alias("gold_size"), _n(F.col("reach").isin("found", "missed")).alias("scored"), _n(F.col("reach") == "found").alias("found"),
        _n(F.coalesce("ko_match", F.lit(False))).alias("ko_correct"), *[_n(F.col("reach") == r).alias(r) for r in reasons],
    )
    return g.withColumn("recall", _share(F.col("found"), F.col("scored"), 0.0)).withColumn("ko_accuracy", _share(F.col("ko_correct"), F.col("found"), 0.0))
