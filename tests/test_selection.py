"""Order statistics, phrases that share their first word, judging that fails, cards without records."""

from __future__ import annotations

import random
import statistics

import pytest

from glosswright.operators import evaluation, guards, judging, selection


@pytest.mark.parametrize("small", [3, 4096])
def test_medians_and_places(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BINS", 64)
    rng = random.Random(1)
    groups = {
        "spread": [rng.uniform(-5, 5) for _ in range(501)], "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(200)], "ties": [1.0] * 300 + [2.0] * 300,
        "one": [7.0], "two": [-1.0, 4.0], "huge": [-1.7e308, 1.7e308, 1.6e308, 0.0, 5e-324], None: [3.0, 1.0, 2.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("nulls", None), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    mean = lambda xs: (lambda s: s[(len(s) - 1) // 2] + (s[len(s) // 2] - s[(len(s) - 1) // 2]) * 0.5)(sorted(xs))
    assert selection.medians(df, "x", "g") == {g: mean(xs) for g, xs in groups.items()}
    n, lo, hi, at = selection.at_places(df.filter("g = 'spread'"), "x", lambda n: [0, n - 1, 100, 100, n + 5])[None]
    s = sorted(groups["spread"])
    assert (n, lo, hi, at) == (501, s[0], s[-1], [s[0], s[-1], s[100], s[100], s[-1]])
    assert selection.medians(df.limit(0), "x") == {} and statistics.median(groups["spread"]) == selection.medians(df.filter("g = 'spread'"), "x")[None]


def test_no_sort_of_all_values(spark):
    df = spark.range(1000).selectExpr("id % 7 AS g", "CAST(id AS DOUBLE) AS distance")
    plan = evaluation.gate3(df, evaluation.gate3_threshold(evaluation.F.lit(900.0)))._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_terms_of_one_first_word(spark):
    """20,000 terms that begin alike, and texts that all have that word: candidates stay near the hits."""
    rng = random.Random(2)
    names = [f"w{i}" for i in range(20_000)]
    terms = spark.createDataFrame([(f"the {w}",) for w in names] + [("the",), ("of the",), ("[x]",)], "en string")
    texts = [(i, " ".join(f"the {rng.choice(names)} of" for _ in range(20))) for i in range(200)] + [(900, "w1 the w2x, THE W3"), (901, None), (902, "a [X] b"), (903, "of  the")]
    df = spark.createDataFrame(texts, "id int, en_text string")
    want = {(i, f"the {a}") for i, t in texts if t and i < 900 for w in [t.split()] for x, a in zip(w, w[1:], strict=False) if x == "the"}
    want |= {(i, e) for i, _ in texts if i < 900 for e in ("the", "of the")} | {(900, "the"), (900, "the w3"), (902, "[x]"), (903, "the")}
    got = {(r["id"], r["en"]) for r in guards.phrase_hits(df, terms).collect()}
    assert got == {(i, e) for i, e in want if e in dict.fromkeys([f"the {w}" for w in names] + ["the", "of the", "[x]"])}
    occurs = df.select("id", guards.F.explode(guards.T.runs(guards.F.col("en_text"))).alias("_anchor"))
    anchored = guards.anchored(terms, "en", occurs.groupBy("_anchor").agg(guards.F.count("*").alias("n")))
    assert occurs.join(anchored, "_anchor").count() <= 10 * len(got)


def test_a_failing_pair_costs_itself(spark, tmp_path):
    c = spark.createDataFrame([(f"t{i}", "k", i, 0.5, 1.0) for i in range(200)], "en_term string, ko_term string, cooccurrence long, dice double, pmi double")
    path = str(tmp_path / "judged")

    def fussy(part):
        if any(e == "t7" for e, _, _ in part):
            raise RuntimeError
        return [(e, k, s["cooccurrence"] > 100 and s["dice"] == 0.5 and s["pmi"] == 1.0, "r") for e, k, s in part]

    got = judging.judge_and_keep(c, fussy, "fp", path, chunk=50, scored=True).collect()
    assert len(got) == 199 and sum(r["accepted"] for r in got) == 99
    again = judging.judge_and_keep(c.filter("cooccurrence < 3"), lambda part: [(e, k, True, "new") for e, k in part], "fp", path, again=True)
    assert again.count() == 199 and again.filter("reason = 'new'").count() == 3  # the last judgment of a pair counts


def test_a_killed_run_keeps_its_batches(spark, tmp_path):
    c = spark.createDataFrame([(f"t{i}", "k") for i in range(40)], "en_term string, ko_term string")
    path, flag = str(tmp_path / "judged"), tmp_path / "seen"

    def dies(part):
        if flag.exists() and len(flag.read_text()) >= 8:
            raise SystemExit  # not an error that is tried again: the worker is gone
        with flag.open("a") as f:
            f.write("x")
        return [(e, k, True, "r") for e, k in part]

    with pytest.raises(Exception):  # noqa: B017
        judging.judge_and_keep(c, dies, "fp", path, parallelism=2, chunk=2)
    kept = judging.latest(judging.stores.read(spark, "judgments", path), "fp").count()
    asked = spark.sparkContext.accumulator(0)
    done = judging.judge_and_keep(c, lambda part: asked.add(len(part)) or [(e, k, True, "r") for e, k in part], "fp", path)
    assert 0 < kept < 40 and done.count() == 40 and asked.value == 40 - kept


def test_cards_without_records_count(spark):
    cards = spark.createDataFrame([(i,) for i in range(10)], "id int")
    records = spark.createDataFrame([(1, True, None), (1, True, None), (2, True, True), (3, False, None), (99, True, None), (4, None, None)], "card_id int, interrupted boolean, auto_approved boolean")
    assert tuple(evaluation.pending(cards, records).first()) == (10, 1, 0.1)
    assert tuple(evaluation.pending(cards.limit(0), records).first()) == (0, 0, 0.0)
