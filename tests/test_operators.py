"""Term, pattern, retrieval, guard, evaluation and drafting operators on small chosen inputs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswright.functions import text as T
from glosswright.operators import distance, drafting, evaluation, guards, judging, patterns, retrieval, terms
from tests import scoring

PAIR = "id long, en_text string, ko_text string"


def one(df):
    return df.first().asDict()


def test_candidates_and_cap(spark):
    p = spark.createDataFrame([(i, "Gain [credit]", "얻는다 [credit].") for i in range(6)] + [(9, "lose it", "잃는다")], PAIR)
    c = terms.candidates(p, least=5)
    r = {(x["en_term"], x["ko_term"]): x for x in c.collect()}
    assert ("lose", "잃는다") not in r and r["gain", "얻는다"]["cooccurrence"] == 6 and r["gain", "얻는다"]["dice"] == 1.0
    assert abs(r["gain", "얻는다"]["pmi"] - 0.2223924213364481) < 1e-12
    kept = terms.cap(c, most_terms=2, per_term=1).collect()
    assert [(x["en_term"], x["ko_term"]) for x in sorted(kept)] == [("[credit]", "[credit]"), ("gain", "[credit]")]


def test_conflicts_and_keywords(spark):
    p = spark.createDataFrame([(1, ["A", "B"], ["가", "나"]), (2, ["a"], ["다"]), (3, ["c", "d"], ["라"]), (4, ["e"], ["x"])], "id int, e array<string>, k array<string>")
    k = terms.keyword_pairs(p, "e", "k")
    assert {(r["en_term"], r["ko_term"], tuple(r["card_ids"])) for r in k.collect()} == {("a", "가", (1,)), ("b", "나", (1,)), ("a", "다", (2,))}
    assert {(r["en_term"], r["is_conflict"]) for r in terms.conflicts(k, "s").collect()} == {("a", True), ("b", False)}
    assert one(terms.keyword_counters(p, "e", "k")) == {"with_keywords": 4, "skipped_mismatch": 1, "dropped_untranslated": 1}


def test_extraction_scores(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "term string")
    assert one(terms.extraction_scores(s("a_b", "c", "c"), s("a b", "d")))["f1"] == 0.5
    assert one(terms.extraction_scores(s().limit(0), s("d"))) == {"tp": 0, "fp": 0, "fn": 1, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_candidates_of_tokens(spark):
    """Arrays of tokens count like the texts that hold them; a null array has no terms but its row counts."""
    p = spark.createDataFrame([(i, "Gain [credit]", "얻는다 [credit].") for i in range(6)] + [(9, "lose it", "잃는다")], PAIR)
    want = {tuple(r) for r in terms.candidates(p, least=5).collect()}
    t = p.select("id", T.tokens(F.col("en_text")).alias("en"), T.target_tokens(F.col("ko_text")).alias("ko"))
    assert {tuple(r) for r in terms.candidates(t, "en", "ko", least=5).collect()} == want
    assert {tuple(r) for r in terms.candidates(p.join(t.select("id", "ko"), "id"), target_col="ko", least=5).collect()} == want
    gone = t.withColumn("ko", F.when(F.col("id") > 0, F.col("ko")))
    r = {(x["en_term"], x["ko_term"]): x for x in terms.candidates(gone, "en", "ko", least=5).collect()}
    assert r["gain", "얻는다"]["cooccurrence"] == 5 and abs(r["gain", "얻는다"]["dice"] - 10 / 11) < 1e-12


def test_patterns(spark):
    p = spark.createDataFrame([(i, f"Gain {i} [credit]. Draw.", f"{i} [credit] 얻는다. 뽑는다.") for i in (5, 3, 1, 2)] + [(8, "A. B.", "가.")], PAIR)
    got = {r["en_template"]: r for r in patterns.extract(p, least=3).collect()}
    assert got["Gain {N} {SYM}."]["count"] == 4 and got["Gain {N} {SYM}."]["examples"] == [1, 2, 3] and set(got) == {"Gain {N} {SYM}.", "Draw."}
    found = patterns.lookup(spark.createDataFrame([("Gain 77 [click].",), ("no",)], "text string"), patterns.extract(p)).collect()
    assert [r["ko_template"] for r in found] == ["{N} {SYM} 얻는다.", None]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "a cat and a cat"), (4, "fish swim here"), (5, "birds fly there")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "cat"), (8, "zebra")], "query_id long, text string")
    top = retrieval.top_k(retrieval.bm25(docs, q), 2).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in top] == [(7, 3, 0), (7, 1, 1)]
    full = retrieval.full_ranking(retrieval.bm25(docs, q), docs, q, depth=4)
    assert [r["doc_id"] for r in full.filter("query_id = 8").orderBy("rank").collect()] == [1, 2, 3, 4]
    char = retrieval.top_k(retrieval.char_tfidf(docs, spark.createDataFrame([(7, "the cat sat")], q.schema)), 1).first()
    assert (char["doc_id"], char["score"]) == (1, 1.0)


def test_word_edge_ngrams(spark):
    got = spark.createDataFrame([("Cat\n a",)], "t string").select(retrieval.word_edge_ngrams(F.col("t")).alias("g")).first()["g"]
    assert sorted(got) == sorted([" ca", "cat", "at ", " cat", "cat ", " cat ", " a "])


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    for block in (1, 100):
        got = retrieval.dense(v, v.filter("vec_id = 5"), 2, block=block).orderBy("rank").collect()
        assert [r["doc_id"] for r in got] == [4, 3]
    assert retrieval.dense(v, v.limit(0), 2).count() == 0


def test_dense_ties_go_by_id(spark):
    """Far more equal, zero or nearly equal vectors than k: the smallest ids stay, whatever the batches."""
    rng = random.Random(3)
    ids = list(range(300))
    rng.shuffle(ids)
    # cosines to the query: equal (1), equal but for the 8th digit, and 0
    kind = lambda i: [1.0, 0.0] if i % 3 == 0 else [1.0, 1e-4 * (1 + i / 1000)] if i % 3 == 1 else [0.0, 0.0]
    v = spark.createDataFrame([(i, kind(i)) for i in ids], "vec_id long, embedding array<double>")
    for parts in (1, 7):
        got = {q: [] for q in (0, 2)}
        for r in retrieval.dense(v.repartition(parts), v.filter("vec_id in (0, 2)"), 5).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["doc_id"])
        assert got == {0: [1, 3, 4, 6, 7], 2: [0, 1, 3, 4, 5]}
    assert retrieval.rounded(np.array([0.0000005, -0.0000005, 0.1234565, -np.inf])).tolist() == [1, -1, 123457, -np.inf]


def test_fusion_breaks_ties_by_first_signal(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 20, 1)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 20, 0), (1, 10, 1), (1, 30, 500)], a.schema)
    assert [r["doc_id"] for r in retrieval.fuse([a, b], 5).orderBy("rank").collect()] == [10, 20]


@pytest.fixture(scope="module")
def glossary(spark):
    rows = [("extracted", "ice", "얼음"), ("official", "ICE", "아이스"), ("official", "code_gate", "코드 게이트"), ("extracted", "(x)", "엑스"), ("extracted", "", "y")]
    return guards.flat_glossary(spark.createDataFrame(rows, "section string, en string, ko string")).cache()


def test_phrases_in_texts_of_repeated_ids(spark, glossary):
    p = spark.createDataFrame([(1, "Break ice (x)"), (1, "A Code Gate"), (1, "A Code Gate"), (None, "[ice]"), (3, "nice ICEs"), (4, "")], "id long, en_text string")
    got = sorted((r["id"] or 0, r["en_text"], r["en"]) for r in guards.phrase_hits(p, glossary).collect())
    assert got == [(0, "[ice]", "ice"), (1, "A Code Gate", "code gate"), (1, "A Code Gate", "code gate"), (1, "Break ice (x)", "(x)"), (1, "Break ice (x)", "ice")]


def test_glossary(spark, glossary):
    assert {tuple(r) for r in glossary.collect()} == {("ice", "아이스", "official"), ("code gate", "코드 게이트", "official"), ("(x)", "엑스", "extracted")}
    p = spark.createDataFrame([(1, "Break ice (x)", "아이스"), (2, "A Code Gate", "코드 게이트"), (3, "nice", "")], PAIR)
    assert {(r["id"], r["en"]) for r in guards.glossary_violations(p, glossary).collect()} == {(1, "(x)")}
    g = one(evaluation.gate1(p, glossary))
    assert (g["n_checks"], g["n_violations"], g["passed"]) == (3, 1, False)
    assert one(evaluation.gate1(p.limit(0), glossary))["compliance"] == 1.0


def test_fidelity(spark):
    p = spark.createDataFrame([(1, "If 2 [credit] 007", "2 2 [click] 7"), (2, "ok", "ok")], PAIR)
    got = {(r["kind"], r["item"], r["en_n"], r["ko_n"]) for r in guards.fidelity_violations(p).collect()}
    assert got == {("added_number", "2", 1, 2), ("symbol_mismatch", "[credit]", 1, 0), ("symbol_mismatch", "[click]", 0, 1), ("omitted_condition", "", 1, 0)}


def test_new_terms(spark, glossary):
    p = spark.createDataFrame([(1, "Install Gordian Blade. Sneakdoor <b>beta</b> [credit] the ice", "", "rule", [" Icebreaker ", "ice"]), (2, "Hello Jinteki", "", "flavor", [])], PAIR + ", route string, kw array<string>")
    got = {(r["id"], r["en_term"]): r["blocking"] for r in guards.new_terms(p, glossary, keywords_col="kw").collect()}
    assert got == {(1, "icebreaker"): True, (1, "install"): False, (1, "gordian"): True, (1, "blade"): True, (1, "sneakdoor"): False, (1, "beta"): False, (2, "hello"): False, (2, "jinteki"): False}


def test_triggers(spark, glossary):
    p = spark.createDataFrame([(1, "the ice", "아이스", "rule", 0.5), (2, "the ice", "x", "rule", 0.001), (3, "the Wyldside", "x", "rule", None)], PAIR + ", route string, score double")
    conflicts = spark.createDataFrame([("ICE", ["a", "b"]), ("the", ["c"])], "en_term string, ko_variants array<string>")
    got = {r["id"]: r["reasons"] for r in guards.triggers(p, glossary, conflicts, 0.01, "score").collect()}
    assert got == {1: ["term_conflict"], 2: ["term_conflict", "rule_violation", "low_tm_confidence"], 3: ["new_term"]}
    assert {r["id"]: r["reasons"] for r in guards.triggers(p, glossary).collect()}[1] == []


def test_gates(spark):
    p = spark.createDataFrame([(1, "Trace[2] [click]", "<trace>추적 2</trace> [click]"), (2, "[credit] [credit]", "[credit] [mu]"), (3, "", "")], PAIR)
    got = {r["id"]: (r["n_missing"], r["n_extra"], r["passed"]) for r in evaluation.symbol_differences(p).collect()}
    assert got == {1: (0, 0, True), 2: (1, 1, False), 3: (0, 0, True)}
    d = distance.block_distance(spark.createDataFrame([(1, "tide", "diet"), (2, "ab" * 150, "ba" * 150), (3, " a  b ", "a b"), (4, None, "x")], "id int, p string, r string"), "p", "r")
    assert [r["distance"] for r in d.orderBy("id").collect()] == [0.75, 1.0, 0.0, 1.0]
    assert one(evaluation.gate3(d, F.lit(0.9)))["median"] == 0.875
    assert one(evaluation.gate3(d.limit(0), F.lit(0.9)))["median"] == 0.0


def test_percentile_is_by_index(spark):
    v = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 7)] + [(None,)], "v double")
    assert one(evaluation.percentile_cut(v, "v", 20)) == {"threshold": 1.0, "n": 5, "lowest": 1.0, "highest": 9.0, "median": 5.0}
    assert one(evaluation.percentile_cut(v, "v", 100))["threshold"] == 9.0


def test_ceiling_and_verdicts(spark):
    rows = [("a", 0.9, 0.8, 1.0, True), ("b", 0.9, 0.95, 0.9, True), ("c", 0.9, 0.95, 0.5, True), ("d", 0.3, 0.2, 0.4, False), ("e", 0.3, 0.2, None, False), ("f", 0.5, 0.0, 0.1, False)]
    got = {r["gate"]: (r["verdict"], r["achievement"]) for r in evaluation.ceiling(spark.createDataFrame(rows, "gate string, threshold double, ceiling double, agent double, higher_is_better boolean")).collect()}
    assert [v for v, _ in got.values()] == ["UNREACHABLE", "PASS", "FAIL", "FAIL", "UNREACHABLE", "PASS"] and got["d"][1] == 0.5 and got["f"][1] is None
    runs = spark.createDataFrame([("real", "PASS", "UNREACHABLE", True, True), ("real", "FAIL", "PASS", True, True), ("real", "PASS", "PASS", False, True), ("stub", "PASS", "PASS", True, True)], "run_mode string, gate1_verdict string, gate2_verdict string, gate3_passed boolean, echo_passed boolean")
    assert [r["final"] for r in evaluation.final_verdict(runs).collect()] == [True, False, False, None]
    g = spark.createDataFrame([("x", True), ("z", False), ("y", False)], "gate string, passed boolean")
    assert one(evaluation.combined(g)) == {"passed": False, "failed": ["y", "z"]}


def test_synthesis(spark):
    cards = spark.createDataFrame([(1, "a", "f"), (2, "a", None), (3, " ", "f"), (4, "a", "f")], "id int, en_text string, en_flavor string")
    rec = "card_id int, route string, draft_ko string, interrupted boolean, empty_cause string"
    records = spark.createDataFrame([(1, "rule", "T", False, None), (1, "flavor", "F", False, None), (2, "rule", " ", True, None), (3, "flavor", "F", False, None), (4, "rule", "T", False, None), (4, "flavor", "", False, "model_invocation_failure")], rec)
    got = {r["card_id"]: (r["field_count"], r["compliant"], r["card_prediction"]) for r in evaluation.synthesis(cards, records).collect()}
    assert got == {1: (2, True, "T"), 2: (1, False, ""), 3: (1, True, ""), 4: (2, False, "")}
    assert one(evaluation.empty_causes(cards, records)) == {"tm_search_failure": 0, "guard_rejected_in_review_queue": 1, "approval_incomplete": 0, "model_invocation_failure": 1}
    assert one(evaluation.delivered(evaluation.synthesis(cards, records)))["delivered"] == 1


def test_pairs_without_counterpart_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, p string")
    b = spark.createDataFrame([(1, "r"), (3, "s")], "id int, r string")
    with pytest.raises(Exception, match="without its reference"):
        evaluation.checked_pairs(a, b).collect()
    assert [tuple(r) for r in evaluation.checked_pairs(a.limit(1), b.limit(1)).collect()] == [(1, "r", "x")]


def test_verdict_without_ceilings_or_echo(spark):
    rows = [("real", None, None, True, None, True), ("real", None, None, True, True, False), ("real", "PASS", None, True, None, False), ("real", "PASS", "FAIL", True, True, True), ("real", "PASS", "PASS", True, False, True), ("real", "PASS", "PASS", None, True, True)]
    runs = spark.createDataFrame(rows, "run_mode string, gate1_verdict string, gate2_verdict string, gate3_passed boolean, echo_passed boolean, overall_passed boolean")
    assert [r["final"] for r in evaluation.final_verdict(runs).collect()] == [True, False, True, False, False, False]


def test_counted_pairs_in_any_square(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(sorted({rng.randrange(-30, 30) for _ in range(rng.randrange(1, 20))}), sorted({rng.randrange(-30, 30) for _ in range(rng.randrange(1, 20))})) for _ in range(40)]
    want = Counter((e, k) for es, ks in rows for e in es for k in ks)
    df = spark.createDataFrame(rows, "es array<long>, ks array<long>")
    for size, step in ((10, terms.STEP), (300, 1), (10**6, 5)):
        monkeypatch.setattr(terms, "STEP", step)
        got = terms.counted_pairs(df, 3, pairs_a_task=size).collect()
        assert {(r["e"], r["k"]): r["cooccurrence"] for r in got} == {p: n for p, n in want.items() if n >= 3} and len(got) == len({(r["e"], r["k"]) for r in got})
    assert terms.counted_pairs(df.limit(0), 1).count() == 0


def test_conflicts_keep_their_rows(spark):
    p = spark.createDataFrame([("a", "가", ["1", "2"]), ("a", "다", []), ("b", "나", ["3"])], "en_term string, ko_term string, card_ids array<string>")
    got = {r["en_term"]: (r["ko_variants"], r["source_card_ids"]) for r in terms.conflicts(p, "s").collect()}
    assert got == {"a": (["가", "다"], {"가": ["1", "2"]}), "b": (["나"], {"나": ["3"]})}
    assert [r["en_term"] for r in terms.all_conflicts(terms.conflicts(p, "s"), terms.conflicts(p, "t")).collect()] == ["a", "a"]


def test_pattern_parts(spark, monkeypatch):
    p = spark.createDataFrame([(i, f"Gain {i}.", f"{i} 얻는다.") for i in range(200)], PAIR).repartition(5)
    monkeypatch.setattr(patterns, "SALTS", 3)
    monkeypatch.setattr(patterns, "ROWS", 2)
    r = one(patterns.extract(p))
    assert (r["count"], r["examples"]) == (200, [0, 1, 2])


@pytest.mark.parametrize("cells", [1 << 29, 1 << 15])
def test_rare_templates_stay_behind(spark, monkeypatch, cells):
    """Rows of hashes that stand in `least` rows all pass, most others don't; with few cells more pass and nothing is lost."""
    monkeypatch.setattr(patterns, "MOST_CELLS", cells)
    rows = [(i, f"Word{'a' * (i % 7)} {chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}.", "가.") for i in range(9000)] + [(i, "Gain 3.", "얻는다.") for i in range(9000, 9005)]
    rows += [(i, f"Pair {i // 2 % 2}x{chr(97 + i % 4 // 2)}.", "둘.") for i in range(9005, 9009)]
    p = spark.createDataFrame(rows, PAIR).repartition(6)
    t = patterns.templates(p)
    counts = Counter((r["en_template"], r["ko_template"]) for r in t.collect())
    passed = Counter((r["en_template"], r["ko_template"]) for r in patterns.able(t, 3, t.count(), cells).collect())
    assert all(passed[k] == (n if n >= 3 else passed[k]) and passed[k] in (0, n) for k, n in counts.items())
    assert sum(passed.values()) < sum(counts.values()) / (2 if cells > 1 << 20 else 1.05)
    got = {(r["en_template"], r["ko_template"]): r["count"] for r in patterns.extract(p, least=3).collect()}
    assert got == {k: n for k, n in counts.items() if n >= 3}
    assert patterns.extract(p.limit(0)).count() == 0 and patterns.extract(p, least=1).count() == len(counts)


def test_block_distance_is_the_matchers(spark):
    """Against the standard library's matcher, with popular characters, repeats, long texts and astral ones."""
    from difflib import SequenceMatcher

    rng, alphabets = random.Random(5), ["ab", "abcdefg 가나다", "etaoin" + "".join(map(chr, range(200, 600))), "x\U0001f600y"]
    word = lambda a, n: "".join(rng.choice(a) for _ in range(rng.randrange(n)))
    both = []
    for k in range(400):
        a = rng.choice(alphabets)
        x = word(a, rng.choice((6, 60, 500)))
        y = "".join(c if rng.random() < 0.9 else rng.choice(a) for c in x) if k % 2 else word(a, rng.choice((6, 60, 500)))
        both.append((k, x, y + word(a, 9)))
    assert all(2 * distance.in_blocks(x, y) == round(SequenceMatcher(None, x, y).ratio() * (len(x) + len(y))) for _, x, y in both if x or y)
    d = distance.block_distance(spark.createDataFrame([*both, (900, None, None), (901, "", " "), (902, "q" * 5000, "q" * 4000)], "id int, p string, r string"), "p", "r")
    got = {r["id"]: r["distance"] for r in d.collect()}
    flat = lambda s: " ".join(s.split())
    assert all(got[k] == 1.0 - SequenceMatcher(None, flat(x), flat(y)).ratio() for k, x, y in both)
    assert (got[900], got[901]) == (0.0, 0.0) and got[902] == 1.0 - 8000 / 9000


def test_block_distance_keeps_up(spark):
    """A long and a short text take no longer than the standard library needs, pairs of one partition are dealt to several
    tasks, and gate 3 makes each distance once."""
    import time
    from difflib import SequenceMatcher

    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("etaoinshr dlu") for _ in range(n))
    both = [(k, text(960), text(190)) for k in range(20)]

    def seconds(f):
        began = time.thread_time()
        got = [f(x, y) for _, x, y in both]
        return time.thread_time() - began, got

    plain = lambda x, y: sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())
    (ours, got), (theirs, want) = seconds(distance.in_blocks), seconds(plain)
    assert got == want and ours < theirs
    d = distance.block_distance(spark.createDataFrame(both, "id int, p string, r string").coalesce(1), "p", "r")
    assert d.select(F.spark_partition_id().alias("k")).distinct().count() > 1
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    assert one(evaluation.gate3(d.withColumn("distance", counted("distance")), F.lit(0.9)))["highest"] <= 1
    assert made.value == len(both)


def test_baseline(spark):
    """Misses count 1; the threshold of gate 3 is a share of the median."""
    from difflib import SequenceMatcher

    references = spark.createDataFrame([(1, "tide"), (2, "same"), (3, "lost"), (4, None)], "id long, ko_text string")
    hits = spark.createDataFrame([(1, "diet"), (2, "same"), (4, "")], "id long, hit_ko string")
    r = one(distance.baseline_stats(hits, references))
    near = 1.0 - SequenceMatcher(None, "diet", "tide").ratio()  # the neighbour comes first
    assert (r["n"], r["lowest"], r["highest"], r["mean"], r["median"]) == (4, 0.0, 1.0, (near + 1) / 4, near / 2)
    assert one(distance.baseline_stats(hits, references.limit(0))) == {"n": 0, "median": None, "mean": None, "lowest": None, "highest": None}
    assert abs(one(references.limit(1).select(evaluation.gate3_threshold(F.lit(0.5)).alias("t")))["t"] - 0.35) < 1e-12


def test_morphology(spark):
    from glosswright.operators import morphology

    def tag(word):
        table = {"설치할": [("설치", "NNG"), ("하", "XSV")], "레즈할": [("레즈", "NNP"), ("하", "VV")], "뽑는다": [("뽑", "VV-R"), ("는다", "EF")], "당신의": [("당신", "NP"), ("의", "JKG")]}
        return table.get(word) or [(w, "SL") for w in word.replace("을", " ").split()]

    plain = {"설치할": "설치", "레즈할": "레즈", "뽑는다": "뽑다", "당신의": "", "2[credit]을": "2[credit]", "[a](B)": "[a](B)", "[x]s": "[x]s"}
    words = spark.createDataFrame([(w,) for w in [*plain, None, ""]], "word string")
    norms = lambda **how: {r["word"]: r["norm"] for r in morphology.dictionary(words, tag, **how).collect() if r["word"]}
    assert norms() == plain
    assert norms(registered=["당신의", "당신", ""]) == plain | {"당신의": "당신의"}  # the longest registered word stays
    df = spark.createDataFrame([(1, "당신의 설치할, 뽑는다."), (2, None), (3, "")], "id int, t string")
    assert {r["id"]: r["norm_tokens"] for r in morphology.normalised(df, "t", tag).collect()} == {1: ["설치", "뽑다"], 2: [], 3: []}


def test_judgments_survive_a_failure(spark, tmp_path):
    c = spark.createDataFrame([(f"t{i}", "k") for i in range(20)], "en_term string, ko_term string")
    path = str(tmp_path / "judged")
    good = lambda part: [(e, k, True, "r") for e, k in part if e != "t3"]
    first = judging.judge_and_keep(c.filter("en_term < 't15'"), good, "fp", path, chunk=2, parallelism=2)
    n = first.count()
    asked = spark.sparkContext.accumulator(0)

    def counting(part):
        asked.add(len(part))
        return good(part)

    again = judging.judge_and_keep(c, counting, "fp", path)
    assert n == 7 and again.count() == 19 and asked.value == 20 - n and again.select("en_term").distinct().count() == 19
    assert judging.judge_and_keep(c, good, "other", path).count() == 19


def test_hybrid_search_ranks(spark):
    docs = spark.createDataFrame([(i,) for i in range(8)], "doc_id int")
    q = spark.createDataFrame([(1,)], "query_id int")
    a = spark.createDataFrame([(1, 5, 0.9), (1, 2, 0.4)], "query_id int, doc_id int, score double")
    b = spark.createDataFrame([(1, 0, -0.5), (1, 5, 0.1), (1, 7, -0.1)], a.schema)
    got = {r["doc_id"]: (r["rank"], r["a_rank"], r["b_rank"]) for r in scoring.search(docs, q, {"a": a, "b": b}, 20).collect()}
    order_a, order_b = [5, 2, 0, 1, 3, 4, 6, 7], [5, 1, 2, 3, 4, 6, 7, 0]
    assert {d: x[1:] for d, x in got.items()} == {d: (order_a.index(d), order_b.index(d)) for d in range(8)}
    fused = sorted(range(8), key=lambda d: (-sum(1 / (61 + o.index(d)) for o in (order_a, order_b)), order_a.index(d)))
    assert [d for d, x in sorted(got.items(), key=lambda x: x[1][0])] == fused
    with pytest.raises(RuntimeError):
        scoring.search(docs, q, {}, 5)


def test_echo_and_observations(spark):
    r = spark.createDataFrame([("a  b", "a b", "no"), ("x", "y", " y"), ("", "z", "z"), ("q", None, "q")], "draft_ko string, top_hit string, ref_ko string")
    assert one(evaluation.echo_gate(r)) == {"n_with_hits": 2, "n_echo": 1, "n_coincidence": 1, "rate": 0.5, "threshold": 0.5, "passed": True}
    assert not one(evaluation.echo_gate(r.drop("ref_ko").withColumn("ref_ko", F.lit(None).cast("string"))))["passed"]
    o = one(evaluation.observations(spark.createDataFrame([(3, None), (2, None)], "rule_score int, flavor_score int")))
    assert (o["rule_mean"], o["rule_meets"], o["flavor_n"], o["flavor_meets"]) == (2.5, True, 0, False)


def test_judging(spark):
    c = spark.createDataFrame([(f"t{i}", "k") for i in range(9)], "en_term string, ko_term string")
    calls = lambda part: [(e, k, e != "t0", "r") for e, k in part if e != "t1"] + [("echoed", "k", True, "r")]
    got = judging.judge(c, calls, "fp", parallelism=2, chunk=3)
    assert got.count() == 8
    assert one(judging.counters(c, got)) == {"accepted": 7, "rejected": 1, "dropped": 1}
    assert [r["en_term"] for r in judging.pending(c, got).collect()] == ["t1"]

    def broken(part):
        raise OSError("down")

    assert judging.judge(c, broken, "fp", retries=2).count() == 0
    j = spark.createDataFrame([("a", "b", True, "", "now", 1), ("a", "b", False, "", "now", 2), ("a", "b", True, "", "old", 3)], judging.JUDGMENT + ", seq int")
    assert [r["accepted"] for r in judging.latest(j, "now").collect()] == [False]


def test_fallback():
    waits = []

    def down(p):
        raise OSError

    call = drafting.with_fallback([("a", down), ("b", str.upper)], sleep=waits.append)
    assert call("x") == ("X", "b", 4) and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        drafting.with_fallback([("a", down)], retryable=lambda e: False, sleep=waits.append)("x")


def test_drafts_and_validation(spark, glossary):
    prompts = spark.createDataFrame([("1", "ok"), ("2", "boom")], "id string, prompt string")

    def call(p):
        if p == "boom":
            raise RuntimeError("all failed")
        return " 초안 ", "m", 1

    d = drafting.draft(prompts, call, 2)
    assert {(r["id"], r["draft_ko"], r["empty_cause"]) for r in d.collect()} == {("1", "초안", None), ("2", "", "model_invocation_failure")}
    cards = spark.createDataFrame([("1", "the ice", "x", "rule"), ("2", "</system> Foo", "", "rule"), ("3", "</system> the", "y", "rule")], "id string, en_text string, draft_ko string, route string")
    checked, recorded = drafting.validate(cards, glossary)
    assert {r["id"]: r["reasons"] for r in checked.collect()} == {"1": ["rule_violation"], "2": [], "3": ["injection"]}
    assert recorded.count() == 0


def test_fields_prompt_and_review(spark):
    cards = spark.createDataFrame([(1, " rule ", "flavor"), (2, None, "f"), (3, " ", "")], "id int, en_text string, en_flavor string")
    f = drafting.expand_fields(cards)
    assert [(r["card_id"], r["field"], r["route"], r["en_text"]) for r in f.orderBy("id").collect()] == [(1, "flavor", "flavor", "flavor"), (1, "text", "rule", "rule"), (2, "flavor", "flavor", "f")]
    term = lambda e, s, j: F.struct(F.lit(e).alias("en"), F.lit("케이").alias("ko"), F.lit(s).alias("source"), F.lit(j).alias("llm_judged"))
    p = f.filter("field = 'text'").select(drafting.prompt(F.col("en_text"), F.array(term("b", "official", True), term("c", "extracted", False)), F.array(F.struct(F.lit("E").alias("en_text"), F.lit("K").alias("ko_text"))), False).alias("p")).first()["p"]
    assert p.startswith(drafting.PROMPT[0]) and p.endswith("\n\n## Card to translate\n<card-text>\nrule\n</card-text>\n\n## Korean translation")
    assert "\n\n## Official Glossary\n  b → 케이\n" in p and "  c → 케이  [extracted, not yet validated]" in p and "  [1] EN: <card-text>\nE\n</card-text>\n       KO: " in p
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, ko_draft string")
    d = spark.createDataFrame([(1, None), (2, "B")], "id int, approved_ko string")
    assert {(r["id"], r["approved_ko"], r["modified"]) for r in drafting.review(q, d).collect()} == {(1, "a", False), (2, "B", True)}
