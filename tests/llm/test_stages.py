"""Extra columns with any name, and samples that neither repeated ids nor partitions change."""

from __future__ import annotations

import random

import pytest

from glosswright.llm import bpe, exact_dedup, mixing, near_copies, quality_model, simhash

NAMES = "row id n digest row_digest node hash words src nosrc take keep_id mix_doc_id mix_src mix_n _keep_id _keep_row_digest _mix_id _mix_words _row_src _mix_row _mix_take _gone _gone_id _near_id component_id fp".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4)
    texts = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(20)]
    texts += [texts[0], f"{texts[1]} ", None, "", texts[3] + " zz"]
    data = [(i, t, "en", "s" if i % 3 else None, len(t or ""), *[f"x{i}"] * len(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[2], (None, *data[4][1:])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES))


@pytest.mark.parametrize("stage", [exact_dedup.keep_first, mixing.mixed_documents, near_copies.keep_one, simhash.keep_one])
def test_columns_of_any_name(clashing, stage):
    plain = stage(clashing.drop(*NAMES))
    got = stage(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in rows) == sorted((str(r["doc_id"]), r["text"] or "") for r in plain.collect())
    assert all(r[c] == f"x{r['doc_id']}" for r in rows if r["doc_id"] is not None for c in NAMES)


def test_sample_of_repeated_ids(spark):
    rng = random.Random(2)
    data = [(i % 40, " ".join(rng.choice(["good", "text", "bad", "noise", "|"]) for _ in range(rng.randint(3, 30)))) for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = lambda d: sorted((r["doc_id"], round(r["score"], 12)) for r in quality_model.quality_scores(d, labels, sample=20).collect())
    assert scores(df) == scores(df.repartition(7))


def test_sample_is_exact(spark, monkeypatch):
    seen = []
    real = quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda rows, y: seen.append(len(rows)) or real(rows, y))
    df = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality_model.quality_scores(df, labels, sample=20)
    assert seen == [20]


def test_long_texts_keep_to_themselves(spark):
    rng = random.Random(3)
    long = ["".join(rng.choice("ab cd") for _ in range(9000)) for _ in range(3)]
    data = [(1, long[0]), (1, long[1]), (None, long[0]), (11, long[2]), (1, long[0])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = bpe.encode_documents(df, chunk=1000, overlap=100, decoded=True)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in got.collect()) == sorted((str(i), t) for i, t in data)
