"""Scans, stores and streams over small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from glosswright.sources import corpus, stores
from glosswright.streaming import stores as streams


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


@pytest.fixture
def root(tmp_path):
    for i, (en, ko) in {"01": ("Gain 1", "1 얻는다"), "02": ("Draw", "Draw"), "03": (" ", "뽑는다"), "04": ("Run", "런한다")}.items():
        put(tmp_path / "en" / f"{i}.json", {"text": en})
        put(tmp_path / "ko" / f"{i}.json", {"text": ko})
    put(tmp_path / "prints.json", [{"id": "p2", "card_id": "01", "card_set_id": "s1", "flavor": "late"}, {"id": "p1", "card_id": "01", "card_set_id": "s2", "flavor": "early"}, {"id": "p4", "card_id": "04", "card_set_id": "s3", "flavor": ""}, {"id": "p3", "card_id": "02", "card_set_id": "s1", "flavor": ""}])
    put(tmp_path / "ko_prints.json", [{"id": "p2", "card_id": "01", "card_set_id": "s1", "flavor": "늦게"}, {"id": "p1", "card_id": "01", "card_set_id": "s2", "flavor": "not yet"}])
    put(tmp_path / "sets.json", [{"id": "s1", "date_release": "2014-05-01"}, {"id": "s2", "date_release": ""}, {"id": "s3", "date_release": "2018-01-01"}])
    put(tmp_path / "kw_en" / "a.json", [{"code": "p1", "keywords": "Ice - Code Gate"}, {"code": "p2", "keywords": " "}])
    put(tmp_path / "kw_ko" / "a.json", [{"code": "p1", "keywords": "아이스 - 코드 게이트"}])
    return tmp_path


def test_clean_corpus(spark, root):
    prints, sets = corpus.printings(spark, f"{root}/prints.json"), corpus.card_sets(spark, f"{root}/sets.json")
    dates = corpus.earliest_release(prints, sets)
    assert {tuple(r) for r in dates.collect()} == {("01", "2014-05-01"), ("02", "2014-05-01"), ("04", "2018-01-01")}
    words = corpus.bilingual_keywords(corpus.legacy_keywords(spark, f"{root}/kw_en"), corpus.legacy_keywords(spark, f"{root}/kw_ko"), corpus.code_to_card(prints))
    flavor = corpus.bilingual_flavor(prints, corpus.printings(spark, f"{root}/ko_prints.json"))
    c = corpus.clean_corpus(corpus.cards(spark, f"{root}/en"), corpus.cards(spark, f"{root}/ko"), dates, words, flavor).collect()
    assert [(r["id"], r["ko_text"], r["en_keywords"], r["en_flavor"], r["ko_flavor"]) for r in c] == [("01", "1 얻는다", ["Ice", "Code Gate"], "late", "늦게")]


def test_splits(spark):
    import random

    rows = spark.createDataFrame([(f"{i:02d}", f"2014-01-{1 + i % 9:02d}") for i in range(20)], "id string, date string")
    ids = [r["id"] for r in rows.orderBy("date", "id").collect()]
    random.Random(42).shuffle(ids)
    held, train = corpus.seeded_split(rows, 5)
    assert [r["id"] for r in held.orderBy("pos").collect()] == ids[:5] and {r["id"] for r in train.collect()} == set(ids[5:])
    for n, heads, stretch in ((0, 3, 4), (1, 3, 4), (97, 10, 16), (97, 200, 1), (3000, 40, 512)):
        want = list(range(n))
        random.Random(n).shuffle(want)
        assert corpus.shuffled_places(n, heads, n, stretch) == want[:heads]
    many = spark.createDataFrame([(f"{i * 37 % 501:04d}", f"d{i % 3}") for i in range(501)], "id string, date string").repartition(9)
    places = [(r["date"], r["id"]) for r in corpus.numbered(many, "date", "id").orderBy("place").collect()]
    assert places == sorted((r["date"], r["id"]) for r in many.collect())
    assert [r["place"] for r in corpus.numbered(many, "date", "id").orderBy("place").collect()] == list(range(501))
    assert corpus.numbered(many.limit(0), "id").count() == 0
    h = corpus.hash_split(spark.range(50), 7)
    assert h.filter("held").count() == 7 and h.count() == 50


def test_glossaries(spark, tmp_path):
    paths = {"card_types": put(tmp_path / "f.json", [{"id": "x", "name": "하나"}]), "card_sets": put(tmp_path / "k.json", [{"id": "x", "name": "둘"}, {"id": "y", "name": "셋"}])}
    assert {tuple(r) for r in corpus.flat_official(corpus.official_glossary(spark, paths)).collect()} == {("x", "둘"), ("y", "셋")}
    asset = put(tmp_path / "g.json", {"official": {"a": "가"}, "subtype_extracted": {}, "extracted": {"b": "나"}})
    assert {tuple(r) for r in corpus.glossary_asset(spark, asset).collect()} == {("official", "a", "가"), ("extracted", "b", "나")}
    gold = {"schema_version": 1, "entries": [{"en": "a", "ko": ["가"], "source": "aided"}]}
    assert corpus.gold_terms(spark, put(tmp_path / "gold.json", gold)).first()["ko"] == ["가"]
    with pytest.raises(Exception, match="schema_version"):
        corpus.gold_terms(spark, put(tmp_path / "gold2.json", gold | {"schema_version": 2})).collect()
    with pytest.raises(Exception, match="bad gold entry"):
        corpus.gold_terms(spark, put(tmp_path / "gold3.json", gold | {"entries": [{"en": "a", "ko": [], "source": "aided"}]})).collect()
    bad = corpus.official_glossary(spark, {"factions": put(tmp_path / "bad.json", [{"id": "x"}])})
    with pytest.raises(Exception, match="bad entry"):
        bad.collect()


def test_stores(spark, tmp_path):
    at = f"{tmp_path}/approved"
    assert stores.read(spark, "approved", at).count() == 0
    row = spark.createDataFrame([("1", "text", "가")], "card_id string, field string, approved_ko string")
    stores.append(row, at)
    stores.append(row, at)
    assert stores.read(spark, "approved", at).count() == 2
    lines = '{"_meta": "run_pipeline_header", "run_mode": "real"}\n\n{"card_id": "1", "draft_ko": "x", "model_id": "m"}\n{"card_id": "2", "dra\n'
    run = put(tmp_path / "run.jsonl", lines)
    assert [r["card_id"] for r in stores.draft_records(spark, run).collect()] == ["1"]
    assert stores.run_header(spark, run).first()["run_mode"] == "real"
    assert [tuple(r) for r in stores.predictions(spark, put(tmp_path / "p.json", ["a", "b"])).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r) for r in stores.predictions(spark, put(tmp_path / "p.txt", "a\n\nb\n")).orderBy("pos").collect()] == [(0, "a"), (1, ""), (2, "b")]
    stores.write_split(row, row, f"{tmp_path}/split")
    stores.write_run(row, row, f"{tmp_path}/runs")
    assert spark.read.json(f"{tmp_path}/split/train").count() == spark.read.json(f"{tmp_path}/runs/header").count() == 1


def test_stream_applies_an_approval_once(spark, tmp_path):
    rows = "".join(json.dumps({"id": i, "ts": f"2024-01-01T00:00:{s:02d}"}) + "\n" for i, s in ((1, 1), (1, 2), (2, 3)))
    put(tmp_path / "in" / "a.json", rows)
    s = streams.follow(spark, f"{tmp_path}/in", "id long, ts timestamp")
    streams.drain(streams.once(s, ["id"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    put(tmp_path / "in" / "b.json", rows)  # what comes again later is still known
    streams.drain(streams.once(streams.follow(spark, f"{tmp_path}/in", "id long, ts timestamp"), ["id"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_guarded_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.json", json.dumps({"id": 1, "t": "x"}) + "\n" + json.dumps({"id": 2, "t": ""}) + "\n")
    check = lambda b: (b.withColumn("should_interrupt", F.col("t") == ""), b.select("id"))
    s = streams.follow(spark, f"{tmp_path}/in", "id long, t string")
    streams.guarded(s, check, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/out/review").collect()] == [2]


def test_lines_of_split_files(spark, tmp_path):
    """Files of many splits: each line has its place in its file."""
    want = {}
    for name, n in (("a.txt", 5000), ("b.txt", 3), ("c.txt", 0), ("d.txt", 1200)):
        lines = [f"{name} {i}" if i % 7 else "" for i in range(n)]
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        want |= {(name, i): x for i, x in enumerate(lines)}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = stores.numbered_lines(spark, str(tmp_path))
        assert {(r["file"].rsplit("/", 1)[1], r["pos"]): r["value"] for r in got.collect()} == want
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
