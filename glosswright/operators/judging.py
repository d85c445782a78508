"""Judging candidates with an injected judge: pending work, checkpoints, accepted terms.

A judge is a plain callable over a chunk of pairs that returns (en, ko, accepted, reason) tuples; a pair is (en, ko), or
(en, ko, scores) for a judge with `scored`, scores being a dict of cooccurrence, dice and pmi. Pairs that it leaves out
are dropped, not rejected: they stay pending."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glosswright.session import workspace
from glosswright.sources import stores

CHUNK = 250
SCORES = ("cooccurrence", "dice", "pmi")
JUDGMENT = "en_term string, ko_term string, accepted boolean, reason string, prompt_fingerprint string"


def fingerprint(system: Column, human: Column) -> Column:
    """First 16 hex digits over both prompts with a NUL between them."""
    return F.substring(F.sha2(F.concat(system.cast("binary"), F.unhex(F.lit("00")), human.cast("binary")), 256), 1, 16)


def latest(judgments: DataFrame, prompt: str, order_col: str = "seq") -> DataFrame:
    """The last judgment of each pair under one prompt; lines without an order stand first."""
    last = W.partitionBy("en_term", "ko_term").orderBy(F.desc_nulls_last(order_col))
    return judgments.filter(F.col("prompt_fingerprint") == prompt).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def pending(cands: DataFrame, judgments: DataFrame) -> DataFrame:
    return cands.join(judgments.select("en_term", "ko_term"), ["en_term", "ko_term"], "left_anti")


def accepted(cands: DataFrame, judgments: DataFrame) -> DataFrame:
    return cands.join(judgments.filter("accepted").select("en_term", "ko_term"), ["en_term", "ko_term"], "left_semi")


def counters(cands: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: accepted, rejected, dropped."""
    j = cands.select("en_term", "ko_term").join(judgments.select("en_term", "ko_term", "accepted"), ["en_term", "ko_term"], "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(n(F.col("accepted")).alias("accepted"), n(~F.col("accepted")).alias("rejected"), n(F.col("accepted").isNull()).alias("dropped"))


def judge_and_keep(cands: DataFrame, decide: Callable, prompt: str, path: str, parallelism: int = 8, chunk: int = CHUNK, retries: int = 3, again: bool = False, scored: bool = False) -> DataFrame:
    """Judgments of all candidates under one prompt, the last of each pair, from the store at `path` (JSON lines).

    What the store has is not judged again, unless `again`. The rest is written down and read back as a stream, one file
    of a chunk for each of `parallelism` tasks at a time; a batch's judgments are in the store as soon as it is done, under
    its own number, with which a batch that runs twice replaces itself. A run that is killed loses the batch it was in,
    and the next run goes on from there. seq orders judgments by run and batch."""
    spark = cands.sparkSession
    kept = lambda: latest(stores.read(spark, "judgments", path), prompt)
    todo = cands if again else pending(cands, kept())
    cols = ["en_term", "ko_term", *[c for c in SCORES if c in cands.columns]]
    work, run = workspace(spark, "pending"), int(time.time() * 1000)
    todo.select(*cols).distinct().repartition(parallelism).write.option("maxRecordsPerFile", chunk).json(f"{work}/in")
    stream = spark.readStream.schema(todo.select(*cols).schema).option("maxFilesPerTrigger", parallelism).json(f"{work}/in")

    def one(batch: DataFrame, number: int) -> None:
        judged = judge(batch, decide, prompt, parallelism, chunk, retries, scored)
        judged.withColumn("seq", F.lit(run * 1_000_000 + number)).write.mode("overwrite").json(f"{path}/run-{run}-{number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return kept()


def observe(cards: DataFrame, rule: Callable[[str, str], int], flavor: Callable[[str], int], parallelism: int = 8) -> DataFrame:
    """(card_id, rule_score, flavor_score) of cards (id, en_text, ko_text, ko_flavor, flavor_ko) by two injected scorers:
    the rule text of every card, the flavor only where there is both one to translate and a translation (else null)."""
    import pyarrow as pa

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b.to_pylist()
            rules = [rule(x["en_text"], x["ko_text"]) for x in r]
            flavors = [flavor(x["flavor_ko"]) if x["ko_flavor"] and x["flavor_ko"] else None for x in r]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.int64()), pa.array(flavors, pa.int64())], ["card_id", "rule_score", "flavor_score"])

    rows = cards.select(F.col("id").alias("card_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("en_text", "ko_text", "ko_flavor", "flavor_ko")])
    return rows.repartition(parallelism).mapInArrow(scored, f"card_id {rows.schema['card_id'].dataType.simpleString()}, rule_score long, flavor_score long")


def asked(decide: Callable, part: list[tuple], retries: int) -> list[tuple]:
    """What the judge says of a chunk. One that keeps failing is asked pair by pair, so that only failing pairs are lost."""
    for _ in range(retries):
        try:
            return decide(part)
        except Exception:  # noqa: S112  whatever a judge does, it is asked again
            continue
    return [x for p in part for x in asked(decide, [p], retries)] if len(part) > 1 else []


def judge(cands: DataFrame, decide: Callable[[list[tuple]], list[tuple[str, str, bool, str]]], prompt: str, parallelism: int = 8, chunk: int = CHUNK, retries: int = 3, scored: bool = False) -> DataFrame:
    """Judgments of all candidates, `parallelism` chunks at a time; a pair that keeps failing is dropped. With `scored` the
    judge sees each pair's co-occurrence, Dice and PMI, where the candidates have them."""
    cols = ["en_term", "ko_term", *([c for c in SCORES if c in cands.columns] if scored else [])]

    def judged(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            names = list(zip(pdf["en_term"], pdf["ko_term"], strict=True))
            pairs = [(*n, s) for n, s in zip(names, pdf[cols[2:]].to_dict("records"), strict=True)] if scored else names
            for i in range(0, len(pairs), chunk):
                known = set(names[i : i + chunk])
                rows = [(*r[:4], prompt) for r in asked(decide, pairs[i : i + chunk], retries) if tuple(r[:2]) in known]
                yield pd.DataFrame(rows, columns=["en_term", "ko_term", "accepted", "reason", "prompt_fingerprint"])

    return cands.select(*cols).repartition(parallelism).mapInPandas(judged, JUDGMENT)
