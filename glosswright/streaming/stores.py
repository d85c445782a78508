"""Streams over the append-only stores: guarded drafts, approvals that are applied once, term counts by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """A store as a stream of its new files."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def guarded(drafts: DataFrame, check: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str):
    """Validates each batch and appends drafts, the review queue and recorded terms. A batch that is run again writes
    to the folder of its own number, over what it wrote before."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        checked, recorded = check(batch)
        checked.write.mode("overwrite").json(f"{out}/drafts/batch={number}")
        checked.filter("should_interrupt").write.mode("overwrite").json(f"{out}/review/batch={number}")
        recorded.write.mode("overwrite").json(f"{out}/terms/batch={number}")
        batch.unpersist()

    return drafts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reviewed(decisions: DataFrame, queue: DataFrame, out: str, checkpoint: str):
    """Applies each batch of decisions to the review queue and appends approvals and new-term candidates; a batch that is
    run again writes over what it wrote."""
    from glosswright.operators import drafting

    def run(batch: DataFrame, number: int) -> None:
        approved, terms = drafting.approved_records(queue, batch)
        approved.write.mode("overwrite").json(f"{out}/approved/batch={number}")
        terms.write.mode("overwrite").json(f"{out}/terms/batch={number}")

    return decisions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def awaited(queue: DataFrame, decisions: DataFrame, out: str, checkpoint: str, wait: str = "1 hour"):
    """Review with both sides as streams: a decision is applied whether it comes before its interrupt or after it, up to
    `wait` apart; an interrupt that nobody decides in that time becomes an empty draft with the cause approval_incomplete.

    queue has queued_at, decisions have decided_at besides the columns that approved_records reads. What waits is state of
    the join, keyed by id, and goes when the watermark of both streams has passed. Of decisions about one id the first
    counts. A batch that runs again writes over what it wrote."""
    from glosswright.operators import drafting

    q = queue.withWatermark("queued_at", wait)
    d = decisions.withWatermark("decided_at", wait).dropDuplicatesWithinWatermark(["id"]).select(F.col("id").alias("_id"), "decided_at", "approved_ko", "term_renderings")
    near = F.expr(f"id = _id AND decided_at >= queued_at - INTERVAL {wait} AND decided_at <= queued_at + INTERVAL {wait}")

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        decided = batch.filter("_id is not null")
        approved, terms = drafting.approved_records(decided.select(*queue.columns), decided.select("id", "approved_ko", "term_renderings"))
        approved.write.mode("overwrite").json(f"{out}/approved/batch={number}")
        terms.write.mode("overwrite").json(f"{out}/terms/batch={number}")
        left = batch.filter("_id is null").select("id", "card_id", "field", "route", F.lit("").alias("draft_ko"), F.lit("approval_incomplete").alias("empty_cause"))
        left.write.mode("overwrite").json(f"{out}/unanswered/batch={number}")
        batch.unpersist()

    return q.join(d, near, "left").writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """The first of the rows with equal keys; what is remembered of a key ends with the watermark."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, key: str, time_col: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and writes it as Parquet."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
