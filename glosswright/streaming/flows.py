"""Streams run over the driver's tables to their end, as batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswright.operators import drafting, guards
from glosswright.plans import bindings as B
from glosswright.session import table, workspace
from glosswright.streaming import stores


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by event type of the event stream. A row that comes late or twice is written like any other; events
    are told apart where the counts are read, so none is lost to a watermark and none counts twice."""
    at = workspace(spark, "events")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    stores.drain(stream.select("event_id", "ts", "event_type"), f"{at}/out", f"{at}/checkpoint")
    d = spark.read.schema("event_id long, ts timestamp, event_type string").parquet(f"{at}/out")
    return d.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.countDistinct("event_id").alias("n"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions as they come in, applied to the queue and appended to the store of approvals: how many by field."""
    at = workspace(spark, "approvals")
    p = table(spark, sf_dir, "part")
    queue = p.selectExpr("p_partkey AS id", "p_partkey AS card_id", "CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS field", "'rule' AS route", "p_name AS en_text", "p_type AS draft_ko",
                         "CAST(array() AS array<struct<en:string,ko_rendering:string>>) AS new_terms", "CAST(array() AS array<struct<guard:string>>) AS guard_violations")
    p.filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS approved_ko", "map('x', 'y') AS term_renderings").repartition(4).write.json(f"{at}/in")
    stream = stores.follow(spark, f"{at}/in", "id long, approved_ko string, term_renderings map<string,string>", files_per_batch=2)
    stores.reviewed(stream, queue, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    d = spark.read.schema("id long, field string, modified boolean").json(f"{at}/out/approved")
    return d.groupBy("field", "modified").agg(F.count("*").alias("n"))


def guarded_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of all cards through the guarded stream: how many were held, by reasons."""
    at = workspace(spark, "cards")
    B.cards(spark, sf_dir).withColumnRenamed("ko_text", "draft_ko").write.json(f"{at}/in")
    g = guards.flat_glossary(B.glossary(spark))
    stream = stores.follow(spark, f"{at}/in", "id long, en_text string, draft_ko string, route string")
    stores.guarded(stream, lambda b: drafting.validate(b, g), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    d = spark.read.schema("id long, reasons array<string>").json(f"{at}/out/drafts")
    return d.groupBy(F.array_join("reasons", "|").alias("reasons")).agg(F.count("*").alias("n"))


def awaited_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupts and decisions as two streams, in either order of arrival: what became of each interrupt, counted."""
    at, start = workspace(spark, "awaited"), "TIMESTAMP'2024-01-01 00:00:00'"
    p = table(spark, sf_dir, "part")
    seconds = "make_interval(0, 0, 0, 0, 0, 0, {})"
    queue = p.selectExpr("p_partkey AS id", "p_partkey AS card_id", "CASE WHEN p_size % 2 = 0 THEN 'text' ELSE 'flavor' END AS field", "'rule' AS route", "p_name AS en_text", "p_type AS draft_ko", "CAST(array() AS array<struct<en:string,ko_rendering:string>>) AS new_terms",
                         "CAST(array() AS array<struct<guard:string>>) AS guard_violations", f"{start} + {seconds.format('p_partkey % 600')} AS queued_at")
    gap = "CASE WHEN p_partkey % 5 = 0 THEN 7200 WHEN p_partkey % 2 = 0 THEN 300 ELSE -300 END"  # too late, after, before
    decisions = p.filter("p_partkey % 3 = 0").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS approved_ko", "map('x', 'y') AS term_renderings", f"{start} + {seconds.format(f'p_partkey % 600 + {gap}')} AS decided_at")
    # of each kind two folders of files and then a row far ahead, which lets time pass; decisions first
    for name, rows, time in (("decisions", decisions, "decided_at"), ("queue", queue, "queued_at")):
        for part in ("id % 2 = 1", "id % 2 = 0"):
            rows.filter(part).repartition(2).write.mode("append").json(f"{at}/{name}")
        rows.limit(1).withColumns({"id": F.lit(-1).cast("long"), time: F.expr(f"{start} + INTERVAL 2 DAYS")}).write.mode("append").json(f"{at}/{name}")
    read = lambda name, rows: stores.follow(spark, f"{at}/{name}", rows.schema, files_per_batch=2)
    stores.awaited(read("queue", queue), read("decisions", decisions), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    approved = spark.read.schema("id long, field string, modified boolean").json(f"{at}/out/approved").withColumn("outcome", F.when(F.col("modified"), "modified").otherwise("approved"))
    late = spark.read.schema("id long, field string, empty_cause string").json(f"{at}/out/unanswered").withColumnRenamed("empty_cause", "outcome")
    return approved.select("id", "field", "outcome").unionByName(late.select("id", "field", "outcome")).filter("id >= 0").groupBy("field", "outcome").agg(F.count("*").alias("n"))
