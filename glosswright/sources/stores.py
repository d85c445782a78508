"""Append-only stores and run outputs: judgments, approvals, new terms, drafts, predictions.

Stores are folders of JSON lines that only ever grow; a reader of a store that does not exist gets an empty frame.
Run headers live beside the records, never among them; files that mix both are read by their `_meta` field."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

HIT = "struct<id:string,en_text:string,ko_text:string,score:double>"
TERM = "struct<en:string,ko:string,source:string,llm_judged:boolean>"
VIOLATION = "struct<guard:string,detail:string>"
SCHEMAS = {
    "judgments": "en_term string, ko_term string, accepted boolean, reason string, prompt_fingerprint string, seq long",
    "approved": "card_id string, field string, route string, en_text string, ko_draft string, approved_ko string, approved_at string, modified boolean, interrupt_reasons array<string>",
    "new_terms": "en_term string, ko_rendering string, source_card_id string, source_field string, approved_ko_context string, submitted_at string",
    "conflicts": "en_term string, ko_variants array<string>, source_card_ids map<string,array<string>>, source string",
    "drafts": f"_meta string, card_id string, field string, route string, draft_ko string, tm_hits array<{HIT}>, injected_terms array<{TERM}>, tm_confidence double, "
    f"guard_violations array<{VIOLATION}>, new_terms array<string>, recording_new_terms array<string>, interrupted boolean, eval_autoresume boolean, auto_approved boolean, "
    "auto_held boolean, empty_cause string, hold_reasons array<string>, model_id string, run_mode string, primary_model_id string, mixed_run boolean",
}


def read(spark: SparkSession, name: str, path: str, whole_file: bool = False) -> DataFrame:
    """A store by name; blank and broken lines are dropped, a missing path is an empty store."""
    try:
        d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole_file)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMAS[name])
    row = StructType.fromDDL(f"{SCHEMAS[name]}, _broken string")
    if whole_file:
        d = d.select(F.explode(F.from_json("value", ArrayType(row))).alias("r"))
    else:
        d = d.select(F.from_json("value", row, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return d.filter("r is not null and r._broken is null").select("r.*").drop("_broken")


def draft_records(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, "drafts", path).filter("_meta is null").drop("_meta", "run_mode", "primary_model_id", "mixed_run")


def run_header(spark: SparkSession, path: str) -> DataFrame:
    """The run header of a file that mixes both, if it stands before any record; at most one row. Lines are told apart by
    file and by their place in it."""
    row = StructType.fromDDL(f"{SCHEMAS['drafts']}, _broken string")
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run_mode string, primary_model_id string, mixed_run boolean")
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))  # order within a block
    d = lines.select(at.alias("at"), F.from_json("value", row, {"columnNameOfCorruptRecord": "_broken"}).alias("r")).filter("r is not null and r._broken is null")
    kind = F.when(F.col("r._meta").isNull(), "record").otherwise(F.col("r._meta"))
    first = d.filter(kind.isin("record", "run_pipeline_header")).agg(F.min_by(F.struct(kind.alias("kind"), "r.run_mode", "r.primary_model_id", "r.mixed_run"), "at").alias("h"))
    return first.filter("h.kind = 'run_pipeline_header'").select("h.run_mode", "h.primary_model_id", "h.mixed_run")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): the lines of each file with their 0-based places. Files are read in splits; a line's place is its
    place in the split and the number of lines in the splits before, of which there is a row each."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    splits = lines.groupBy("file", "split").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("file").orderBy("split")) - F.col("size")
    splits = splits.select("file", "split", "first", before.alias("before"))
    return lines.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("n") - F.col("first")).alias("pos"), "value")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, prediction) of a JSON array of strings, which has no splits and is read whole, or of a file of lines."""
    if not path.endswith(".json"):
        return numbered_lines(spark, path).select("pos", F.col("value").alias("prediction"))
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "prediction")).select(F.col("pos").cast("long").alias("pos"), "prediction")


def glossary_asset(official: DataFrame, subtype: DataFrame, extracted: DataFrame, scores: DataFrame, judged: DataFrame | None = None, llm_judged: bool = False) -> DataFrame:
    """One row, the glossary as an asset: three maps, how many terms each has, how many conflicts were held back, the
    extraction scores and the judgment counters. official: id, name; subtype and extracted: rows of terms.conflicts."""
    entries = lambda d, e, k: d.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(e, k)))).alias("m"))
    clean = lambda d: entries(d.filter("not is_conflict"), F.col("en_term"), F.get("ko_variants", F.lit(0)).alias("ko"))
    held = lambda d, out: d.agg(F.coalesce(F.sum(F.when(F.col("is_conflict"), 1).otherwise(0)), F.lit(0)).alias(out))
    g = entries(official, F.col("id"), F.col("name")).withColumnRenamed("m", "official").crossJoin(clean(subtype).withColumnRenamed("m", "subtype_extracted"))
    g = g.crossJoin(clean(extracted).withColumnRenamed("m", "extracted")).crossJoin(held(subtype, "s")).crossJoin(held(extracted, "c")).crossJoin(scores.select(F.struct("*").alias("subtype_evaluation")))
    counts = F.struct(*[F.size(c).alias(c) for c in ("official", "subtype_extracted", "extracted")], F.col("s").alias("subtype_conflicts_held_back"), F.col("c").alias("conflicts_held_back"))
    g = g.withColumn("counts", counts).withColumn("llm_judged", F.lit(llm_judged)).drop("s", "c")
    return g if judged is None else g.crossJoin(judged.select(F.struct("*").alias("judged_counts")))


def write_assets(glossary: DataFrame, patterns: DataFrame, conflicts: DataFrame, path: str) -> None:
    """glossary (one row), patterns in order of count and conflicts, each a store of its own."""
    replace(glossary, f"{path}/glossary")
    replace(patterns.orderBy(F.desc("count"), "en_template", "ko_template"), f"{path}/patterns")
    replace(conflicts, f"{path}/conflicts")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a store; what is there is neither read nor written again."""
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_split(hold_out: DataFrame, train: DataFrame, path: str) -> None:
    replace(hold_out, f"{path}/hold_out")
    replace(train, f"{path}/train")


def write_run(records: DataFrame, header: DataFrame, path: str) -> None:
    replace(records, f"{path}/records")
    replace(header, f"{path}/header")
