"""What several operators share: whitespace words, cutting lineage, joins that survive a hot key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() has it, and runs of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with at least one row in HOT is hot, so fewer than HOT + 1 keys are: that bounds what is broadcast.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session without one (a test) gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glosswright-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder; for frames without texts. Spark deletes such a checkpoint
    with its frame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever store it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Cuts the lineage of frames with texts through Parquet tables in the shared checkpoint folder, which are deleted
    at the end: what is made of them must be computed by then."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet")
        df.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)


def stored(df: DataFrame, after: str | None = None) -> tuple[DataFrame, str]:
    """The frame through a Parquet table in the shared checkpoint folder, and its path; `after` is then deleted."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if after:
        remove(spark, after)
    return spark.read.parquet(path), path


def release() -> None:
    """Gives this process's unused memory back: Arrow's pool, and what glibc keeps of freed blocks."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work over a task's batches, after which its worker, which Spark keeps for later tasks, waits with little memory."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        release()

    return run


def text_of(column: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def join_hot(rows: DataFrame, dim: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows inner-join dim on key, where `count` in dim says how many rows have that key.

    Keys with at least total / HOT rows are broadcast (at most HOT of them, so their size is bounded whatever
    the input); the rest meet in a shuffle in which no key has more than that share. rows is read twice."""
    is_hot = F.col(count) * HOT >= F.lit(max(total, 1))
    hot, cold = dim.filter(is_hot), dim.filter(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return near.unionByName(far.select(*near.columns))


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text falls in the fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


Query = Callable[[SparkSession, str], DataFrame]
