"""Session settings and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that every query relies on; cluster sizing stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in (SETTINGS | {"spark.ui.enabled": "false", "spark.driver.memory": "8g"} | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; Spark's reader resolves the path, whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; only a local session without one gets a
    temporary folder."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glosswright-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
