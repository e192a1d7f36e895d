"""Session helpers: a session for tests, the shared checkpoint folder, table readers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; a session on one machine (``local[...]``) may
    take a temporary folder instead, any other one may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("a session on a cluster must name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: the result survives the loss
    of executors and is computed once. The shuffles behind it are not needed again; their files go at once, not when the driver collects its garbage."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(cleanup, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_out(rows: DataFrame) -> DataFrame:
    """rows over all cores where the scan has fewer than half as many parts (one small file); larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 < cores else rows
