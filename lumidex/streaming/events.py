"""File events folded into the state of each path, as a batch and as a stream, and the keystroke semantics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumidex.session import ensure_checkpoint_dir
from lumidex.sources.files import is_supported


def effects(events: DataFrame) -> DataFrame:
    """(path, status, at, event_id): what each event does to a path.

    created and modified index the source; deleted orphans it; moved takes it away (``moved``) and indexes the destination, or orphans the source
    where the destination's type is not supported or not given. Folders, null paths and, but for the source of a move, unsupported types do nothing.
    """
    kind = F.lower(F.trim("kind"))
    rows = events.where(~F.coalesce("is_directory", F.lit(False)) & F.col("src_path").isNotNull())
    source, dest = is_supported(F.col("src_path")), F.coalesce(is_supported(F.col("dest_path")), F.lit(False))

    def one(path: str, status: str):
        return F.struct(F.col(path).alias("path"), F.lit(status).alias("status"))

    made = (
        F.when(kind.isin("created", "modified") & source, F.array(one("src_path", "indexed")))
        .when((kind == "deleted") & source, F.array(one("src_path", "orphaned")))
        .when((kind == "moved") & dest, F.array(one("src_path", "moved"), one("dest_path", "indexed")))
        .when(kind == "moved", F.array(one("src_path", "orphaned")))
    )
    return rows.select(F.explode(made).alias("e"), F.col("event_at").alias("at"), "event_id").select("e.path", "e.status", "at", "event_id")


def fold(made: DataFrame) -> DataFrame:
    """(path, status, at, event_id): the last effect on each path by time and event id; partial maxima before the shuffle."""
    last = F.max(F.struct("at", "event_id", "status")).alias("s")
    return made.groupBy("path").agg(last).select("path", "s.status", "s.at", "s.event_id")


def fold_events(events: DataFrame) -> DataFrame:
    return fold(effects(events))


def fold_stream(spark: SparkSession, folder: str, into: str, checkpoint: str, schema=None):
    """A running query that folds each batch of new event files into ``into``/batch=N; a batch that is run again writes the same folder."""
    schema = schema or spark.read.parquet(folder).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream's source is a folder
        reader, source = spark.readStream.option("pathGlobFilter", path.getName()), path.getParent().toString()
    else:
        reader, source = spark.readStream, folder
    stream = reader.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)

    def write(batch: DataFrame, n: int) -> None:
        fold_events(batch).write.mode("overwrite").parquet(f"{into}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, folder: str) -> DataFrame:
    """What is there now folded as a stream, in a new folder below the shared checkpoint folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    fold_stream(spark, folder, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return fold(spark.read.parquet(f"{root}/state").select("path", "status", "at", "event_id"))


def changed_modifications(events: DataFrame) -> DataFrame:
    """(event_id, src_path) of modifications at another time of the path than its event before: the first one and those at least a second apart."""
    w = Window.partitionBy("src_path").orderBy("event_at", "event_id")
    rows = events.where((F.lower(F.trim("kind")) == "modified") & ~F.coalesce("is_directory", F.lit(False)) & is_supported(F.col("src_path"))).distinct()
    before = F.lag("event_at").over(w)
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("event_at") >= F.col("_b") + F.expr("INTERVAL 1 SECOND"))).select("event_id", "src_path")


def modified_content(events: DataFrame, stored: DataFrame, found: DataFrame) -> DataFrame:
    """(path, hash) of the files with a modification whose content is another than the stored one, or was not stored: those that are to be indexed again.

    ``stored`` and ``found`` (path, hash) have one row a path. A modification that leaves the content as it was, or of a file that cannot be read, changes nothing.
    """
    rows = events.where((F.lower(F.trim("kind")) == "modified") & ~F.coalesce("is_directory", F.lit(False)) & is_supported(F.col("src_path")))
    now = found.where(F.coalesce("hash", F.lit("")) != "").select("path", "hash").join(rows.select(F.col("src_path").alias("path")).distinct(), "path", "left_semi")
    old = stored.select("path", F.col("hash").alias("_old"))
    return now.join(old, "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).select("path", "hash")


def debounce(events: DataFrame, key: str, time: str, order: str, gap: str) -> DataFrame:
    """Of a key's events, those that no other follows within the gap: the trailing edge of a debounce."""
    w = Window.partitionBy(key).orderBy(time, order)
    after = F.lead(time).over(w)
    return events.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") >= F.col(time) + F.expr(f"INTERVAL {gap}"))).drop("_after")


def latest_generation(events: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """The last event of each key; others are stale. Partial maxima before the shuffle."""
    return events.groupBy(key).agg(F.max(F.struct(time, order)).alias("s")).select(key, f"s.{order}", f"s.{time}")
