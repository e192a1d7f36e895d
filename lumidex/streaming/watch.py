"""An index kept up to date by a stream of file events."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.text import file_name
from lumidex.session import cut_lineage
from lumidex.sources.files import extract_text, is_supported, scan_paths
from lumidex.sources.store import IndexStore
from lumidex.streaming.events import fold_events


def moves(events: DataFrame) -> DataFrame:
    """(src, dest, at, event_id) of the moves of files to supported types, repeated rows once."""
    rows = events.where((F.lower(F.trim("kind")) == "moved") & ~F.coalesce("is_directory", F.lit(False)))
    rows = rows.where(F.col("src_path").isNotNull() & F.coalesce(is_supported(F.col("dest_path")), F.lit(False)))
    return rows.select(F.col("src_path").alias("src"), F.col("dest_path").alias("dest"), F.col("event_at").alias("at"), "event_id").distinct()


def follow(paths: DataFrame, moved: DataFrame, most: int = 100) -> DataFrame:
    """(path, now, at, event_id): where the moves took each path, a step of every chain a round, in the order of the events.

    Ends when no path moves on; more than ``most`` steps of one path are an error, not cut.
    """
    start = F.lit(None).cast(moved.schema["at"].dataType)
    state = paths.select("path", F.col("path").alias("now"), start.alias("at"), F.lit(None).cast("bigint").alias("event_id"))
    for _ in range(most):
        later = F.col("s.at").isNull() | (F.struct("m.at", "m.event_id") > F.struct("s.at", "s.event_id"))
        steps = state.alias("s").join(moved.alias("m"), (F.col("s.now") == F.col("m.src")) & later)
        first = steps.groupBy(F.col("s.path").alias("path")).agg(F.min(F.struct("m.at", "m.event_id", "m.dest")).alias("f"))
        first = cut_lineage(first)
        if first.isEmpty():
            return state
        new = first.select("path", F.col("f.dest").alias("now"), F.col("f.at").alias("at"), F.col("f.event_id").alias("event_id"))
        state = cut_lineage(state.join(new.select("path"), "path", "left_anti").unionByName(new))
    raise ValueError(f"a path moved more than {most} times in one batch")


def apply_events(store: IndexStore, events: DataFrame, load: Callable[[DataFrame], Iterable[DataFrame]] | None = None, embedder=None) -> None:
    """Moves, then deletions, then new content of created and modified files, each as in the folded events.

    A moved file keeps its id and is indexed under its new path; where another file has that path already, it stays as it was. Deleted files are
    orphaned and keep their chunks. ``load`` gives what now is at the touched paths (path), as relations (path, hash, text); nothing else is read. Written are
    the rows of files that changed.
    """
    files = store.table("files")
    state = cut_lineage(fold_events(events))
    moved = moves(events)
    gone = follow(files.join(moved.select(F.col("src").alias("path")).distinct(), "path", "left_semi").select("path"), moved).where("now <> path").select("path", "now")
    taken = files.select(F.col("path").alias("now")).join(gone.select(F.col("path").alias("now")), "now", "left_anti")
    free = gone.join(taken, "now", "left_anti").groupBy("now").agg(F.min("path").alias("path"))
    placed = files.join(free, "path", "left")
    placed = placed.select("id", F.coalesce("now", "path").alias("path"), "hash", F.when(F.col("now").isNotNull(), file_name(F.col("now"))).otherwise(F.col("filename")).alias("filename"), F.when(F.col("now").isNotNull(), "indexed").otherwise(F.col("status")).alias("status"), F.col("now").isNotNull().alias("_changed"))
    dead = state.where("status = 'orphaned'").select("path", F.lit(True).alias("_dead"))
    placed = placed.join(dead, "path", "left").where("_changed or _dead").withColumn("status", F.when(F.col("_dead"), "orphaned").otherwise(F.col("status")))
    store.put_files(placed.drop("_dead", "_changed"))
    if load is not None:
        for found in load(state.where("status = 'indexed'").select("path")):
            store.index(found, embedder)


def watch(store: IndexStore, events_folder: str, documents_folder: str, checkpoint: str, schema=None, embedder=None):
    """A running query over the event files there are: each batch changes the index in a few commits, reading the touched files alone. A batch that is run again
    finds its moves made and its content unchanged."""
    spark = store.spark
    schema = schema or spark.read.parquet(events_folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(events_folder)

    def write(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        apply_events(IndexStore(own, store.folder), batch, lambda touched: map(extract_text, scan_paths(own, documents_folder, touched)), embedder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
