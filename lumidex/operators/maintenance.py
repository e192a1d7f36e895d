"""Orphans, relocation and live paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_live(files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Files whose path is among the live ones."""
    return files.join(live_paths.select("path").distinct(), "path", "left_semi")


def mark_orphans(files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """files with status ``orphaned`` where the path is not live; others keep theirs."""
    live = live_paths.select("path").distinct().withColumn("_live", F.lit(True))
    rows = files.join(live, "path", "left")
    return rows.withColumn("status", F.when(F.col("_live").isNull(), "orphaned").otherwise(F.col("status"))).drop("_live")


def relocate(missing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, old_path, path): for each missing file (id, path, filename, hash) the first live file (path, filename, hash) of the same name and content.

    First by the candidates' root_rank, if they have one, then by path. Files without a hash are not sought. A path that another file of ``missing``
    is relocated to as well goes to the smaller id.
    """
    rank = F.col("c.root_rank") if "root_rank" in candidates.columns else F.lit(0)
    m = missing.where(F.coalesce("hash", F.lit("")) != "").alias("m")
    hits = m.join(candidates.alias("c"), (F.col("m.filename") == F.col("c.filename")) & (F.col("m.hash") == F.col("c.hash")))
    hits = hits.where(F.col("c.path") != F.col("m.path"))
    best = hits.groupBy(F.col("m.id").alias("id"), F.col("m.path").alias("old_path")).agg(F.min(F.struct(rank.alias("r"), F.col("c.path").alias("path"))).alias("b"))
    best = best.select("id", "old_path", F.col("b.path").alias("path"))
    return best.groupBy("path").agg(F.min(F.struct("id", "old_path")).alias("w")).select("w.id", "w.old_path", "path")
