"""Building and maintaining the relations files, chunks and vectors as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.text import file_name, not_blank
from lumidex.session import cut_lineage


def current_files(files: DataFrame) -> DataFrame:
    """One row a file id: its latest state (ties by the other columns), status in lower case without blanks."""
    latest = F.max(F.struct("indexed_at", "path", "hash", "filename", "status")).alias("s")
    rows = files.where(F.col("id").isNotNull()).groupBy("id").agg(latest)
    return rows.select("id", "s.path", F.lower("s.hash").alias("hash"), "s.filename", F.lower(F.trim("s.status")).alias("status"), "s.indexed_at")


def first_files(files: DataFrame) -> DataFrame:
    """One row a file id: its earliest state."""
    first = F.min(F.struct("indexed_at", "path", "hash", "filename", "status")).alias("s")
    rows = files.where(F.col("id").isNotNull()).groupBy("id").agg(first)
    return rows.select("id", "s.path", F.lower("s.hash").alias("hash"), "s.filename", F.lower(F.trim("s.status")).alias("status"), "s.indexed_at")


def detect_changes(stored: DataFrame, found: DataFrame, revive_orphans: bool = False) -> DataFrame:
    """(path, id, hash, change): a full outer join of the stored files with a scan, both by path.

    change is ``new``, ``changed``, ``unchanged`` or ``missing``; a found file without a hash could not be read and is ``failed``. A file whose
    content is as stored is unchanged whatever its status, unless ``revive_orphans`` makes orphaned ones changed.
    """
    s = stored.select("path", "id", F.col("hash").alias("old"), F.col("status").alias("was"))
    f = found.select("path", F.col("hash").alias("new"), F.lit(True).alias("there"))
    same = F.col("old") == F.col("new")
    if revive_orphans:
        same = same & (F.col("was") != "orphaned")
    change = (
        F.when(F.col("there").isNull(), "missing")
        .when(F.coalesce("new", F.lit("")) == "", "failed")
        .when(F.col("id").isNull(), "new")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return s.join(f, "path", "full_outer").select("path", "id", F.coalesce("new", "old").alias("hash"), change.alias("change"))


def upsert_files(stored: DataFrame, found: DataFrame, next_id: int | None = None) -> DataFrame:
    """The files relation after a scan: known paths keep their id and take hash, file name and status ``indexed``; new ones get ids
    above the stored ones in the order of their paths; those not found stay as they are."""
    keep = stored.join(found.select("path"), "path", "left_anti").select("id", "path", "hash", "filename", "status")
    known = stored.select("id", "path").join(found.select("path", "hash"), "path")
    known = known.select("id", "path", "hash", file_name(F.col("path")).alias("filename"), F.lit("indexed").alias("status"))
    new = found.join(stored.select("path"), "path", "left_anti").select("path", "hash").distinct()
    offset = next_id - 1 if next_id is not None else (stored.agg(F.max("id")).first()[0] or 0)
    new = number_rows(new, ["path"], "id", offset)
    new = new.select("id", "path", "hash", file_name(F.col("path")).alias("filename"), F.lit("indexed").alias("status"))
    return keep.unionByName(known).unionByName(new)


def number_rows(rows: DataFrame, order: list[str], out: str, offset: int = 0) -> DataFrame:
    """rows with consecutive numbers from offset + 1 in the order of columns whose values together differ.

    The rows are cut into ranges and sorted within them, and kept so; each range's rows are counted, and what stands before a range is added to the
    numbers within it. Only the counts, one a range, meet in one place.
    """
    ranges = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33).cast("int")
    counts = sorted((r.p, r.n) for r in ranges.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], offset
    for p, n in counts:
        starts += [F.lit(p), F.lit(total).cast("bigint")]
        total += n
    before = F.create_map(*starts)[part] if starts else F.lit(offset)
    return ranges.withColumn(out, (before + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_m")


def delete_cascade(files: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) without those of the files in ``gone`` (column id); the files' rows stay."""
    dropped = chunks.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("chunk_id")).distinct()
    left = chunks.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return left, vectors.join(dropped, "chunk_id", "left_anti")


def reset_hashes(files: DataFrame) -> DataFrame:
    """Files whose status is indexed lose their hash, so that the next scan takes them as changed; orphans keep theirs."""
    return files.withColumn("hash", F.when(F.col("status") == "indexed", "").otherwise(F.col("hash")))


def indexable(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with something to index."""
    return docs.where(not_blank(F.col(text_col)))


def index_counts(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files, chunks and vectors."""
    return (
        files.agg(F.count("*").alias("n_files"))
        .crossJoin(F.broadcast(chunks.agg(F.count("*").alias("n_chunks"))))
        .crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n_vectors"))))
    )
