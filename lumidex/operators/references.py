"""References to records that do not exist.

A Bloom filter of the parent keys, built by a map-side combined bitmap aggregation, is broadcast;
a key it does not hold is certainly an orphan. Only rows whose key may be in the filter are joined
exactly with the parents, to find the filter's false positives and the parents that are deleted
or arrive after the row.

The filter is made of blocks of 32,768 bits (8 KB as 1,024 words), as many as its keys need; there are never more than
``max_blocks`` of them, so what is broadcast is bounded whatever the number of keys. Of 100 million keys it still lets only one in
twelve orphans through to the exact join; with more keys more of them: slower, never wrong.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
BITS_PER_KEY = 12
HASHES = 5
MAX_BLOCKS = 16384  # 64 MB of bits, which a broadcast holds in 128 MB: 45 million keys at 12 bits, 100 million at 5


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, HASHES + 1)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(keys: DataFrame, key: str, n_keys: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(block, words) rows of a blocked Bloom filter over ``keys[key]`` and the number of blocks."""
    blocks = max(1, min(max_blocks, ceil(BITS_PER_KEY * n_keys / BLOCK_BITS)))
    k = F.col(key)
    bits = (
        keys.where(k.isNotNull())
        .select(_block(k, blocks).alias("_block"), F.explode(F.array(*_positions(k))).alias("_pos"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_pos").alias("_bits"))
    )
    words = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK_BITS // 32 - 1)),
        lambda i: F.conv(F.hex(F.substring(F.col("_bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("bigint"),
    )
    return bits.select("_block", words.alias("_words")), blocks


def _held(words: Column, key: Column) -> Column:
    """True where all bits of the key are set. A word holds 4 bytes, the first one highest."""
    test = None
    for pos in _positions(key):
        within = pos % 32
        shift = ((F.lit(3) - F.floor(within / 8)) * 8 + within % 8).cast("int")
        word = F.get(words, F.floor(pos / 32).cast("int"))
        one = F.getbit(word, shift) == 1
        test = one if test is None else test & one
    return test


def with_bloom_test(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, n_keys: int, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """rows plus ``_maybe``: False where the key is certainly in no row of parents. No shuffle of rows."""
    bits, blocks = bloom_blocks(parents, parent_key, n_keys, max_blocks)
    k = F.col(key)
    joined = rows.withColumn("_block", _block(k, blocks)).join(F.broadcast(bits), "_block", "left")
    return joined.withColumn("_maybe", F.coalesce(_held(F.col("_words"), k), F.lit(False))).drop("_block", "_words")


def parent_states(parents: DataFrame, key: str, time: str, status: str | None = None) -> DataFrame:
    """(_key, _arrival, _orphaned) with one row per parent key: the first arrival and whether the latest row is
    orphaned; rows of one key with the same time are told apart by their status."""
    state = F.lower(F.trim(F.col(status))) if status else F.lit("indexed")
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min(time).alias("_arrival"), F.max(F.struct(F.col(time), state)).getField("col2").alias("_state"))
        .select("_key", "_arrival", (F.coalesce(F.col("_state"), F.lit("")) == "orphaned").alias("_orphaned"))
    )


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    name: str,
    row_id: str,
    key: str,
    time: str,
    parent_key: str,
    parent_time: str,
    parent_status: str | None = None,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """(ref_table, row_id, reason, period) of the rows of ``children`` whose ``key`` has no live, earlier parent.

    reason is ``missing`` (no parent row), ``deleted`` (the parent's latest status is orphaned; only with
    ``parent_status``) or ``late`` (the parent's first row is later than the child's time). Null keys refer to
    nothing and give no row; a null child or parent time is never late, its period is null; repeated rows count
    once; empty children give no rows and empty parents make every key missing. Columns are chosen by name before
    anything is joined, so others may have any name. A key that many rows share is split by the adaptive skew join.
    """
    rows = children.select(F.col(row_id).alias("_row"), F.col(key).alias("_ref"), F.col(time).alias("_time")).where(F.col("_ref").isNotNull())
    tested = with_bloom_test(rows, "_ref", parents, parent_key, parents.count(), max_blocks)
    states = parent_states(parents, parent_key, parent_time, parent_status)
    sure = tested.where(~F.col("_maybe")).select("_row", "_time", F.lit("missing").alias("reason"))
    checked = (
        tested.where("_maybe")
        .join(states, F.col("_ref") == F.col("_key"), "left")
        .select(
            "_row",
            "_time",
            F.when(F.col("_key").isNull(), "missing")
            .when(F.col("_orphaned"), "deleted")
            .when(F.col("_arrival") > F.col("_time"), "late")
            .alias("reason"),
        )
        .where(F.col("reason").isNotNull())
    )
    return (
        sure.unionByName(checked)
        .select(F.lit(name).alias("ref_table"), F.col("_row").cast("bigint").alias("row_id"), "reason", F.date_format("_time", "yyyy-MM").alias("period"))
        .distinct()
    )


def index_references(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Orphan references of an index: chunks to files and vectors to chunks."""
    a = orphan_references(
        chunks, files, name="chunks", row_id="id", key="file_id", time="indexed_at", parent_key="id", parent_time="indexed_at", parent_status="status"
    )
    b = orphan_references(
        vectors, chunks, name="vec_chunks", row_id="chunk_id", key="chunk_id", time="embedded_at", parent_key="id", parent_time="indexed_at"
    )
    return a.unionByName(b)


def reference_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_rows"))
