"""Exact nearest vectors of one query and of many."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.vectors import cosine_distance, l2_distance

MARGIN = 16  # candidates beyond k whose distances are taken exactly


def nearest(vectors: DataFrame, query: DataFrame, k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(id, distance) of the k nearest vectors to the one row of ``query`` (column ``query``); equal distances by id.

    The query is one row, so its broadcast is bounded; each task keeps its own k best before they meet.
    """
    one = query.select(F.col("query")).limit(1)
    distance = {"l2": l2_distance, "cosine": cosine_distance}[metric](F.col(vector_col), F.col("query"))
    rows = vectors.crossJoin(F.broadcast(one)).select(F.col(id_col), F.round(distance, 6).alias("distance"))
    return rows.orderBy("distance", id_col).limit(k)


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", block: int = 4000) -> DataFrame:
    """(query_id, id, distance) of the k vectors nearest to each of the queries (query_id, query) by L2; equal distances by id.

    The vectors are read once for each block of queries, which is broadcast and has at most ``block`` rows; each task keeps the k best of each
    query before they meet. Vectors and queries must be of one length without nulls.
    """
    spark = vectors.sparkSession
    shape = f"query_id bigint, {id_col} bigint, distance double"
    rows = vectors.select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>"))
    asked = queries.select(F.col("query_id").cast("bigint"), F.col("query").cast("array<double>")).orderBy("query_id").toLocalIterator()
    out = None
    while some := list(itertools.islice(asked, block)):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some])))
        part = rows.mapInArrow(_block_search(shared, k, id_col), shape)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], shape)
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", id_col))), 1, k).alias("b"))
    return best.select("query_id", F.explode("b").alias("b")).select("query_id", f"b.{id_col}", "b.distance")


def _block_search(shared, k: int, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        squares = (queries**2).sum(axis=1)[:, None]
        held = np.empty((len(names), 0), np.int64), np.empty((len(names), 0))
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                # Products choose a few more than k; their distances are taken of differences, in which near-equal vectors lose no digits.
                far = np.sqrt(np.maximum(squares + (x**2).sum(axis=1) - 2 * queries @ x.T, 0)).round(6)
                top = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, : k + MARGIN]
                d = np.concatenate([np.sqrt(((x[top[q : q + 64]] - queries[q : q + 64, None]) ** 2).sum(axis=2)) for q in range(0, len(names), 64)]).round(6)
                ids, d = np.concatenate([held[0], ids[top]], axis=1), np.concatenate([held[1], d], axis=1)
                order = np.lexsort((ids, d), axis=1)[:, :k]
                held = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        n = held[0].shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(held[0].ravel()), pa.array(held[1].ravel())], names=["query_id", id_col, "distance"])

    return run


def mean_pool(vectors: DataFrame, group_col: str, vector_col: str = "embedding") -> DataFrame:
    """(group, position, value): the mean of each group's vectors by position, partial sums before the shuffle."""
    rows = vectors.select(F.col(group_col), F.posexplode(vector_col).alias("position", "x"))
    return rows.groupBy(group_col, "position").agg(F.avg(F.col("x").cast("double")).alias("value"))
