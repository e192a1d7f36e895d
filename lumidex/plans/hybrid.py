"""The tiered search: file names, then BM25, then vectors, each filling what the ones before left open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.text import query_words_of, snippet_head
from lumidex.operators.embedding import HashingEmbedder
from lumidex.operators.filename import all_words_matches, any_word_matches, substring_matches
from lumidex.operators.fulltext import best_per_file, bm25, keyword_score, rank_within
from lumidex.operators.knn import nearest

COLUMNS = ["tier", "pos", "path", "filename", "score", "chunk_id"]


def _waterfall(rows: DataFrame, k: int) -> DataFrame:
    """The first k paths by (tier, pos); for the few rows behind the tiers' limits."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("tier", "pos"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r").orderBy("tier", "pos").limit(k)


def filename_tiers(files: DataFrame, query: str, k: int, live_paths: DataFrame | None = None) -> DataFrame:
    """(tier, pos, path, filename, score, chunk_id) of the up to k best file-name matches. A tier counts only if those before leave places."""
    tiers = [substring_matches(files, query, k), all_words_matches(files, query, k), any_word_matches(files, query, k)]
    rows = None
    for tier, hits in enumerate(tiers, 1):
        hits = rank_within(hits, ["id"]).withColumn("tier", F.lit(tier)).withColumn("chunk_id", F.lit(None).cast("bigint"))
        rows = hits if rows is None else rows.unionByName(hits)
    if live_paths is not None:
        rows = rows.join(live_paths.select("path").distinct(), "path", "left_semi")
    return _waterfall(rows.select("id", *COLUMNS), k)


def hybrid_search(
    files: DataFrame, chunks: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, top_k: int = 5, live_paths: DataFrame | None = None, ranked: DataFrame | None = None
) -> DataFrame:
    """(tier, pos, path, filename, score, snippet) of the up to top_k results, in the order of the tiers.

    ``files`` holds one row an id, ``chunks`` and ``vectors`` one row a key; ``query_vector`` is one row (column query); ``ranked`` (chunk_id, rank) comes from
    stored postings where there are some. Of BM25 three times, of the vectors five times the open places are looked at before files found already
    are left out, so a tier may fill fewer places than it could. What is behind a tier's limit, a few times top_k rows, is kept as a local
    relation, and a tier is only asked if places are open. A blank query gives no rows.
    """
    spark = files.sparkSession
    if not query.strip():
        return spark.createDataFrame([], "tier int, pos int, path string, filename string, score double, snippet string")
    shape = "tier int, pos int, path string, filename string, score double, chunk_id bigint"

    def live(rows: DataFrame) -> DataFrame:
        return rows if live_paths is None else rows.join(live_paths.select("path").distinct(), "path", "left_semi")

    def kept(rows: DataFrame, schema: str) -> tuple[DataFrame, int]:
        few = rows.collect()
        return spark.createDataFrame(few, schema), len(few)

    names, n = kept(filename_tiers(files, query, top_k, live_paths).select("id", *COLUMNS), f"id bigint, {shape}")
    heads = chunks.where("chunk_index = 0").select(F.col("file_id").alias("id"), F.col("id").alias("_head")).join(F.broadcast(names.select("id")), "id", "left_semi")
    names = names.drop("chunk_id").join(heads, "id", "left").groupBy("tier", "pos", "path", "filename", "score").agg(F.min("_head").alias("chunk_id"))
    found = names.select(*COLUMNS)

    where = chunks.select(F.col("id").alias("chunk_id"), "file_id")
    state = files.select(F.col("id").alias("file_id"), "path", "filename", F.lower(F.trim("status")).alias("status"))
    if n < top_k:
        ranked = bm25(chunks, query) if ranked is None else ranked
        ranked = ranked.join(where, "chunk_id").join(state, "file_id").where("status = 'indexed'").select("chunk_id", "file_id", "path", "filename", F.round("rank", 6).alias("rank"))
        ranked = ranked.orderBy("rank", "chunk_id").limit(3 * top_k)
        ranked = kept(ranked, "chunk_id bigint, file_id bigint, path string, filename string, rank double")[0]
        ranked = live(rank_within(ranked, ["rank", "chunk_id"]).where(f"pos <= {3 * (top_k - n)}").join(names.select("path"), "path", "left_anti"))
        best = best_per_file(ranked).select("file_id", "chunk_id")
        words = ranked.join(best, ["file_id", "chunk_id"]).withColumn("tier", F.lit(4)).withColumn("score", keyword_score(F.col("rank")))
        found, n = kept(_waterfall(found.unionByName(words.select(*COLUMNS)), top_k), shape)
    if n < top_k:
        near = kept(nearest(vectors, query_vector, 5 * top_k), "chunk_id bigint, distance double")[0]
        near = rank_within(near, ["distance", "chunk_id"]).where(f"pos <= {5 * (top_k - n)}")
        near = F.broadcast(near).join(where, "chunk_id").join(state, "file_id")
        near = live(near.join(found.select("path"), "path", "left_anti")).withColumn("tier", F.lit(5)).withColumn("score", F.round(1 - F.col("distance"), 4))
        found = _waterfall(found.unionByName(near.select(*COLUMNS)), top_k)

    found = kept(found, shape)[0]
    texts = chunks.select(F.col("id").alias("chunk_id"), "text").join(F.broadcast(found.select("chunk_id")), "chunk_id", "left_semi")
    shown = found.join(texts, "chunk_id", "left").withColumn("snippet", snippet_head(F.col("text")))
    return shown.select("tier", "pos", "path", "filename", "score", "snippet")


def text_search(files: DataFrame, chunks: DataFrame, vectors: DataFrame, query: str, embedder=None, top_k: int = 5, **options) -> DataFrame:
    """``hybrid_search`` of a text alone: what is embedded for the vector tier is the query without its filler words."""
    spark = files.sparkSession
    cleaned = " ".join(query_words_of(query)) or query
    vector = (embedder or HashingEmbedder()).embed([cleaned])[0]
    return hybrid_search(files, chunks, vectors, query, spark.createDataFrame([(vector.tolist(),)], "query array<float>"), top_k, **options)
