"""The registered queries of the search engine over the index tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.config import CUTOFF, FILLERS
from lumidex.functions.text import FOLD_FROM, FOLD_TO, clean_query, query_words, query_words_of
from lumidex.functions.vectors import norm, usable
from lumidex.operators import fulltext, indexing, knn, maintenance, presentation
from lumidex.operators.chunking import chunk
from lumidex.operators.embedding import HashingEmbedder, embed_column
from lumidex.operators.filename import all_words_matches, any_word_matches, substring_matches
from lumidex.plans.hybrid import filename_tiers, hybrid_search, text_search
from lumidex.session import spread_out, table
from lumidex.sources.files import is_excluded, is_supported
from lumidex.streaming import events as ev

QUERY, NAME_QUERY, PHRASE = "heavy terminal", "final pdf", "without any delay"
SUPPORTED_SQL = "lower(regexp_extract({0}, '(\\.[^./]+)$', 1)) IN ('.pdf', '.docx', '.txt', '.md')"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return indexing.current_files(table(spark, folder, "files"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without repeated rows; ids tell them apart, so that only the columns that are asked for are shuffled."""
    return table(spark, folder, "chunks").select("id", "file_id", "chunk_index", "text").dropDuplicates(["id"])


def bm25(spark: SparkSession, folder: str, query: str) -> DataFrame:
    return fulltext.bm25(spread_out(table(spark, folder, "chunks").select("id", "text")), query, repeated=True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_out(table(spark, folder, "documents").select("doc_id", "text"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "vec_chunks").where(F.col("chunk_id").isNotNull() & usable(F.col("embedding"), 384))
    return rows.groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))


def query_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The vector with the smallest id, as a query."""
    rows = table(spark, folder, "vec_chunks").where(usable(F.col("embedding"), 384))
    return rows.agg(F.min(F.struct("chunk_id", "embedding")).alias("s")).select(F.col("s.embedding").alias("query"))


FILES = "f AS (SELECT id, s.path AS path, lower(s.hash) AS hash, s.filename AS filename, lower(trim(s.status)) AS status, s.indexed_at AS indexed_at FROM (SELECT id, {0}(struct_pack(indexed_at := indexed_at, path := path, hash := hash, filename := filename, status := status)) AS s FROM files WHERE id IS NOT NULL GROUP BY id))"
F_NOW, F_FIRST = FILES.format("max"), FILES.format("min")
C = "c AS (SELECT DISTINCT id, file_id, chunk_index, text FROM chunks)"
V = "v AS (SELECT chunk_id, min(embedding::DOUBLE[]) AS embedding FROM vec_chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id), q AS (SELECT embedding AS q FROM v ORDER BY chunk_id LIMIT 1)"
WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
FILLER_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(FILLERS)) + "]"
QWORDS = f"list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: w <> '' AND NOT list_contains({FILLER_LIST}, w) AND length(w) > 1)"
TOK = f"tok AS (SELECT id AS chunk_id, regexp_extract_all(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS t FROM c WHERE text IS NOT NULL)"
ASCII = "translate(filename, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bm25_sql(words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}'))::DOUBLE AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0::DOUBLE ELSE 0 END) AS df{i}" for i in range(len(words)))
    idf = "CASE WHEN ln((n - df{0} + 0.5) / (df{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{0} + 0.5) / (df{0} + 0.5)) END"
    score = " + ".join(f"({idf.format(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / av))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"{TOK}, k AS (SELECT chunk_id, len(t)::DOUBLE AS len, {tf} FROM tok), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS av, {df} FROM k), bm AS (SELECT chunk_id, round(-({score}), 6) AS rank FROM k, st WHERE {some})"


BM25 = _bm25_sql(QUERY.split())
NAMES = [w for w in NAME_QUERY.split()]
LIVE = "f.status = 'indexed' AND filename IS NOT NULL"
T1 = f"SELECT id, path, filename, 1.0::DOUBLE AS score FROM f WHERE {LIVE} AND {ASCII} LIKE '%{NAMES[0]}%' ORDER BY id LIMIT 10"
T2 = f"SELECT id, path, filename, 0.95::DOUBLE AS score FROM f WHERE {LIVE} AND " + " AND ".join(f"{ASCII} LIKE '%{w}%'" for w in NAMES) + " ORDER BY id LIMIT 10"


def _any_sql(words: list[str], k: int) -> str:
    share = " + ".join(f"contains(lower(filename), '{w}')::INT" for w in words)
    some = " OR ".join(f"{ASCII} LIKE '%{w}%'" for w in words)
    return f"SELECT id, path, filename, round(0.8 + 0.1 * (({share}) / {len(words)}.0::DOUBLE), 4) AS score FROM f WHERE {LIVE} AND ({some}) ORDER BY id LIMIT {2 * k}"


def _tiers_sql(query: str, k: int) -> str:
    words = query_words_of(query)
    all_words = " AND ".join(f"{ASCII} LIKE '%{w}%'" for w in words) if len(words) > 1 else "false"
    return f"""t1 AS (SELECT 1 AS tier, row_number() OVER (ORDER BY id) AS pos, * FROM (SELECT id, path, filename, 1.0::DOUBLE AS score FROM f WHERE {LIVE} AND {ASCII} LIKE '%{query}%' ORDER BY id LIMIT {k})
      UNION ALL SELECT 2, row_number() OVER (ORDER BY id), * FROM (SELECT id, path, filename, 0.95::DOUBLE AS score FROM f WHERE {LIVE} AND {all_words} ORDER BY id LIMIT {k})
      UNION ALL SELECT 3, row_number() OVER (ORDER BY id), * FROM ({_any_sql(words, k)})),
    names AS (SELECT tier, pos, id, path, filename, score FROM t1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY tier, pos) = 1 ORDER BY tier, pos LIMIT {k})"""


def _hybrid_sql(query: str, k: int, vector: str = "") -> str:
    v = f"{V.partition(', q AS')[0]}, q AS (SELECT {vector} AS q)" if vector else V
    return f"""{F_NOW}, {C}, {v}, {_bm25_sql(query_words_of(query))}, {_tiers_sql(query, k)},
    n1 AS (SELECT tier, pos, path, filename, score, (SELECT min(c.id) FROM c WHERE c.file_id = names.id AND c.chunk_index = 0) AS chunk_id FROM names),
    r AS (SELECT bm.chunk_id, rank, c.file_id, f.path, f.filename FROM bm JOIN c ON c.id = bm.chunk_id JOIN f ON f.id = c.file_id WHERE f.status = 'indexed' ORDER BY rank, bm.chunk_id LIMIT {3 * k}),
    r1 AS (SELECT *, row_number() OVER (ORDER BY rank, chunk_id) AS pos FROM r),
    r2 AS (SELECT * FROM r1 WHERE pos <= 3 * ({k} - (SELECT count(*) FROM n1)) AND path NOT IN (SELECT path FROM n1) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY rank, chunk_id) = 1),
    s1 AS (SELECT * FROM (SELECT * FROM n1 UNION ALL SELECT 4, pos, path, filename, round(least(0.85, greatest(0.5, 1 + rank * 0.05)), 4), chunk_id FROM r2)
           QUALIFY row_number() OVER (PARTITION BY path ORDER BY tier, pos) = 1 ORDER BY tier, pos LIMIT {k}),
    d AS (SELECT chunk_id, round(list_distance(embedding, q), 6) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT {5 * k}),
    d1 AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS pos FROM d),
    d2 AS (SELECT 5 AS tier, d1.pos, f.path, f.filename, round(1 - distance, 4) AS score, d1.chunk_id FROM d1 JOIN c ON c.id = d1.chunk_id JOIN f ON f.id = c.file_id
           WHERE d1.pos <= 5 * ({k} - (SELECT count(*) FROM s1)) AND f.path NOT IN (SELECT path FROM s1)),
    found AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM d2) QUALIFY row_number() OVER (PARTITION BY path ORDER BY tier, pos) = 1 ORDER BY tier, pos LIMIT {k}),
    shown AS (SELECT tier::INT AS tier, pos::INT AS pos, path, filename, score,
           regexp_replace(regexp_replace(replace(substring(coalesce(c.text, ''), 1, 300), chr(10), ' '), '^\\s+', ''), '\\s+$', '') AS snippet
           FROM found LEFT JOIN c ON c.id = found.chunk_id)"""


HYBRID_QUERY, TEXT_QUERY, K = "heavy terminal", "show the heavy terminal", 40


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    return hybrid_search(files(s, d), chunks(s, d), vectors(s, d), HYBRID_QUERY, query_vector(s, d), K, ranked=bm25(s, d, HYBRID_QUERY))


def _scan(s, d):
    rows = files(s, d).where(is_supported(F.col("path")) & ~is_excluded(F.col("path"), ("Archive", "Inbox")))
    return rows.select("id", "path")


def _snapshots(s, d):
    raw = table(s, d, "files")
    return indexing.first_files(raw).where("indexed_at < timestamp'2025-01-01'"), indexing.current_files(raw)


def _changes(s, d):
    before, now = _snapshots(s, d)
    return indexing.detect_changes(before, now.where("status = 'indexed'")).groupBy("change").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_paths"))


def _upsert(s, d):
    before, now = _snapshots(s, d)
    now = now.where("status = 'indexed' and hash <> ''").groupBy("path").agg(F.max("hash").alias("hash"))
    before = before.groupBy("path").agg(F.min("id").alias("id"), F.min("hash").alias("hash"), F.min("filename").alias("filename"), F.min("status").alias("status"))
    return indexing.upsert_files(before, now)


def _cascade(s, d):
    gone = files(s, d).where("status = 'orphaned'").select("id")
    left, vecs = indexing.delete_cascade(files(s, d), chunks(s, d), vectors(s, d), gone)
    return left.agg(F.count("*").alias("n_chunks"), F.sum("id").alias("ids")).crossJoin(F.broadcast(vecs.agg(F.count("*").alias("n_vectors"))))


def _bm25_rows(s, d):
    where = chunks(s, d).select(F.col("id").alias("chunk_id"), "file_id")
    return bm25(s, d, QUERY).withColumn("rank", F.round("rank", 6)).join(where, "chunk_id")


def _relocate(s, d):
    """Orphaned files, found again below another root by their names and contents."""
    now = files(s, d).where("hash <> ''")
    there = now.select(F.concat(F.lit("/restored"), "path").alias("path"), "filename", "hash")
    return maintenance.relocate(now.where("status = 'orphaned'").select("id", "path", "filename", "hash"), there)


def _modified_content(s, d):
    before, now = _snapshots(s, d)
    stored = before.groupBy("path").agg(F.min("hash").alias("hash"))
    return ev.modified_content(_events(s, d), stored, now.where("status = 'indexed'").groupBy("path").agg(F.max("hash").alias("hash")))


def _bm25_of_postings(s, d):
    rows = chunks(s, d)
    return fulltext.bm25_of_postings(fulltext.build_postings(rows), fulltext.corpus_statistics(rows), QUERY).withColumn("rank", F.round("rank", 6))


def _nearest_to_each(s, d):
    rows = vectors(s, d)
    return knn.nearest_to_each(rows, rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")), 10)


def _events(s, d):
    return table(s, d, "fs_events")


QUERIES = {
    "scan_supported_files": _scan,
    "content_hash": lambda s, d: documents(s, d).select("doc_id", F.sha2("text", 256).alias("hash")),
    "chunk_words": lambda s, d: chunk(documents(s, d), "doc_id", "text", 100, 20),
    "chunk_counts": lambda s, d: chunk(documents(s, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_chunks")),
    "first_chunk_left_join": lambda s, d: (
        files(s, d).select("id", "path").join(chunks(s, d).where("chunk_index = 0").select(F.col("file_id").alias("id"), F.col("id").alias("chunk_id")), "id", "left")
    ),
    "change_detection": _changes,
    "upsert_files": _upsert,
    "delete_cascade": _cascade,
    "reset_hashes": lambda s, d: indexing.reset_hashes(files(s, d)).select("id", "hash", "status"),
    "index_counts": lambda s, d: indexing.index_counts(files(s, d), chunks(s, d), vectors(s, d)),
    "filename_substring": lambda s, d: substring_matches(files(s, d), NAMES[0], 10),
    "filename_all_words": lambda s, d: all_words_matches(files(s, d), NAME_QUERY, 10),
    "filename_any_word": lambda s, d: any_word_matches(files(s, d), NAME_QUERY, 10),
    "filename_waterfall": lambda s, d: filename_tiers(files(s, d), NAME_QUERY, 12).select("tier", "pos", "path", "score"),
    "clean_query": lambda s, d: documents(s, d).select("doc_id", F.array_join(query_words(F.col("text")), " ").alias("words")),
    "clean_query_fallback": lambda s, d: documents(s, d).select("doc_id", clean_query(F.col("text")).alias("cleaned")),
    "fts_term_statistics": lambda s, d: fulltext.term_statistics(chunks(s, d)),
    "fts_corpus_statistics": lambda s, d: fulltext.corpus_statistics(chunks(s, d)).withColumn("mean_length", F.round("mean_length", 6)),
    "bm25_topk": lambda s, d: _bm25_rows(s, d).orderBy("rank", "chunk_id").limit(50),
    "bm25_best_chunk_per_file": lambda s, d: fulltext.best_per_file(_bm25_rows(s, d)),
    "bm25_score_band": lambda s, d: _bm25_rows(s, d).select("chunk_id", fulltext.keyword_score(F.col("rank")).alias("score")),
    "bm25_of_postings": _bm25_of_postings,
    "phrase_match": lambda s, d: fulltext.phrase_match(chunks(s, d), PHRASE),
    "snippets": lambda s, d: fulltext.with_snippets(_bm25_rows(s, d).orderBy("rank", "chunk_id").limit(50).join(chunks(s, d).select(F.col("id").alias("chunk_id"), "text"), "chunk_id"), QUERY).select("chunk_id", "snippet"),
    "knn_l2": lambda s, d: knn.nearest(vectors(s, d), query_vector(s, d), 25),
    "knn_l2_of_many": _nearest_to_each,
    "knn_cosine": lambda s, d: knn.nearest(vectors(s, d), query_vector(s, d), 25, metric="cosine"),
    "knn_best_per_file": lambda s, d: (
        knn.nearest(vectors(s, d), query_vector(s, d), 100).join(chunks(s, d).select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").where("file_id is not null")
        .groupBy("file_id").agg(F.min(F.struct("distance", "chunk_id")).alias("b")).select("file_id", "b.chunk_id", F.round(1 - F.col("b.distance"), 4).alias("score"))
    ),
    "vector_norms": lambda s, d: vectors(s, d).select("chunk_id", F.round(norm(F.col("embedding")), 6).alias("norm")),
    "mean_pool_by_file": lambda s, d: (
        knn.mean_pool(vectors(s, d).join(chunks(s, d).select(F.col("id").alias("chunk_id"), "file_id"), "chunk_id").where("file_id is not null"), "file_id").withColumn("value", F.round("value", 6))
    ),
    "hybrid_search": _hybrid,
    "text_search": lambda s, d: text_search(files(s, d), chunks(s, d), vectors(s, d), TEXT_QUERY, top_k=K, ranked=bm25(s, d, TEXT_QUERY)),
    "cutoff_and_ranks": lambda s, d: presentation.presented(presentation.cut(_hybrid(s, d), ["tier", "pos"]), ["tier", "pos"]).select("rank", "path", "score", "alpha", "subtitle_alpha", "badge", "subtitle"),
    "relocate_by_hash": _relocate,
    "mark_orphans": lambda s, d: maintenance.mark_orphans(files(s, d), ev.fold_events(_events(s, d)).where("status = 'indexed'")).select("id", "path", "status"),
    "live_path_filter": lambda s, d: maintenance.only_live(files(s, d), ev.fold_events(_events(s, d)).where("status = 'indexed'")).select("id", "path"),
    "events_fold": lambda s, d: ev.fold_events(_events(s, d)).select("path", "status", "event_id"),
    "events_stream": lambda s, d: ev.streamed_state(s, f"{d}/fs_events.parquet").select("path", "status", "event_id"),
    "events_modified": lambda s, d: ev.changed_modifications(_events(s, d)),
    "events_modified_content": _modified_content,
    "events_debounced": lambda s, d: ev.debounce(_events(s, d).where("src_path is not null").select("event_id", "src_path", "event_at").distinct(), "src_path", "event_at", "event_id", "6 HOURS").select("event_id", "src_path"),
    "events_latest": lambda s, d: ev.latest_generation(_events(s, d).where("src_path is not null"), "src_path", "event_at", "event_id").select("src_path", "event_id"),
    "embed_documents": lambda s, d: embed_column(chunk(documents(s, d), "doc_id", "text"), "text").select("doc_id", "chunk_index", "embedding"),
}

EFFECTS = f"""e AS (SELECT lower(trim(kind)) AS kind, src_path, dest_path, event_at, event_id FROM fs_events WHERE NOT coalesce(is_directory, false) AND src_path IS NOT NULL),
x AS (SELECT src_path AS path, CASE WHEN kind IN ('created', 'modified') THEN 'indexed' ELSE 'orphaned' END AS status, event_at, event_id FROM e WHERE kind IN ('created', 'modified', 'deleted') AND {SUPPORTED_SQL.format('src_path')}
 UNION ALL SELECT src_path, CASE WHEN coalesce({SUPPORTED_SQL.format('dest_path')}, false) THEN 'moved' ELSE 'orphaned' END, event_at, event_id FROM e WHERE kind = 'moved'
 UNION ALL SELECT dest_path, 'indexed', event_at, event_id FROM e WHERE kind = 'moved' AND {SUPPORTED_SQL.format('dest_path')}),
state AS (SELECT path, max(struct_pack(event_at := event_at, event_id := event_id, status := status)) AS s FROM x GROUP BY path)"""
FOLD_SQL = f"WITH {EFFECTS} SELECT path, s.status AS status, s.event_id AS event_id FROM state"
VECTOR = str(HashingEmbedder().embed([" ".join(query_words_of(TEXT_QUERY))])[0].tolist()) + "::FLOAT[]::DOUBLE[]"
BEFORE = f"b0 AS (SELECT id, s.path AS path, lower(s.hash) AS hash FROM ({F_FIRST.partition(' FROM (')[2].rpartition(')')[0]} WHERE s.indexed_at < TIMESTAMP '2025-01-01')"
BEST = "SELECT file_id, s.chunk_id AS chunk_id, s.rank AS rank FROM (SELECT file_id, min(struct_pack(rank := rank, chunk_id := chunk_id)) AS s FROM bm JOIN c ON c.id = bm.chunk_id GROUP BY file_id)"

ORACLES = {
    "scan_supported_files": f"WITH {F_NOW} SELECT id, path FROM f WHERE {SUPPORTED_SQL.format('path')} AND NOT list_contains(string_split(path, '/'), 'Archive') AND NOT list_contains(string_split(path, '/'), 'Inbox')",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "chunk_words": f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 80)) AS st FROM w WHERE len(w) > 0) SELECT doc_id, (st // 80)::INT AS chunk_index, array_to_string(w[st + 1 : st + 100], ' ') AS text FROM s",
    "chunk_counts": f"SELECT doc_id, ceil(len({WORDS.format('text')}) / 450.0)::BIGINT AS n_chunks FROM documents WHERE text IS NOT NULL AND len({WORDS.format('text')}) > 0",
    "first_chunk_left_join": f"WITH {F_NOW}, {C} SELECT f.id, f.path, c.id AS chunk_id FROM f LEFT JOIN c ON c.file_id = f.id AND c.chunk_index = 0",
    "change_detection": f"""WITH {F_NOW}, b AS (SELECT id, s.path AS path, lower(s.hash) AS hash FROM (SELECT id, min(struct_pack(indexed_at := indexed_at, path := path, hash := hash, filename := filename, status := status)) AS s FROM files WHERE id IS NOT NULL GROUP BY id) WHERE s.indexed_at < TIMESTAMP '2025-01-01'),
        n AS (SELECT path, hash FROM f WHERE status = 'indexed'),
        j AS (SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN coalesce(n.hash, '') = '' THEN 'failed' WHEN b.id IS NULL THEN 'new' WHEN b.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL OUTER JOIN n ON b.path = n.path)
        SELECT change, count(*) AS n, count(DISTINCT path) AS n_paths FROM j GROUP BY change""",
    "upsert_files": f"""WITH {F_NOW}, b0 AS (SELECT id, s.path AS path, lower(s.hash) AS hash, s.filename AS filename, lower(trim(s.status)) AS status FROM (SELECT id, min(struct_pack(indexed_at := indexed_at, path := path, hash := hash, filename := filename, status := status)) AS s FROM files WHERE id IS NOT NULL GROUP BY id) WHERE s.indexed_at < TIMESTAMP '2025-01-01'),
        b AS (SELECT path, min(id) AS id, min(hash) AS hash, min(filename) AS filename, min(status) AS status FROM b0 GROUP BY path),
        n AS (SELECT path, max(hash) AS hash FROM f WHERE status = 'indexed' AND hash <> '' GROUP BY path)
        SELECT id, path, hash, filename, status FROM b WHERE path NOT IN (SELECT path FROM n)
        UNION ALL SELECT b.id, n.path, n.hash, string_split(n.path, '/')[-1], 'indexed' FROM b JOIN n ON b.path = n.path
        UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM b) + row_number() OVER (ORDER BY path), path, hash, string_split(path, '/')[-1], 'indexed' FROM n WHERE path NOT IN (SELECT path FROM b)""",
    "delete_cascade": f"WITH {F_NOW}, {C}, {V}, g AS (SELECT id FROM f WHERE status = 'orphaned') SELECT (SELECT count(*) FROM c WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g)) AS n_chunks, (SELECT sum(id)::BIGINT FROM c WHERE file_id IS NULL OR file_id NOT IN (SELECT id FROM g)) AS ids, (SELECT count(*) FROM v WHERE chunk_id NOT IN (SELECT c.id FROM c WHERE file_id IN (SELECT id FROM g))) AS n_vectors",
    "reset_hashes": f"WITH {F_NOW} SELECT id, CASE WHEN status = 'indexed' THEN '' ELSE hash END AS hash, status FROM f",
    "index_counts": f"WITH {F_NOW}, {C}, {V} SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM c) AS n_chunks, (SELECT count(*) FROM v) AS n_vectors",
    "filename_substring": f"WITH {F_NOW} {T1}",
    "filename_all_words": f"WITH {F_NOW} {T2}",
    "filename_any_word": f"WITH {F_NOW} {_any_sql(NAMES, 10)}",
    "filename_waterfall": f"WITH {F_NOW}, {_tiers_sql(NAME_QUERY, 12)} SELECT tier, pos, path, score FROM names",
    "clean_query": f"SELECT doc_id, array_to_string({QWORDS.replace('query_text', 'text')}, ' ') AS words FROM documents",
    "clean_query_fallback": f"SELECT doc_id, CASE WHEN len({QWORDS.replace('query_text', 'text')}) > 0 THEN array_to_string({QWORDS.replace('query_text', 'text')}, ' ') ELSE text END AS cleaned FROM documents",
    "fts_term_statistics": f"WITH {C}, {TOK}, x AS (SELECT chunk_id, unnest(t) AS term FROM tok) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM x GROUP BY term",
    "fts_corpus_statistics": f"WITH {C}, {TOK} SELECT count(*) AS n_chunks, round(avg(len(t)::DOUBLE), 6) AS mean_length FROM tok",
    "bm25_topk": f"WITH {C}, {BM25} SELECT bm.chunk_id, rank, file_id FROM bm JOIN c ON c.id = bm.chunk_id ORDER BY rank, bm.chunk_id LIMIT 50",
    "bm25_best_chunk_per_file": f"WITH {C}, {BM25} {BEST}",
    "bm25_score_band": f"WITH {C}, {BM25} SELECT chunk_id, round(least(0.85, greatest(0.5, 1 + rank * 0.05)), 4) AS score FROM bm",
    "phrase_match": f"WITH {C}, {TOK} SELECT DISTINCT chunk_id FROM tok WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' {PHRASE} ')",
    "knn_l2": f"WITH {V} SELECT chunk_id, round(list_distance(embedding, q), 6) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT 25",
    "knn_l2_of_many": f"WITH {V}, a AS (SELECT chunk_id AS query_id, embedding AS e FROM v WHERE chunk_id % 50 = 0), d AS (SELECT query_id, chunk_id, round(list_distance(embedding, e), 6) AS distance FROM v, a) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 10",
    "bm25_of_postings": f"WITH {C}, {BM25} SELECT chunk_id, rank FROM bm",
    "knn_cosine": f"WITH {V} SELECT chunk_id, round(1 - list_inner_product(embedding, q) / greatest(sqrt(list_inner_product(embedding, embedding)) * sqrt(list_inner_product(q, q)), 1e-12), 6) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT 25",
    "knn_best_per_file": f"WITH {C}, {V}, n AS (SELECT chunk_id, round(list_distance(embedding, q), 6) AS distance FROM v, q ORDER BY distance, chunk_id LIMIT 100), b AS (SELECT file_id, min(struct_pack(distance := distance, chunk_id := chunk_id)) AS s FROM n JOIN c ON c.id = n.chunk_id WHERE file_id IS NOT NULL GROUP BY file_id) SELECT file_id, s.chunk_id AS chunk_id, round(1 - s.distance, 4) AS score FROM b",
    "vector_norms": f"WITH {V} SELECT chunk_id, round(sqrt(list_inner_product(embedding, embedding)), 6) AS norm FROM v",
    "mean_pool_by_file": f"WITH {C}, {V}, x AS (SELECT file_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS position FROM v JOIN c ON c.id = v.chunk_id WHERE file_id IS NOT NULL) SELECT file_id, position::INT AS position, round(avg(e), 6) AS value FROM x GROUP BY ALL",
    "hybrid_search": f"WITH {_hybrid_sql(HYBRID_QUERY, K)} SELECT * FROM shown",
    "text_search": f"WITH {_hybrid_sql(TEXT_QUERY, K, VECTOR)} SELECT * FROM shown",
    "cutoff_and_ranks": f"""WITH {_hybrid_sql(HYBRID_QUERY, K)}, a AS (SELECT *, first_value(score) OVER (ORDER BY tier, pos) AS fs FROM shown),
        b AS (SELECT *, row_number() OVER (ORDER BY tier, pos) - 1 AS rank, count(*) OVER () AS n FROM a WHERE fs < {CUTOFF} OR score >= {CUTOFF}),
        g AS (SELECT *, CASE WHEN n <= 1 THEN 232 ELSE trunc(232 - rank / (n - 1)::DOUBLE * 102)::INT END AS alpha, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM b)
        SELECT rank::INT AS rank, path, score, alpha, greatest(80, alpha - 100) AS subtitle_alpha, CASE WHEN ext = '.pdf' THEN 'PDF' WHEN ext IN ('.docx', '.doc') THEN 'DOC' WHEN ext = '.txt' THEN 'TXT' WHEN ext = '.md' THEN 'MD' ELSE 'FILE' END AS badge,
        CASE WHEN snippet <> '' THEN substring(snippet, 1, 95) ELSE string_split(path, '/')[-2] END AS subtitle FROM g""",
    "relocate_by_hash": f"WITH {F_NOW}, m AS (SELECT m.id, m.path AS old_path, min('/restored' || c.path) AS path FROM f m JOIN f c ON m.hash = c.hash AND m.filename = c.filename WHERE m.hash <> '' AND m.status = 'orphaned' GROUP BY ALL) SELECT s.id AS id, s.old_path AS old_path, path FROM (SELECT path, min(struct_pack(id := id, old_path := old_path)) AS s FROM m GROUP BY path)",
    "mark_orphans": f"WITH {F_NOW}, {EFFECTS} SELECT id, f.path, CASE WHEN f.path IN (SELECT path FROM state WHERE s.status = 'indexed') THEN f.status ELSE 'orphaned' END AS status FROM f",
    "live_path_filter": f"WITH {F_NOW}, {EFFECTS} SELECT id, f.path FROM f WHERE f.path IN (SELECT path FROM state WHERE s.status = 'indexed')",
    "events_fold": FOLD_SQL,
    "events_stream": FOLD_SQL,
    "events_modified": f"WITH m AS (SELECT DISTINCT * FROM fs_events WHERE lower(trim(kind)) = 'modified' AND NOT coalesce(is_directory, false) AND {SUPPORTED_SQL.format('src_path')}), b AS (SELECT *, lag(event_at) OVER (PARTITION BY src_path ORDER BY event_at, event_id) AS b FROM m) SELECT event_id, src_path FROM b WHERE b IS NULL OR event_at >= b + INTERVAL 1 SECOND",
    "events_modified_content": f"WITH {F_NOW}, {BEFORE}, b AS (SELECT path, min(hash) AS hash FROM b0 GROUP BY path), n AS (SELECT path, max(hash) AS hash FROM f WHERE status = 'indexed' GROUP BY path HAVING max(hash) <> '') SELECT n.path, n.hash FROM n LEFT JOIN b ON b.path = n.path WHERE (b.hash IS NULL OR b.hash <> n.hash) AND n.path IN (SELECT src_path FROM fs_events WHERE lower(trim(kind)) = 'modified' AND NOT coalesce(is_directory, false) AND {SUPPORTED_SQL.format('src_path')})",
    "events_debounced": "WITH m AS (SELECT DISTINCT event_id, src_path, event_at FROM fs_events WHERE src_path IS NOT NULL), b AS (SELECT *, lead(event_at) OVER (PARTITION BY src_path ORDER BY event_at, event_id) AS a FROM m) SELECT event_id, src_path FROM b WHERE a IS NULL OR a >= event_at + INTERVAL 6 HOUR",
    "events_latest": "SELECT src_path, s.event_id AS event_id FROM (SELECT src_path, max(struct_pack(event_at := event_at, event_id := event_id)) AS s FROM fs_events WHERE src_path IS NOT NULL GROUP BY src_path)",
}
