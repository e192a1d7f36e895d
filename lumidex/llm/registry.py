"""Queries of the training-data operators over the index tables, and SQL for those that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.encoding import restore_texts
from lumidex.llm.leakage import leak_coverage, leaked_items
from lumidex.llm.near_duplicates import similar_groups, similar_pairs
from lumidex.llm.packing import pack_documents, packing_report
from lumidex.llm.scanned_text import find_noise, repair
from lumidex.llm.sentences import split_sentences
from lumidex.llm.similar_vectors import similar_vector_pairs
from lumidex.llm.text_quality import not_prose, text_kind, text_statistics
from lumidex.session import spread_out, table


COLUMNS = {"chunks": ["id", "text"], "documents": ["doc_id", "text"], "vec_chunks": ["chunk_id", "embedding"]}


def _rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread_out(table(spark, folder, name).select(*COLUMNS[name]))


def _common_words(spark: SparkSession, folder: str) -> list[str]:
    """The fixed list of frequent words, which becomes part of the expressions; a list beyond its bound is an error, not cut."""
    words = [r.word for r in table(spark, folder, "common_words").select("word").where("word is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return sorted(words)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_prose(_rows(spark, folder, "chunks"), "id", "text", _common_words(spark, folder)).withColumnRenamed("id", "chunk_id")


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    statistics = text_statistics(_rows(spark, folder, "chunks"), "id", "text", _common_words(spark, folder))
    return statistics.withColumn("kind", text_kind()).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_vector_pairs(_rows(spark, folder, "vec_chunks"), "chunk_id", "embedding", k=10, dim=384)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_noise(_rows(spark, folder, "chunks"), "id", "text").withColumnRenamed("id", "chunk_id")


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return repair(_rows(spark, folder, "chunks"), "id", "text").withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return restore_texts(_rows(spark, folder, "chunks"), "id", "text").select(F.col("id").alias("chunk_id")).distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return restore_texts(_rows(spark, folder, "chunks"), "id", "text").withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(_rows(spark, folder, "chunks"), "id", "text", threshold=0.5, width=3)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(_rows(spark, folder, "chunks"), "id", "text", threshold=0.5, width=3).withColumnRenamed("id", "chunk_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(_rows(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return leak_coverage(_rows(spark, folder, "documents"), table(spark, folder, "eval_items"), repetitions=8, samples=6)


def p7_inputs(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(_rows(spark, folder, "documents"), "doc_id", "text")
    return packed.withColumnRenamed("id", "doc_id").withColumnRenamed("bin", "input_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing_report(pack_documents(_rows(spark, folder, "documents"), "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = split_sentences(_rows(spark, folder, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("sent_start"), F.col("end").alias("sent_end"))


MOST_COMMON_WORDS = 2000
QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired, "p1_found": p1_found, "p1_statistics": p1_statistics, "p4_found": p4_found, "p4_restored": p4_restored, "p7_inputs": p7_inputs, "p7_report": p7_report, "p9_found": p9_found, "p2_found": p2_found, "p6_found": p6_found, "p6_groups": p6_groups, "p8_found": p8_found, "p8_coverage": p8_coverage}

BLANK = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


def _words_sql(column: str) -> str:
    """A text's words as TESTDATA.md has them."""
    pieces = rf"regexp_split_to_array(lower({column}), '[{BLANK}]+')"
    return rf"list_filter(list_transform({pieces}, lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '')"


TEXTS = rf"""t AS (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND regexp_matches(text, '[^{BLANK}]')),
    w AS (SELECT id, text, {_words_sql("text")} AS w FROM t),
    k AS (SELECT id, CASE WHEN len(w) >= 3 THEN 'w' || array_to_string(w, ' ') ELSE 't' || text END AS key, w FROM w),
    g AS (SELECT id, key, min(id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS n, w FROM k),
    s AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM g WHERE id = first)),
    z AS (SELECT id, count(*) AS z FROM s GROUP BY id),
    l AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
    linked AS (SELECT a, b FROM l JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE c >= 0.5 * (x.z + y.z - c))"""
ORACLES: dict[str, str] = {
    "p2_found": """WITH v AS (SELECT chunk_id, min(embedding::DOUBLE[]) AS e FROM vec_chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 384
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
        u AS (SELECT chunk_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
        d AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) AS s FROM u a, u b WHERE a.chunk_id <> b.chunk_id),
        k AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM k""",
    "p6_found": f"WITH {TEXTS} SELECT DISTINCT least(x.id, y.id) AS chunk_a, greatest(x.id, y.id) AS chunk_b FROM (SELECT a, b FROM linked UNION SELECT first, first FROM g) p JOIN g x ON x.first = p.a JOIN g y ON y.first = p.b WHERE x.id <> y.id",
    "p6_groups": f"WITH {TEXTS}, q AS (SELECT a AS first FROM linked UNION ALL SELECT b FROM linked) SELECT id AS chunk_id, first AS class, n AS members, (SELECT count(*) FROM q WHERE q.first = g.first) AS links FROM g",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
        i AS (SELECT DISTINCT item_id, {_words_sql("passage")} AS w FROM eval_items WHERE passage IS NOT NULL AND item_id IS NOT NULL),
        dw AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS s FROM d)),
        iw AS (SELECT item_id, s, array_to_string(w[s : s + 7], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) AS s FROM i)),
        m AS (SELECT DISTINCT doc_id, item_id, s FROM dw JOIN iw ON dw.g = iw.g),
        c AS (SELECT doc_id, item_id, count(DISTINCT p) AS c FROM (SELECT doc_id, item_id, unnest(generate_series(s, s + 7)) AS p FROM m) GROUP BY ALL)
        SELECT doc_id, c.item_id AS item_id FROM c JOIN i ON i.item_id = c.item_id WHERE c >= 0.5 * len(w)""",
}
