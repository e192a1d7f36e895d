import sqlite3

import pytest
from pyspark.sql import functions as F

from lumidex.functions import text as T
from lumidex.functions.arrays import running_totals
from lumidex.functions.text import plain_words
from lumidex.operators import fulltext
from lumidex.operators.chunking import chunk
from lumidex.operators.filename import all_words_matches, any_word_matches, substring_matches


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("n,count", [(0, 0), (1, 1), (450, 1), (451, 2), (500, 2), (501, 2), (900, 2), (901, 3)])
def test_chunk_counts(spark, n, count):
    df = spark.createDataFrame([(1, " ".join(map(str, range(n))))], "id long, t string")
    rows = chunk(df, "id", "t").orderBy("chunk_index").collect()
    assert len(rows) == count
    if count > 1:
        assert rows[1].text.split()[0] == "450"


def test_chunk_blank_null_and_unicode_space(spark):
    df = spark.createDataFrame([(1, None), (2, " \n\t "), (3, "a b　c\u0085d")], "id long, t string")
    rows = chunk(df, "id", "t", 2, 5).collect()
    assert [(r.id, r.text) for r in rows] == [(3, "a b"), (3, "b c"), (3, "c d"), (3, "d")]


def test_words_and_queries(spark):
    assert one(spark, "Don't  STOP, l'été—Über 3.5!\n...", T.plain_words) == ["dont", "stop", "létéüber", "35"]
    assert one(spark, "find the Quarterly report x", T.clean_query) == "quarterly report"
    assert one(spark, "Find The File", T.clean_query) == "Find The File"
    assert one(spark, None, T.plain_words) is None
    assert one(spark, "RÉSUMÉ", T.ascii_lower) == "rÉsumÉ"


@pytest.fixture(scope="module")
def corpus():
    return [
        (1, "The quick brown fox. Quick foxes jump over the lazy dog"),
        (2, "A tax-return was filed: the tax return of 2023"),
        (3, "return tax, quick quick quick"),
        (4, "Résumé of the café"),
        (5, None),
        (6, ""),
        (7, "x " * 60 + "needle in the middle. " + "y " * 60),
    ]


def fts(corpus):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text)")
    db.executemany("insert into t(rowid, text) values (?, ?)", [(i, t) for i, t in corpus if t is not None])
    return db


@pytest.mark.parametrize("query", ["quick", "quick fox", "tax-return", "return quick quick", "resume cafe", "c++", "needle", "nothing here"])
def test_bm25_matches_sqlite(spark, corpus, query):
    df = spark.createDataFrame(corpus, "id long, text string")
    got = {r.chunk_id: r.rank for r in fulltext.bm25(df, query).collect()}
    words = T.query_words_of(query)
    match = " OR ".join(f'"{w}"' for w in words)
    want = dict(fts(corpus).execute("select rowid, bm25(t) from t where t match ?", (match,)).fetchall()) if words else {}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("query", ["quick", "needle", "fox dog"])
def test_snippets_match_sqlite(spark, corpus, query):
    words = [t for p in fulltext.query_phrases(query) for t in p]
    match = " OR ".join(f'"{w}"' for w in words)
    for i, s in fts(corpus).execute("select rowid, snippet(t, 0, '»', '«', '…', 40) from t where t match ?", (match,)):
        assert fulltext.snippet_of(dict(corpus)[i], words) == s


def test_phrases_and_statistics(spark, corpus):
    df = spark.createDataFrame(corpus, "id long, text string")
    assert [r.chunk_id for r in fulltext.phrase_match(df, "tax-return").collect()] == [2]
    assert fulltext.phrase_match(df, "--").count() == 0
    assert fulltext.bm25(df, 'say "x" now').count() == 0
    assert fulltext.corpus_statistics(df).first().n_chunks == 6


def test_filename_tiers(spark):
    rows = [(1, "/a", "tax_return_2024.pdf", "indexed"), (2, "/b", "TaxReturn.txt", " Indexed "), (3, "/c", "return.md", "indexed"), (4, "/d", "tax return.md", "orphaned"), (5, "/e", None, "indexed"), (6, "/f", "TÄX.md", "indexed")]
    files = spark.createDataFrame(rows, "id long, path string, filename string, status string")
    assert [r.id for r in substring_matches(files, "tax_return", 9).collect()] == [1]
    assert [r.id for r in substring_matches(files, "%2024", 9).collect()] == [1]
    assert [r.id for r in substring_matches(files, "a\\b", 9).collect()] == []
    assert [r.id for r in all_words_matches(files, "return tax", 9).collect()] == [1, 2]
    assert all_words_matches(files, "tax", 9).count() == 0
    assert [(r.id, r.score) for r in any_word_matches(files, "tax return", 2).collect()] == [(1, 0.9), (2, 0.9), (3, 0.85)]
    assert any_word_matches(files, "the a", 2).count() == 0


def test_running_totals(spark):
    rows = [(n, [(i * 7) % 11 for i in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    got = spark.createDataFrame(rows, "n int, x array<int>").select("n", running_totals(F.col("x")).alias("t")).collect()
    for r in got:
        values = dict(rows)[r.n]
        assert r.t == [sum(values[:i]) for i in range(r.n)]


def test_words_of_ascii_texts_are_those_of_others(spark):
    texts = ["The C++ file, v1.2\tis_here\x0b(so) far!\x1cEND", "a  - b\r\nC3PO", "...", " x "]
    df = spark.createDataFrame([(t, t + " \u00e9") for t in texts], "a string, b string")
    for r in df.select(plain_words(F.col("a")).alias("a"), plain_words(F.col("b")).alias("b")).collect():
        assert r.b == [*r.a, "\u00e9"]
