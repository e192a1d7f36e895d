from datetime import datetime, timedelta

from lumidex.operators.references import bloom_blocks, index_references, orphan_references, with_bloom_test
from lumidex.streaming import events as ev

D = datetime(2024, 5, 1)


def at(days):
    return D + timedelta(days=days)


def tables(spark):
    files = spark.createDataFrame([(1, "indexed", at(0), "x"), (1, " Orphaned ", at(5), "x"), (2, "indexed", at(9), "x"), (2, "indexed", at(1), "x"), (3, "ORPHANED", at(0), "x"), (3, "indexed", at(4), "x"), (None, "indexed", at(0), "x")], "id long, status string, indexed_at timestamp, _key string")
    chunks = spark.createDataFrame([(10, 1, at(6)), (11, 2, at(0)), (11, 2, at(0)), (12, 2, at(2)), (13, 3, at(9)), (14, 99, at(40)), (15, None, at(1)), (16, 1, None), (17, 98, None)], "id long, file_id long, indexed_at timestamp")
    vectors = spark.createDataFrame([(10, at(7)), (11, at(-1)), (77, at(1)), (None, at(1))], "chunk_id long, embedded_at timestamp")
    return files, chunks, vectors


def test_orphans(spark):
    got = {tuple(r) for r in index_references(*tables(spark)).collect()}
    assert got == {
        ("chunks", 10, "deleted", "2024-05"), ("chunks", 11, "late", "2024-05"), ("chunks", 14, "missing", "2024-06"),
        ("chunks", 16, "deleted", None), ("chunks", 17, "missing", None), ("vec_chunks", 11, "late", "2024-04"), ("vec_chunks", 77, "missing", "2024-05"),
    }
    assert index_references(*tables(spark)).count() == len(got)


def test_empty_and_full_filter(spark):
    files, chunks, vectors = tables(spark)
    assert index_references(files, chunks.limit(0), vectors.limit(0)).count() == 0
    gone = index_references(files.limit(0), chunks, vectors.limit(0))
    assert {r.reason for r in gone.collect()} == {"missing"} and gone.count() == 7
    # A filter far too small for its keys lets rows through, and the join still finds every orphan.
    keys = spark.range(0, 40000).selectExpr("id", "timestamp'2024-01-01' as t")
    rows = spark.range(39000, 41000).selectExpr("id as row", "id as ref", "timestamp'2024-02-01' as t")
    found = orphan_references(rows, keys, name="x", row_id="row", key="ref", time="t", parent_key="id", parent_time="t", max_blocks=1)
    assert found.count() == 1000


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 5000).selectExpr("id * 7 as k")
    tested = with_bloom_test(spark.range(0, 70000).selectExpr("id as k"), "k", keys, "k", 5000)
    maybe = {r.k for r in tested.where("_maybe").collect()}
    assert {7 * i for i in range(5000)} <= maybe
    assert len(maybe) < 5000 + 0.03 * 65000
    bits, blocks = bloom_blocks(keys, "k", 10**9, max_blocks=8)
    assert blocks == 8 and bits.count() <= 8


def events(spark):
    rows = [
        (1, "Created", "/a.txt", None, False, at(0)), (2, "modified", "/a.txt", None, False, at(1)), (3, "MOVED", "/a.txt", "/b.md", False, at(2)), (4, "deleted", "/c.pdf", None, None, at(0)),
        (5, "moved", "/d.txt", "/d.bin", False, at(0)), (6, "moved", "/e.txt", None, False, at(0)), (7, "created", "/f.png", None, False, at(0)), (8, "created", "/dir.txt", None, True, at(0)),
        (9, "created", None, None, False, at(0)), (10, "modified", "/c.pdf", None, False, at(-3)), (11, "odd", "/g.txt", None, False, at(0)), (2, "modified", "/a.txt", None, False, at(1)),
    ]
    return spark.createDataFrame(rows, "event_id long, kind string, src_path string, dest_path string, is_directory boolean, event_at timestamp")


def test_fold(spark):
    got = {r.path: r.status for r in ev.fold_events(events(spark)).collect()}
    assert got == {"/a.txt": "moved", "/b.md": "indexed", "/c.pdf": "orphaned", "/d.txt": "orphaned", "/e.txt": "orphaned"}
    assert ev.fold_events(events(spark).limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events(spark).repartition(3).write.parquet(str(tmp_path / "e"))
    assert {tuple(r) for r in ev.streamed_state(spark, str(tmp_path / "e")).collect()} == {tuple(r) for r in ev.fold_events(events(spark)).collect()}


def test_keystrokes(spark):
    rows = [(1, "u", D), (2, "u", D + timedelta(milliseconds=200)), (3, "u", D + timedelta(milliseconds=550)), (4, "v", D)]
    keys = spark.createDataFrame(rows, "n long, user string, t timestamp")
    assert {r.n for r in ev.debounce(keys, "user", "t", "n", "350 MILLISECONDS").collect()} == {2, 3, 4}
    assert {r.n for r in ev.latest_generation(keys, "user", "t", "n").collect()} == {3, 4}
