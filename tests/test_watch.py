from datetime import datetime, timedelta

from lumidex.sources.files import extract_text, scan_folder
from lumidex.sources.store import IndexStore
from lumidex.streaming.watch import watch

D = datetime(2024, 5, 1)


def test_watch(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, text in {"a.txt": "alpha", "b.txt": "beta", "c.md": "gamma", "keep.txt": "kept", "e.txt": "echo"}.items():
        (docs / name).write_text(text)
    p = lambda n: f"{docs}/{n}"
    store = IndexStore.create(spark, str(tmp_path / "ix"))
    store.index(extract_text(scan_folder(spark, str(docs))))
    before = {r.path: r.id for r in store.table("files").collect()}
    (docs / "a.txt").rename(docs / "a3.md")
    (docs / "b.txt").unlink()
    (docs / "c.md").write_text("gamma changed")
    (docs / "new.txt").write_text("fresh")
    rows = [
        ("moved", p("a.txt"), p("a2.txt"), 1), ("moved", p("a2.txt"), p("a3.md"), 2), ("deleted", p("b.txt"), None, 3), ("modified", p("c.md"), None, 4),
        ("created", p("new.txt"), None, 5), ("moved", p("e.txt"), p("keep.txt"), 6), ("modified", p("unknown.png"), None, 7),
    ]
    events = spark.createDataFrame([(n, k, s, d, False, D + timedelta(seconds=n)) for k, s, d, n in rows], "event_id long, kind string, src_path string, dest_path string, is_directory boolean, event_at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    watch(store, str(tmp_path / "events"), str(docs), str(tmp_path / "cp")).awaitTermination()
    files = {r.path: r for r in store.table("files").collect()}
    assert files[p("a3.md")].id == before[p("a.txt")] and p("a.txt") not in files and files[p("a3.md")].filename == "a3.md"
    assert files[p("b.txt")].status == "orphaned" and files[p("new.txt")].status == "indexed"
    assert files[p("e.txt")].id == before[p("e.txt")] and files[p("keep.txt")].id == before[p("keep.txt")]
    texts = {r.file_id: r.text for r in store.table("chunks").collect()}
    assert texts[files[p("c.md")].id] == "gamma changed" and texts[files[p("b.txt")].id] == "beta" and texts[files[p("new.txt")].id] == "fresh"
    assert store.table("chunks").count() == store.table("vec_chunks").count() == len(files)
