import io
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumidex.config import EngineConfig
from lumidex.operators import fulltext, indexing, knn, maintenance, presentation
from lumidex.operators.embedding import HashingEmbedder, OnnxEmbedder, chosen_embedder, embed_column
from lumidex.plans.hybrid import hybrid_search
from lumidex.sources.files import docx_text, extract_text, pdf_text, scan_folder, scan_paths
from lumidex.session import ensure_checkpoint_dir
from lumidex.sources.store import IndexStore


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx():
    assert docx_text(docx("One", "  ", "Two")) == "One\nTwo"


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    files = {"a.txt": "plain ünï".encode(), "b.TXT": "caf\xe9".encode("latin-1"), "c.docx": docx("Hello"), "d.docx": b"broken", "e.png": b"x", "node_modules/f.txt": b"no", "résumé (final) [v2].md": b"\xef\xbb\xbfmark"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.filename: r for r in extract_text(scan_folder(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.txt", "b.TXT", "c.docx", "d.docx", "résumé (final) [v2].md"}
    assert rows["a.txt"].text == "plain ünï" and rows["b.TXT"].text == "café" and rows["c.docx"].text == "Hello"
    assert rows["d.docx"].text == "" and "BadZipFile" in rows["d.docx"].error
    assert rows["résumé (final) [v2].md"].text.startswith("﻿")


def test_embedder(spark):
    e = HashingEmbedder()
    both = e.embed(["one text", "another"])
    assert both.shape == (2, 384) and e.embed([]).shape == (0, 384)
    assert np.allclose(np.linalg.norm(both, axis=1), 1, atol=1e-5) and np.allclose(both[0], e.embed(["one text"])[0])
    assert not e.embed(["..."]).any()
    assert not OnnxEmbedder.available("/nowhere")
    df = spark.createDataFrame([(1, "one text"), (2, None)], "id long, t string")
    assert np.allclose(embed_column(df, "t").orderBy("id").first().embedding, both[0], atol=1e-6)


def found(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string, text string")


def test_store_life(spark, tmp_path):
    store = IndexStore.create(spark, str(tmp_path / "ix"))
    store.index(found(spark, [("/d/a.txt", "1", "alpha " * 600), ("/d/b.txt", "2", "beta"), ("/d/blank.txt", "3", " \n"), ("/d/failed.txt", "", "x")]))
    files = {r.path: r for r in store.table("files").collect()}
    assert set(files) == {"/d/a.txt", "/d/b.txt"}
    assert store.table("chunks").count() == store.table("vec_chunks").count() == 3
    before = files["/d/a.txt"].id
    store.index(found(spark, [("/d/a.txt", "1", "alpha"), ("/d/b.txt", "9", "gamma"), ("/d/c.txt", "4", "new")]))
    files = {r.path: r for r in store.table("files").collect()}
    assert files["/d/a.txt"].id == before and files["/d/b.txt"].hash == "9" and len(files) == 3
    texts = {r.text for r in store.table("chunks").where(f"file_id <> {before}").collect()}
    assert texts == {"gamma", "new"} and store.table("chunks").count() == store.table("vec_chunks").count() == 4
    assert store.reset_hashes() == 3 and {r.hash for r in store.table("files").collect()} == {""}
    store.index(found(spark, [("/d/b.txt", "9", "  ")]))
    assert store.table("chunks").where(f"file_id = {files['/d/b.txt'].id}").count() == 0
    assert IndexStore.create(spark, str(tmp_path / "ix")).table("files").count() == 3


def test_stored_index_is_searched(spark, tmp_path):
    store = IndexStore.create(spark, str(tmp_path / "ix"))
    texts = {"/d/astro.txt": "planets and stars in space, far-away space", "/d/cook.txt": "boil pasta with salt", "/d/far.md": "far away galaxies; the far side"}
    store.index(found(spark, [(p, p, t) for p, t in texts.items()]))
    store.index(found(spark, [("/d/cook.txt", "9", "salt the space soup"), ("/d/new.txt", "4", "a far-away star")]))
    for query in ("space", "far-away space", "salt salt", 'a "b"', "nothing"):
        want = sorted((r.chunk_id, round(r.rank, 9)) for r in fulltext.bm25(store.table("chunks"), query).collect())
        assert sorted((r.chunk_id, round(r.rank, 9)) for r in store.bm25(query).collect()) == want
    assert store.bm25("space").count() == 2
    got = store.search("show the far-away galaxies", 3).orderBy("tier", "pos").collect()
    assert got[0].path == "/d/far.md" and len({r.path for r in got}) == len(got) == 3
    before = {name: sorted(map(str, store.table(name).collect())) for name in ("files", "chunks", "vec_chunks", "postings", "lengths")}
    store.compact()
    assert {name: sorted(map(str, store.table(name).collect())) for name in before} == before and len(store._log()) == 1
    # A reader that lists the log before a commit sees the state before it.
    log = store._log()
    store.reset_hashes()
    assert {r.hash for r in store.table("files").collect()} == {""}
    store._log = lambda: log
    assert "" not in {r.hash for r in store.table("files").collect()}


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit("x").alias("b")).repartition(7)
    got = {r.a: r.n for r in indexing.number_rows(rows, ["a", "b"], "n", 10).collect()}
    assert got == {i: 11 + i for i in range(1000)}
    assert indexing.number_rows(rows.limit(0), ["a"], "n").count() == 0


def test_only_chosen_paths_are_read(spark, tmp_path):
    for name in ("a.txt", "b [x]{1}*?.txt", "c.txt", "d.png"):
        (tmp_path / name).write_text(name)
    asked = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.txt", "b [x]{1}*?.txt", "gone.txt", "d.png")], "path string")
    got = [r.filename for part in scan_paths(spark, str(tmp_path), asked, block=1) for r in part.collect()]
    assert sorted(got) == ["a.txt", "b [x]{1}*?.txt"]


def test_pages_that_fail_are_left_out(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def get_text(self):
            if self.text is None:
                raise RuntimeError("broken page")
            return self.text

        def get_pixmap(self, dpi):
            raise RuntimeError("no image")

    class Book(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    fake = types.ModuleType("fitz")
    fake.open = lambda stream, filetype: Book([Page("one "), Page(None), Page(" "), Page("four")])
    monkeypatch.setitem(sys.modules, "fitz", fake)
    assert pdf_text(b"") == "one\nfour"


def test_model_is_chosen(tmp_path):
    model = tmp_path / "onnx"
    model.mkdir()
    (model / "model.onnx").write_bytes(b"")
    assert isinstance(chosen_embedder("/nowhere", str(tmp_path)), OnnxEmbedder)
    assert isinstance(chosen_embedder("", "/nowhere"), HashingEmbedder)


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session)


def test_changes(spark):
    stored = spark.createDataFrame([(1, "a", "x", "indexed"), (2, "b", "x", "orphaned"), (3, "c", "x", "indexed"), (4, "d", "x", "indexed")], "id long, path string, hash string, status string")
    scan = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("e", "z"), ("f", "")], "path string, hash string")
    got = {r.path: r.change for r in indexing.detect_changes(stored, scan).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "missing", "e": "new", "f": "failed"}
    assert {r.path: r.change for r in indexing.detect_changes(stored, scan, True).collect()}["b"] == "changed"


def test_relocate_and_orphans(spark):
    missing = spark.createDataFrame([(1, "/o/a", "a", "h"), (2, "/o/b", "b", ""), (3, "/o2/a", "a", "h")], "id long, path string, filename string, hash string")
    there = spark.createDataFrame([("/n/a", "a", "h"), ("/m/a", "a", "h"), ("/n/b", "b", "")], "path string, filename string, hash string")
    assert [(r.id, r.path) for r in maintenance.relocate(missing, there).collect()] == [(1, "/m/a")]
    files = spark.createDataFrame([(1, "/x", "indexed"), (2, "/y", "indexed")], "id long, path string, status string")
    live = spark.createDataFrame([("/x",), ("/x",)], "path string")
    assert {r.id: r.status for r in maintenance.mark_orphans(files, live).collect()} == {1: "indexed", 2: "orphaned"}
    assert [r.id for r in maintenance.only_live(files, live).collect()] == [1]


@pytest.fixture(scope="module")
def index(spark):
    texts = {1: "planets and stars in space", 2: "boil pasta with salt", 3: "galaxies are far away", 4: "recipe for soup", 5: "old orphan about space"}
    files = spark.createDataFrame([(i, f"/d/{n}", n, "orphaned" if i == 5 else "indexed") for i, n in [(1, "astro.txt"), (2, "cooking.txt"), (3, "galaxies.md"), (4, "recipe.txt"), (5, "gone.txt")]], "id long, path string, filename string, status string")
    chunks = spark.createDataFrame([(10 + i, i, 0, t) for i, t in texts.items()], "id long, file_id long, chunk_index int, text string")
    vectors = embed_column(chunks, "text").selectExpr("id as chunk_id", "embedding")
    return files, chunks, vectors


def ask(spark, index, query, k, live=None):
    vector = embed_column(spark.createDataFrame([(query,)], "t string"), "t", out="query").select("query")
    return hybrid_search(*index, query, vector, k, live).orderBy("tier", "pos").collect()


def test_search(spark, index):
    got = ask(spark, index, "recipe", 3)
    assert got[0].filename == "recipe.txt" and got[0].score == 1.0
    got = ask(spark, index, "space galaxies", 5)
    assert [r.filename for r in got[:2]] == ["galaxies.md", "astro.txt"] and got[0].tier == 3 and got[1].tier == 4
    assert len({r.path for r in got}) == len(got) <= 5 and [r.tier for r in got] == sorted(r.tier for r in got)
    assert "gone.txt" in {r.filename for r in got if r.tier == 5}  # the vector tier has no status filter
    live = spark.createDataFrame([("/d/astro.txt",)], "path string")
    assert {r.filename for r in ask(spark, index, "space galaxies", 5, live)} == {"astro.txt"}
    assert ask(spark, index, "   ", 5) == []
    empty = tuple(x.limit(0) for x in index)
    assert ask(spark, empty, "space", 5) == []


def test_knn(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "query array<float>")
    assert [(r.chunk_id, r.distance) for r in knn.nearest(v, q, 2).collect()] == [(1, 0.0), (3, 0.0)]
    assert [r.distance for r in knn.nearest(v, q, 3, metric="cosine").collect()] == [0.0, 0.0, 1.0]


def test_nearest_to_each(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(1, 8)), 30, axis=0)]).round(3)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "chunk_id long, embedding array<double>").repartition(4)
    asked = v.where("chunk_id % 5 = 0").selectExpr("chunk_id as query_id", "embedding as query")
    got = sorted((r.query_id, r.distance, r.chunk_id) for r in knn.nearest_to_each(v, asked, 4, block=7).collect())
    want = []
    for q in range(0, 90, 5):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1)).round(6)
        want += [(q, d[i], i) for i in np.lexsort((np.arange(90), d))[:4]]
    assert got == sorted(want)
    assert knn.nearest_to_each(v.limit(0), asked, 4).count() == 0 == knn.nearest_to_each(v, asked.limit(0), 4).count()


def test_presentation(spark):
    rows = spark.createDataFrame([(1, 1, "/a/x.pdf", 0.9, "s" * 120), (1, 2, "/b/y.doc", 0.1, ""), (2, 1, "/c/z", 0.3, "t")], "tier int, pos int, path string, score double, snippet string")
    order = ["tier", "pos"]
    got = presentation.presented(presentation.cut(rows, order), order).orderBy("rank").collect()
    assert [(r.badge, len(r.subtitle), r.alpha) for r in got] == [("PDF", 95, 232), ("FILE", 1, 130)]
    low = presentation.cut(rows.withColumn("score", rows.score / 10), order)
    assert low.count() == 3


def test_config(tmp_path):
    EngineConfig(folders=("/a",), top_k=8).save(str(tmp_path / "c.json"))
    assert EngineConfig.load(str(tmp_path / "c.json")).top_k == 8
    (tmp_path / "d.json").write_text("{broken")
    assert EngineConfig.load(str(tmp_path / "d.json")) == EngineConfig()
