"""An index on disk: commits that add to its relations, and a log whose file names say which of them count."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.functions.text import fts_tokens
from lumidex.operators.chunking import chunk
from lumidex.operators.embedding import HashingEmbedder, embed_column
from lumidex.operators.fulltext import bm25_of_postings, build_postings, query_phrases
from lumidex.operators.indexing import detect_changes, indexable, number_rows, reset_hashes, upsert_files
from lumidex.plans.hybrid import text_search
from lumidex.session import cut_lineage

SCHEMAS = {
    "files": "id bigint, path string, hash string, filename string, status string",
    "chunks": "id bigint, file_id bigint, chunk_index int, text string",
    "vec_chunks": "chunk_id bigint, file_id bigint, embedding array<float>",
    "postings": "bucket int, term string, chunk_id bigint, file_id bigint, tf int, positions array<int>, len int",
    "lengths": "chunk_id bigint, file_id bigint, len int",
    "gone": "file_id bigint",
}
BUCKETS = 64  # folders of postings in a commit; a query reads those of its terms


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True, order=True)
class Commit:
    number: int
    base: int  # the first commit that still counts
    uid: str
    relations: str  # the places in SCHEMAS of those it wrote


class IndexStore:
    """A commit writes new folders for the relations that it changes and then one empty file in the log, whose name holds all there is to say; readers list
    the log and see either state. A file's newest row counts; rows of a file's chunks, vectors and postings count from its last entry in ``gone`` on.
    ``compact`` writes one commit with what counts. One writer at a time: of two with one number, the later one is told.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> IndexStore:
        store = cls(spark, folder)
        if not store._log():
            store.commit({name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items() if name != "postings"})
        return store

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self) -> list[Commit]:
        path, fs = self._fs("_log")
        if not fs.exists(path):
            return []
        parts = [str(s.getPath().getName()).split(".") for s in fs.listStatus(path)]
        first = {}
        for c in sorted(Commit(int(p[0]), int(p[1]), p[2], p[3]) for p in parts if len(p) == 4):
            first.setdefault(c.number, c)
        base = max((c.base for c in first.values()), default=0)
        return [c for n, c in sorted(first.items()) if n >= base]

    def _rows(self, name: str, log: list[Commit]) -> DataFrame:
        """All rows of a relation with their commit's number."""
        place = str(list(SCHEMAS).index(name))
        folders = [f"{self.folder}/{c.number:012d}-{c.uid}/{name}" for c in log if place in c.relations]
        schema = f"{SCHEMAS[name]}, _commit bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        if name == "postings":  # each commit's buckets are folders; the path of each is a base of its own
            parts = [self.spark.read.schema(schema).option("basePath", f).parquet(f) for f in folders]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        return self.spark.read.schema(schema).parquet(*folders)

    def table(self, name: str) -> DataFrame:
        log = self._log()
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows = self._rows(name, log)
        if len(log) == 1 or name == "gone":
            return rows.select(*columns)
        if name == "files":
            newest = rows.groupBy("id").agg(F.max(F.struct("_commit", *columns[1:])).alias("s"))
            return newest.select("id", *[f"s.{c}" for c in columns[1:]])
        gone = self._rows("gone", log).groupBy("file_id").agg(F.max("_commit").alias("_gone"))
        return rows.join(gone, "file_id", "left").where("_gone is null or _commit >= _gone").select(*columns)

    def commit(self, tables: dict[str, DataFrame], whole: bool = False) -> None:
        """Add rows to relations; with ``whole`` they replace all that was there before."""
        log = self._log()
        number = log[-1].number + 1 if log else 1
        new = Commit(number, number if whole or not log else log[0].base, uuid.uuid4().hex, "".join(str(i) for i, name in enumerate(SCHEMAS) if name in tables))
        for name, rows in tables.items():
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            out = rows.select(*columns, F.lit(number).cast("bigint").alias("_commit"))
            if name == "postings":
                out = out.repartition("bucket").sortWithinPartitions("bucket", "term")
            writer = out.write.partitionBy("bucket") if name == "postings" else out.write
            writer.parquet(f"{self.folder}/{number:012d}-{new.uid}/{name}")
        path, fs = self._fs(f"_log/{new.number:012d}.{new.base:012d}.{new.uid}.{new.relations}")
        fs.create(path, False).close()
        if next(c for c in self._log() if c.number == number).uid != new.uid:
            raise RuntimeError("another writer made this commit")

    def index(self, found: DataFrame, embedder=None, revive_orphans: bool = False) -> None:
        """Bring the index up to a scan (path, hash, text): new and changed files are chunked, embedded and posted; files that turned blank lose their
        chunks; new blank ones are left out; files that are not in the scan stay. Written is only what changes."""
        stored = self.table("files")
        changes = detect_changes(stored, found, revive_orphans).where("change in ('new', 'changed')")
        work = found.join(changes.select("path", F.col("id").alias("_id"), "change"), "path")
        # Kept, so that texts are extracted once.
        work = cut_lineage(work.where((F.col("change") == "changed") | F.col("text").rlike(r"\S")).select("path", "hash", "text", "_id"))
        known = stored.join(work.select("path"), "path", "left_semi")
        files = cut_lineage(upsert_files(known, work.select("path", "hash"), (stored.agg(F.max("id")).first()[0] or 0) + 1))
        fresh = indexable(work).join(files.select("id", "path"), "path").select("id", "text")
        pieces = chunk(fresh, "id", "text").withColumnRenamed("id", "file_id")
        last = self.table("chunks").agg(F.max("id")).first()[0] or 0
        pieces = number_rows(pieces, ["file_id", "chunk_index"], "id", last)
        gone = work.where("_id is not null").select(F.col("_id").alias("file_id"))
        self.commit({"files": files, "gone": gone, **self._derived(pieces, embedder)})

    @staticmethod
    def _derived(pieces: DataFrame, embedder) -> dict[str, DataFrame]:
        vectors = embed_column(pieces, "text", embedder or HashingEmbedder()).select(F.col("id").alias("chunk_id"), "file_id", "embedding")
        postings = build_postings(pieces, "id", "text", "file_id").withColumn("bucket", bucket_of("term"))
        # A text without tokens has a length too.
        lengths = pieces.select(F.col("id").alias("chunk_id"), "file_id", F.size(fts_tokens(F.col("text"))).alias("len"))
        return {"chunks": pieces, "vec_chunks": vectors, "postings": postings, "lengths": lengths}

    def put_files(self, files: DataFrame) -> None:
        """Add newer rows of files; their chunks stay."""
        self.commit({"files": files})

    def reset_hashes(self) -> int:
        """Make the next ``index`` take every indexed file as changed; how many those are."""
        indexed = cut_lineage(reset_hashes(self.table("files").where("status = 'indexed'")))
        self.put_files(indexed)
        return indexed.count()

    def compact(self) -> None:
        """One commit with all rows that count; older folders are no longer read."""
        self.commit({name: self.table(name) if name != "gone" else self.spark.createDataFrame([], SCHEMAS[name]) for name in SCHEMAS}, whole=True)

    def bm25(self, query: str) -> DataFrame:
        """(chunk_id, rank) from the stored postings: of these only the folders of the query's terms are read."""
        corpus = self.table("lengths").agg(F.count("*").alias("n_chunks"), F.avg(F.col("len").cast("double")).alias("mean_length"))
        terms = sorted({t for p in query_phrases(query) for t in p})
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of("term").alias("b")).distinct().collect()]
        return bm25_of_postings(self.table("postings").where(F.col("bucket").isin(buckets)), corpus, query)

    def search(self, query: str, top_k: int = 5, embedder=None, live_paths: DataFrame | None = None) -> DataFrame:
        """The tiered search of a text in the stored index."""
        vectors = self.table("vec_chunks").select("chunk_id", "embedding")
        return text_search(self.table("files"), self.table("chunks"), vectors, query, embedder, top_k, live_paths=live_paths, ranked=self.bm25(query))
