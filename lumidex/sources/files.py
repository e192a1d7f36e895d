"""Folders as a source: scan, filters, hashes and text extraction."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.config import EXCLUDED, SUPPORTED
from lumidex.functions.text import file_name, suffix


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def is_excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a component of the path equals one of the patterns."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in patterns])) if patterns else F.lit(False)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def scan_folder(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, filename, hash, content) of the supported files below a folder."""
    return _scanned(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), excluded)


def _scanned(rows: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = rows.select(path.alias("path"), "content").where(is_supported(F.col("path")) & ~is_excluded(F.col("path"), excluded))
    return rows.select("path", file_name(F.col("path")).alias("filename"), content_hash(F.col("content")).alias("hash"), "content")


def scan_paths(spark: SparkSession, folder: str, paths: DataFrame, block: int = 10_000, excluded: tuple[str, ...] = EXCLUDED) -> Iterator[DataFrame]:
    """``scan_folder`` of those files alone whose path is in ``paths``, in blocks of files whose names fit the driver. The folder is only listed;
    no content but that of the chosen files is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    there = listed.select("path", F.regexp_replace("path", "^file:/*", "/").alias("p")).join(paths.select(F.col("path").alias("p")).distinct(), "p", "left_semi")
    names = (re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in there.select("path").toLocalIterator())
    while some := list(itertools.islice(names, block)):
        yield _scanned(spark.read.format("binaryFile").load(some), excluded)


def plain_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid; a byte order mark stays."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def docx_text(content: bytes) -> str:
    """The paragraphs of the body that are not blank, one a line."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{word}body")
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{word}t")) for p in body.findall(f"{word}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def ocr_text(image: bytes) -> str:
    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(image))).strip()


def pdf_text(content: bytes) -> str:
    """The pages' text in the order of the pages; blank pages are read by OCR where that works, a page that cannot be read is left out."""
    import fitz

    pages = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            try:
                text = page.get_text().strip() or ocr_text(page.get_pixmap(dpi=150).tobytes("png"))
            except Exception:  # no OCR here, or it fails: the other pages still count
                text = ""
            if text:
                pages.append(text)
    return "\n".join(pages)


EXTRACTORS = {".docx": docx_text, ".pdf": pdf_text}


def extract_text(rows: DataFrame, extractors: dict | None = None) -> DataFrame:
    """rows (path, content) plus text and error; a file that cannot be read has an empty text and says why."""
    chosen = EXTRACTORS if extractors is None else extractors

    @F.pandas_udf("struct<text: string, error: string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            out = []
            for kind, content in zip(kinds, contents):
                try:
                    out.append((chosen[kind](bytes(content)), None))
                except Exception as e:  # one bad file must not end the job
                    out.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    kind = suffix(F.col("path"))
    parsed = rows.where(kind.isin(*chosen)).withColumn("_x", run(kind, F.col("content")))
    parsed = parsed.withColumn("text", F.col("_x.text")).withColumn("error", F.col("_x.error")).drop("_x")
    plain = rows.where(~kind.isin(*chosen)).withColumn("text", plain_text(F.col("content"))).withColumn("error", F.lit(None).cast("string"))
    return parsed.unionByName(plain)
