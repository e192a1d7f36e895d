"""Overlapping word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.config import CHUNK_OVERLAP, CHUNK_WORDS
from lumidex.functions.text import split_words


def chunk(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk_index, text): windows of ``size`` words, ``size - overlap`` (at least one) apart, joined by single blanks.

    Null and blank texts give none. The last window may lie within the one before.
    """
    step = max(1, size - overlap)
    rows = docs.select(F.col(id_col), split_words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    rows = rows.select(F.col(id_col), "_w", F.posexplode(starts).alias("chunk_index", "_s"))
    return rows.select(F.col(id_col), "chunk_index", F.array_join(F.slice("_w", F.col("_s") + 1, size), " ").alias("text"))
