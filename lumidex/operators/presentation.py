"""What a result list shows: cutoff, ranks, badges and subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.config import CUTOFF
from lumidex.functions.text import parent, suffix


def cut(results: DataFrame, order: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Results that score at least the cutoff if the first one does, else all; for a list behind a limit."""
    first = F.first("score").over(Window.orderBy(*order))
    return results.withColumn("_first", first).where((F.col("_first") < cutoff) | (F.col("score") >= cutoff)).drop("_first")


def badge(path: Column) -> Column:
    end = suffix(path)
    return F.when(end == ".pdf", "PDF").when(end.isin(".docx", ".doc"), "DOC").when(end == ".txt", "TXT").when(end == ".md", "MD").otherwise("FILE")


def subtitle(snippet: Column, path: Column) -> Column:
    return F.when(snippet != "", F.substring(snippet, 1, 95)).otherwise(parent(path))


def presented(results: DataFrame, order: list[str]) -> DataFrame:
    """results with rank from 0, the title's and subtitle's opacity, badge and subtitle."""
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    rows = results.withColumn("rank", rank).withColumn("_n", F.count("*").over(Window.partitionBy()))
    alpha = F.when(F.col("_n") <= 1, 232).otherwise((232 - F.col("rank") / (F.col("_n") - 1) * 102).cast("int"))
    rows = rows.withColumn("alpha", alpha.cast("int"))
    return rows.withColumns(
        {
            "subtitle_alpha": F.greatest(F.lit(80), F.col("alpha") - 100),
            "badge": badge(F.col("path")),
            "subtitle": subtitle(F.col("snippet"), F.col("path")),
        }
    ).drop("_n")
