"""Matches of a query in file names, in three tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.config import ALL_WORDS_SCORE, ANY_WORD_SCORE, PER_WORD, SUBSTRING_SCORE
from lumidex.functions.text import ascii_lower, like_pattern, query_words_of


def substring_matches(files: DataFrame, query: str, k: int) -> DataFrame:
    """(id, path, filename, score): the first k files, by id, whose name has the whole query."""
    hit = ascii_lower(F.col("filename")).like(like_pattern(query.lower()))
    return _first(files.where(hit), k, F.lit(SUBSTRING_SCORE))


def all_words_matches(files: DataFrame, query: str, k: int) -> DataFrame:
    """The first k files whose name has every word of a query of two or more."""
    words = query_words_of(query)
    if len(words) < 2:
        return _first(files.limit(0), k, F.lit(ALL_WORDS_SCORE))
    name = ascii_lower(F.col("filename"))
    return _first(files.where(reduce(lambda a, b: a & b, [name.like(like_pattern(w)) for w in words])), k, F.lit(ALL_WORDS_SCORE))


def any_word_matches(files: DataFrame, query: str, k: int) -> DataFrame:
    """The first 2k files whose name has a word of the query, with 0.8 to 0.9 by the share of words that it has."""
    words = query_words_of(query)
    if not words:
        return _first(files.limit(0), 2 * k, F.lit(ANY_WORD_SCORE))
    name = ascii_lower(F.col("filename"))
    hit = reduce(lambda a, b: a | b, [name.like(like_pattern(w)) for w in words])
    lower = F.lower("filename")
    share = reduce(lambda a, b: a + b, [lower.contains(w).cast("int") for w in words]) / len(words)
    return _first(files.where(hit), 2 * k, F.round(ANY_WORD_SCORE + PER_WORD * share, 4))


def _first(files: DataFrame, n: int, score) -> DataFrame:
    live = files.where((F.lower(F.trim("status")) == "indexed") & F.col("filename").isNotNull())
    return live.select("id", "path", "filename", score.cast("double").alias("score")).orderBy("id").limit(n)
