"""The full-text index: postings, statistics, BM25, phrases and snippets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.config import KEYWORD_HIGH, KEYWORD_LOW, KEYWORD_STEP, SNIPPET
from lumidex.functions.text import FOLD_FROM, FOLD_TO, TOKEN, TOKEN_CHAR, fts_tokens, fts_tokens_of, query_words_of

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokenised(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(chunk_id, tokens) of the chunks with a text."""
    return chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), fts_tokens(F.col(text_col)).alias("tokens"))


def build_postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text", *more: str) -> DataFrame:
    """(term, chunk_id, tf, positions, len, ...): the positions of each term in a chunk and the chunk's length in tokens.

    Tokens are laid out by position and put together by term; all tokens of a chunk lie in one task, so that little is left to shuffle.
    """
    rows = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), fts_tokens(F.col(text_col)).alias("tokens"), *more)
    placed = rows.select("chunk_id", F.size("tokens").alias("len"), *more, F.posexplode("tokens").alias("position", "term"))
    held = placed.groupBy("chunk_id", "term").agg(F.array_sort(F.collect_list("position")).alias("positions"), *[F.first(c).alias(c) for c in ("len", *more)])
    return held.select("term", "chunk_id", F.size("positions").alias("tf"), "positions", "len", *more)


def term_statistics(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, df, cf): chunks that hold a term and its occurrences, counted in one pass with partial sums before the shuffle."""
    rows = tokenised(chunks, id_col, text_col)
    one = lambda df, cf: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf"))
    both = F.concat(F.transform(F.array_distinct("tokens"), one(1, 0)), F.transform("tokens", one(0, 1)))
    return rows.select(F.explode(both).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))


def corpus_statistics(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row (n_chunks, mean_length)."""
    return tokenised(chunks, id_col, text_col).agg(F.count("*").alias("n_chunks"), F.avg(F.size("tokens").cast("double")).alias("mean_length"))


def query_phrases(query: str) -> list[list[str]]:
    """The phrases of a query: the tokens of each of its words, an empty list where a word cannot be asked for."""
    words = query_words_of(query)
    if any('"' in w for w in words):
        return []
    return [p for w in words if (p := fts_tokens_of(w))]


def bm25(chunks: DataFrame, query: str, id_col: str = "id", text_col: str = "text", repeated: bool = False) -> DataFrame:
    """(chunk_id, rank) of the chunks with any of the query's phrases; the smaller the better.

    One pass over the chunks counts each phrase within the row; document frequencies, the number of chunks and their mean length are one row of
    aggregates. Repeated words count again. Statistics cover all chunks. Where rows may repeat an id (``repeated``) they count once; their counts are shuffled
    for that and not their texts.
    """
    phrases = query_phrases(query)
    if not phrases:
        return chunks.sparkSession.createDataFrame([], "chunk_id bigint, rank double")
    folded = F.translate(F.lower(F.col(text_col)), FOLD_FROM, FOLD_TO)
    rows = chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), folded.alias("_t"))
    gap = rf"(?:(?!{TOKEN_CHAR})[\s\S])+"
    counts = {}
    for i, phrase in enumerate(phrases):
        seek = rf"(?<!{TOKEN_CHAR})(?={gap.join(phrase)}(?!{TOKEN_CHAR}))"
        counts[f"tf{i}"] = F.when(F.col("_t").contains(phrase[0]), F.regexp_count("_t", F.lit(seek)).cast("double")).otherwise(0.0)
    # The statistics are one row over all chunks; the hits are only sought among chunks that hold a phrase's first token.
    rows = rows.withColumn("len", F.regexp_count("_t", F.lit(TOKEN)).cast("double"))
    totals = [F.sum(F.when(F.col(k) > 0, 1.0).otherwise(0.0)).alias(f"df_{k}") for k in counts]
    once = lambda df: df.dropDuplicates(["chunk_id"]) if repeated else df
    counted = once(rows.select("chunk_id", "len", *[c.alias(k) for k, c in counts.items()]))
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *totals)
    some = reduce(or_, [F.col("_t").contains(p[0]) for p in phrases])
    hits = once(rows.where(some).select("chunk_id", "len", *[c.alias(k) for k, c in counts.items()]))
    joined = hits.where(" OR ".join(f"{k} > 0" for k in counts)).crossJoin(F.broadcast(stats))  # one row
    score = reduce(add, [_weight(F.col(k), F.col(f"df_{k}")) for k in counts])
    return joined.select("chunk_id", (-score).alias("rank"))


def _weight(tf: Column, df: Column) -> Column:
    """A phrase's part of a chunk's score, beside the columns n, len and avg."""
    idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, LEAST_IDF).otherwise(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))


def _moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def bm25_of_postings(postings: DataFrame, corpus: DataFrame, query: str) -> DataFrame:
    """(chunk_id, rank) as ``bm25`` gives, from stored postings (term, chunk_id, positions, len) and one row (n_chunks, mean_length) of the corpus.

    Only the rows of the query's terms are asked for; a phrase of several tokens keeps the chunks in which they stand one after another.
    """
    phrases = query_phrases(query)
    if not phrases:
        return postings.sparkSession.createDataFrame([], "chunk_id bigint, rank double")
    parts = []
    for n, phrase in enumerate(phrases):
        rows = None
        for at, term in enumerate(phrase):
            own = postings.where(F.col("term") == term).select("chunk_id", "len", _moved("positions", at).alias("at"))
            both = None if rows is None else rows.join(own.select("chunk_id", F.col("at").alias("also")), "chunk_id")
            rows = own if both is None else both.select("chunk_id", "len", F.array_intersect("at", "also").alias("at"))
        parts.append(rows.where(F.size("at") > 0).select("chunk_id", "len", F.lit(n).alias("phrase"), F.size("at").cast("double").alias("tf")))
    hits = reduce(DataFrame.unionByName, parts)
    df = hits.groupBy("phrase").agg(F.count("*").cast("double").alias("df"))  # a row for each phrase of the query
    one = corpus.select(F.col("n_chunks").cast("double").alias("n"), F.col("mean_length").alias("avg"))
    scored = hits.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(one))
    return scored.groupBy("chunk_id").agg((-F.sum(_weight(F.col("tf"), F.col("df")))).alias("rank"))


def keyword_score(rank):
    """The score of a rank, between 0.5 and 0.85; a better (more negative) rank gives the lower one."""
    return F.round(F.least(F.lit(KEYWORD_HIGH), F.greatest(F.lit(KEYWORD_LOW), 1 + rank * KEYWORD_STEP)), 4)


def best_per_file(ranked: DataFrame) -> DataFrame:
    """Of (file_id, chunk_id, rank) rows, the best one of each file."""
    best = F.min(F.struct("rank", "chunk_id")).alias("b")
    return ranked.groupBy("file_id").agg(best).select("file_id", F.col("b.chunk_id").alias("chunk_id"), F.col("b.rank").alias("rank"))


def phrase_match(chunks: DataFrame, phrase: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(chunk_id) of the chunks in which the tokens of ``phrase`` stand one after another."""
    tokens = fts_tokens_of(phrase)
    if not tokens:
        return chunks.sparkSession.createDataFrame([], "chunk_id bigint")
    text = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    return tokenised(chunks, id_col, text_col).where(text.contains(f" {' '.join(tokens)} ")).select("chunk_id").distinct()


def snippet_of(text: str, words: list[str], size: int = 40) -> str:
    """The window of ``size`` tokens with the best cover of the words, hits in guillemets, ``…`` where text is left out.

    A window scores 1,000 for the first hit of a word and 1 for a further one; it starts at a hit, moved so that its hits stand in the middle, or
    at the sentence before, for 100 (the text's start 120) more. The first of several best windows is taken.
    """
    spans = [(m.start(), m.end(), m.group().lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))) for m in regex.finditer(TOKEN, text)]
    n, place = len(spans), {w: i for i, w in enumerate(words)}
    hits = [(i, place[t]) for i, (_, _, t) in enumerate(spans) if t in place]
    if not hits:
        return text if n <= size else text[: spans[size - 1][1]] + "…"
    starts = [0] + [i for i in range(1, n) if (gap := text[spans[i - 1][1] : spans[i][0]]) and gap[-1].isspace() and (g := gap.rstrip()) and g[-1] in ".:"]

    def window(p: int) -> tuple[int, int]:
        seen, score, inside = set(), 0, []
        for i, w in hits:
            if p <= i < p + size:
                score += 1 if w in seen else 1000
                seen.add(w)
                inside.append(i)
        if not inside:
            return score, p
        moved = inside[0] - int((size - (inside[-1] + 1 - inside[0])) / 2)
        if moved + size > n:
            moved = n - size
        return score, max(moved, 0)

    best, at = -1, 0
    for i, _ in hits:
        score, moved = window(i)
        if score > best:
            best, at = score, moved
        if n > size:
            before = max((s for s in starts if s <= i), default=0)
            if before < i:
                score = window(before)[0] + (120 if before == 0 else 100)
                if score > best:
                    best, at = score, before
    inside = {i for i, _ in hits}
    out, last = ["…" if at > 0 else ""], 0 if at == 0 else spans[at][0]
    for i in range(at, min(at + size, n)):
        a, b, _ = spans[i]
        out.append(text[last:a] + (f"»{text[a:b]}«" if i in inside else text[a:b]))
        last = b
    return "".join(out) + ("…" if at + size < n else text[last:])


def with_snippets(rows: DataFrame, query: str, text_col: str = "text", out: str = "snippet") -> DataFrame:
    """rows plus a snippet for a query; meant for the few rows behind a limit."""
    words = sorted({t for p in query_phrases(query) for t in p})

    @F.pandas_udf("string")
    def snip(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: snippet_of(t, words)[:SNIPPET].replace("\n", " ").strip() if t is not None else "")

    return rows.withColumn(out, snip(text_col))


def rank_within(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows plus their position from 1; only for rows behind a limit."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
