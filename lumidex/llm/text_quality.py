"""Per-document text statistics and the kind of text they tell: prose, list, table or junk.

All in SQL expressions over one row: no shuffle of texts, no Python. Tables show in cells that begin or end at the same columns in line after
line, in delimiters that stand as often in nearly every line or in drawn borders; lists in marks at the starts of lines (or within a text whose breaks were
lost) with short items behind them, in short lines without the common words of any language, and in indentation or line lengths that come again with a period; junk in repeated
lines, in long unbroken tokens, in words with hardly a vowel and in texts of symbols. Ratios of words, symbols and punctuation keep prose apart.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.functions.arrays import running_totals
from lumidex.functions.text import is_ascii, not_blank, plain_words

MARK = r"(?:[-–—*•·▪◦‣●○■□☐☑✓>]|\[[ xX]?\]|\(?\p{N}{1,3}[.)]|\(?[a-zA-Z][.)])"
END = r"[.!?…。！？।؟][\"”’»)」』\]]*+"
ASCII_END, BEHIND = r"[.!?][\")\]]*+", r"([ \t]*(?:[\r\n]|$)|\s)"  # of texts of ASCII alone
# Classes of single characters are read from a table; ranges are tried one after another.
LETTERS, HEX = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefABCDEF"
DELIMITERS = {"pipe": "|", "tab": "\t", "semicolon": ";", "comma": ","}
SEPARATORS = ("/", "»", ">", "\u203a", "→", "::", "~")
LEAST_LINES = 3
MOST_LAG = 8  # lines from one record to the next


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, pattern: str) -> Column:
    """How many characters of a text belong to runs of a pattern; taking out runs is cheaper than counting characters."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def words_pattern(words: list[str]) -> str:
    """A pattern for any of the words that shares their beginnings, so that a word of the text is read once and not once for each of them."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [re.escape(ch) + write(below) for ch, below in sorted(node.items()) if ch]
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{whole})?" if "" in node else whole

    return write(tree) or "(?!)"


def _mode(values: Column) -> Column:
    """The most frequent of a few integers (the smallest one of several), or null."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-v).alias("v")))
    return -F.array_max(counted).getField("v")


def _delimiters(lines: Column, mark: str) -> Column:
    """How often a mark stands in each line, not counting those at its end (tabs count there too)."""
    bare = lines if mark == "\t" else F.transform(lines, lambda x: F.regexp_replace(x, r"[;,.\s]+$", ""))
    return F.transform(bare, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))


def _sum(values: Column, start=0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, x: a + x)


def _with_period(rows: DataFrame, name: str, values: Column) -> DataFrame:
    """Adds the highest autocorrelation of a series over the lags 2 to ``MOST_LAG`` that it holds three times, over what chance gives a series as long
    (2.5 standard errors, at least a half); 0 for short or constant series and where ``values`` is null. From 1 on, the series has a period.

    Each step is a column of its own, since a lambda would compute what it names anew for each element."""
    rows = rows.withColumn("_v", values)
    rows = rows.withColumn("_v", F.when((F.size("_v") >= 6) & (F.array_max("_v") > F.array_min("_v")), F.col("_v")))
    rows = rows.withColumn("_mean", _sum(F.col("_v")) / F.size("_v"))
    rows = rows.withColumn("_v", F.transform("_v", lambda v: v - F.col("_mean")))
    x, n = F.col("_v"), F.size("_v")
    lags = F.sequence(F.lit(2), F.least(F.lit(MOST_LAG), F.floor(n / 3).cast("int")))
    lagged = lambda k: _sum(F.zip_with(F.slice(x, F.lit(1), n - k), F.slice(x, k + 1, n - k), lambda a, b: a * b), 0.0) / (n - k)
    strength = F.array_max(F.transform(lags, lagged)) * n / F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    return rows.withColumn(name, F.when(x.isNotNull(), strength / F.greatest(F.lit(0.5), 2.5 / F.sqrt(n))).otherwise(0.0)).drop("_v", "_mean")


def _with_alignment(rows: DataFrame, cells: Column) -> DataFrame:
    """Adds how many columns a line has beside the first, and the share of these that begin (or whose left neighbours end) at the same place as one in the two lines
    above or below. ``cells`` holds each line cut before each cell that follows a gap of blanks or a delimiter; 0 where it is null."""
    rows = rows.withColumn("_cells", cells)
    lengths = F.transform("_cells", lambda p: F.transform(p, F.length))
    rows = rows.withColumn("_at", F.transform(lengths, running_totals))
    # The first cell holds the line's indentation; positions count from the line's beginning.
    starts = F.transform("_at", lambda a: F.slice(a, F.lit(2), F.size(a)))
    ends = F.zip_with("_at", "_cells", lambda a, p: F.slice(F.zip_with(a, p, lambda s, c: s + F.length(F.rtrim(c, F.lit(" \t|;")))), F.lit(1), F.size(p) - 1))
    n = F.size("_cells")
    shares = []
    for name, at in (("_starts", starts), ("_ends", ends)):
        rows = rows.withColumn(name, at)
        line = F.array().cast("array<int>")
        near = [F.concat(F.array(*[line] * k), F.slice(name, F.lit(1), n - k)) for k in (1, 2)] + [F.concat(F.slice(name, F.lit(k + 1), n - k), F.array(*[line] * k)) for k in (1, 2)]
        rows = rows.withColumn(name + "_near", F.transform(F.arrays_zip(*[x.alias(f"l{k}") for k, x in enumerate(near)]), lambda x: F.flatten(F.array(*[x[f"l{k}"] for k in range(4)]))))
        same = F.zip_with(name, name + "_near", lambda x, y: F.size(F.array_intersect(x, y)))
        shares.append(_sum(same) / F.greatest(_sum(F.transform(name, F.size)), F.lit(1)))
    columns = {"columns_per_line": (_sum(F.transform("_cells", F.size)) - n) / n, "aligned_share": F.greatest(*shares)}
    return rows.withColumns({k: F.when(F.col("_cells").isNotNull(), v).otherwise(0.0) for k, v in columns.items()}).drop("_cells", "_at", "_starts", "_ends", "_starts_near", "_ends_near")


def text_statistics(documents: DataFrame, id_col: str, text_col: str, common_words: list[str]) -> DataFrame:
    """One row a document with a text that is not blank (rows that repeat come out once): (id, n_chars, n_words, mean_word_length, symbol_ratio,
    digit_ratio, letter_ratio, ascii_ratio, vowel_ratio, long_token_ratio, n_lines, terminal_line_share, sentence_count, common_word_share, distinct_word_share,
    distinct_line_share, marked_line_share, marked_char_share, inline_marks, before_marks, inline_item_words, mean_line_words, indent_period, length_period,
    line_length_autocorrelation, delimiter_share, columns_per_line, aligned_share, inline_separators, inline_pipes, inline_gaps, border_lines, cid_codes), the last one counting glyph numbers and runs of hex bytes.

    Ratios are between 0 and 1 and 0 where nothing can be counted; periods are autocorrelations over those of chance, from 1 on there is one. Null and blank texts
    and null ids give no row; texts of any length are read whole.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    return _statistics(rows, common_words).dropDuplicates(["id", "digest"]).drop("digest")


def _statistics(rows: DataFrame, common_words: list[str]) -> DataFrame:
    """The statistics of (id, text, digest) rows, repeated ones included."""
    rows = rows.where(F.col("id").isNotNull() & not_blank(F.col("text")))
    t = F.col("text")
    zero = lambda when, value: F.when(when, value).otherwise(0)
    # Characters by kind: what one pass takes out the next one need not read.
    rows = rows.withColumn("rest", F.regexp_replace(t, f"[{LETTERS}]+", "")).withColumn("n_ascii", F.length(t) - F.length("rest"))
    rows = rows.withColumn("rest", F.regexp_replace("rest", r"[\p{L}\p{M}]+", "")).withColumn("n_letters", F.length(t) - F.length("rest"))
    rows = rows.withColumn("solid", F.regexp_replace("rest", r"\s+", "")).withColumn("n_solid", F.greatest(F.length(t) - F.length("rest") + F.length("solid"), F.lit(1)))
    rows = rows.withColumn("rest", F.regexp_replace("solid", r"\p{N}+", "")).withColumn("n_digits", F.length("solid") - F.length("rest"))
    rows = rows.withColumn("n_symbols", F.length(F.regexp_replace("rest", r"[.,;:!?'’\"“”«»()\-–]+", ""))).drop("rest", "solid")
    rows = rows.withColumn("lines", F.filter(F.split(t, r"\r?\n|\r"), lambda x: F.trim(x) != "")).withColumn("words", plain_words(t))
    rows = rows.withColumn("n_lines", F.size("lines")).withColumn("n_words", F.size("words")).withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    lines, n_lines, n_words = F.col("lines"), F.col("n_lines"), F.col("n_words")
    several = n_lines >= LEAST_LINES
    item = r"(?:^|\s)(?:[-–—*•·▪◦‣●○☐☑✓]|\[[ xX]?\]|\(?\p{N}{1,3}[.)]|\(?[a-z]\))(?=\s+\S)"
    rows = rows.select(
        "id", "digest", "text", "lines", "n_lines", "n_words",
        F.length("text").alias("n_chars"),
        F.when(n_words > 0, (F.length("joined") - 1 - n_words) / n_words).otherwise(0.0).alias("mean_word_length"),
        (F.col("n_letters") / F.col("n_solid")).alias("letter_ratio"),
        (F.col("n_digits") / F.col("n_solid")).alias("digit_ratio"),
        (F.col("n_symbols") / F.col("n_solid")).alias("symbol_ratio"),
        (F.col("n_ascii") / F.col("n_solid")).alias("ascii_ratio"),
        (_without(t, "[aeiouAEIOU]+") / F.greatest(F.col("n_ascii"), F.lit(1))).alias("vowel_ratio"),
        (_without(t, f"[{LETTERS}0123456789+/=]{{30,}}+") / F.col("n_solid")).alias("long_token_ratio"),
        F.when(is_ascii(t), F.regexp_extract_all(t, F.lit(ASCII_END + BEHIND), F.lit(1))).otherwise(F.regexp_extract_all(t, F.lit(END + BEHIND), F.lit(1))).alias("ends"),
        F.when(t.contains("。") | t.contains("！") | t.contains("？"), _count(t, END + r"(?=\s|$)|[。！？]")).alias("ideographic"),
        F.when(n_words > 0, F.size(F.filter("words", lambda w: w.isin(common_words))) / n_words).otherwise(0.0).alias("common_word_share"),
        F.when(n_words > 0, F.size(F.array_distinct("words")) / n_words).otherwise(1.0).alias("distinct_word_share"),
        F.when(n_lines > 0, F.size(F.array_distinct("lines")) / n_lines).otherwise(1.0).alias("distinct_line_share"),
        (zero(t.contains("(cid:"), _count(t, r"\(cid:\p{N}+\)")) + _count(t, " ".join([f"[{HEX}][{HEX}]"] * 4) + r" (?<=\b.{12})")).alias("cid_codes"),
        _count(t, r"\S+").alias("n_tokens"),
        _count(t, item).alias("inline_marks"),
        zero(reduce(or_, [t.contains(f" {x} ") for x in SEPARATORS]), _count(t, rf"\S +(?:{'|'.join(SEPARATORS)})(?= +\S)")).alias("inline_separators"),
        (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).alias("inline_pipes"),
        zero(t.contains("   ") | t.contains("\t"), _count(t, r"(?<=\S)(?: {3,}|\t)(?=\S)")).alias("inline_gaps"),
    )
    rows = rows.withColumn("sentence_count", F.coalesce("ideographic", F.size("ends")))
    rows = rows.withColumn("terminal_line_share", F.size(F.filter("ends", lambda x: ~x.isin(" ", "\t", "\xa0"))) / F.greatest(n_lines, F.lit(1)))
    # Lines: marks, indentation, lengths.
    marked = F.filter(lines, lambda x: x.rlike(rf"^\s*{MARK}\s+\S"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    lengths = F.transform(lines, F.length)
    rows = rows.withColumn("marked", marked).withColumn("lengths", lengths).withColumn("mean_length", _sum(F.col("lengths")) / F.greatest(n_lines, F.lit(1)))
    spread = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean_length")) * (x - F.col("mean_length")))
    next_to = F.zip_with(F.slice("lengths", F.lit(1), n_lines - 1), F.slice("lengths", F.lit(2), n_lines - 1), lambda x, y: (x - F.col("mean_length")) * (y - F.col("mean_length")))
    rows = rows.withColumns(
        {
            "marked_line_share": F.size("marked") / F.greatest(n_lines, F.lit(1)),
            "marked_char_share": total(F.col("marked")) / F.greatest(_sum(F.col("lengths")), F.lit(1)),
            "mean_line_words": F.col("n_tokens") / F.greatest(n_lines, F.lit(1)),
            "border_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[+|][-+=:| ]{3,}\s*$"))),
            "line_length_autocorrelation": F.when(several & (spread > 0), _sum(next_to, 0.0) / spread).otherwise(0.0),
        }
    )
    rows = _with_period(rows, "length_period", F.when(n_lines >= 6, F.transform(lines, lambda x: F.length(F.trim(x, F.lit(" \t"))))))
    indents = F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t"))))
    rows = _with_period(rows, "indent_period", F.when((n_lines >= 6) & (t.contains("\n ") | t.contains("\n\t")), indents))
    # Delimiters: for each, the share of lines with as many as most lines have, at least one (two where prose has them as well).
    shares = {}
    for name, mark in DELIMITERS.items():
        least = 1 if name in ("pipe", "tab") else 2
        rows = rows.withColumn(f"_{name}", F.when(several & t.contains(mark), _delimiters(lines, mark)))
        rows = rows.withColumn("_mode", _mode(F.col(f"_{name}")))
        same = F.size(F.filter(F.col(f"_{name}"), lambda x: x == F.col("_mode")))
        rows = rows.withColumn(f"_{name}", F.when(F.col("_mode") >= least, same / n_lines).otherwise(0.0))
        shares[name] = F.col(f"_{name}")
    rows = rows.withColumn("delimiter_share", F.greatest(*shares.values()))
    # Vertical alignment of what parts the cells: gaps of blanks and delimiters.
    parted = t.contains("  ") | t.contains("|") | t.contains("\t") | t.contains(";")
    # The indentation is made one word, so that it stays with the line's first cell.
    cells = F.transform(lines, lambda x: F.split(F.concat(F.repeat(F.lit("x"), F.length(x) - F.length(F.ltrim(x, F.lit(" \t")))), F.ltrim(x, F.lit(" \t"))), r"(?<=  |[|;\t] ?)(?=[^\s|;])"))
    rows = _with_alignment(rows, F.when(several & parted, cells))
    first = F.regexp_extract(t, rf"(?s)^(.*?)(?<=^|\s)(?:[-–—*•·▪◦‣●○☐☑✓]|\[[ xX]?\]|\(?\p{{N}}{{1,3}}[.)]|\(?[a-z]\))\s", 1)
    rows = rows.withColumn("before_marks", F.when(F.col("inline_marks") > 0, _count(first, r"\S+")).otherwise(n_words))
    inside = (F.col("n_tokens") - F.col("before_marks") - F.col("inline_marks")) / F.greatest(F.col("inline_marks"), F.lit(1))
    return rows.select(
        "id", "digest", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "ascii_ratio", "vowel_ratio", "long_token_ratio", "n_lines", "terminal_line_share",
        "sentence_count", "common_word_share", "distinct_word_share", "distinct_line_share", "marked_line_share", "marked_char_share", "inline_marks", "before_marks",
        F.when(F.col("inline_marks") > 0, inside).otherwise(0.0).alias("inline_item_words"),
        "mean_line_words", "indent_period", "length_period", "line_length_autocorrelation",
        "delimiter_share", "columns_per_line", "aligned_share", "inline_separators", "inline_pipes", "inline_gaps", "border_lines", "cid_codes",
    )


def text_kind() -> Column:
    """prose, list, table or junk, from the statistics."""
    c = F.col
    sentences = c("sentence_count") / F.greatest(c("n_words"), F.lit(1))
    repeated = ((c("n_lines") >= 5) & (c("distinct_line_share") <= 0.34)) | ((c("n_words") >= 30) & (c("distinct_word_share") <= 0.15))
    mash = (c("ascii_ratio") >= 0.6) & (c("n_chars") >= 40) & (c("vowel_ratio") < 0.25) & (c("digit_ratio") < 0.05) & (c("common_word_share") < 0.05)
    # Cells that begin or end at the same columns in line after line, in more columns where there are few lines.
    aligned = (c("n_lines") >= LEAST_LINES) & (c("aligned_share") >= 0.6) & (c("columns_per_line") >= F.when(c("n_lines") >= 6, 0.8).otherwise(1.6))
    symbols = (c("letter_ratio") < 0.12) & (c("delimiter_share") < 0.8) & (c("border_lines") < 2) & ~aligned
    # Names and nouns in a row, with nothing or a separator between them: menus and key words, neither sentences nor a list.
    bare = (c("ascii_ratio") >= 0.6) & (c("n_words") >= 20) & (c("sentence_count") <= 1) & (c("common_word_share") < 0.04) & (c("digit_ratio") < 0.03)
    bare = bare & (c("n_lines") <= 3) & (c("inline_marks") < 4) & (c("inline_gaps") < 6)
    bare = bare & (c("symbol_ratio") - (c("inline_separators") + c("inline_pipes")) / c("n_chars") < 0.05)
    junk = repeated | bare | (c("long_token_ratio") >= 0.5) | (c("cid_codes") >= 5) | symbols
    table = (
        ((c("n_lines") >= LEAST_LINES) & (c("delimiter_share") >= 0.75) & (c("common_word_share") < 0.15))
        | (c("border_lines") >= 2)
        | aligned
        | ((c("inline_pipes") >= 6) & (c("inline_pipes") * 9 >= c("n_words")))
        | ((c("inline_gaps") >= 6) & (c("inline_gaps") * 6 >= c("n_words")))
    )
    by_lines = (c("n_lines") >= 4) & (c("marked_char_share") >= 0.6) & (c("mean_line_words") <= 12)
    inline = (c("n_lines") <= 3) & (c("inline_marks") >= 4) & (c("inline_item_words") <= 9) & (c("before_marks") <= 0.4 * c("n_words")) & (sentences <= 0.34)
    short = (c("n_lines") >= 5) & (c("mean_line_words") <= 5) & (c("common_word_share") < 0.08) & (c("ascii_ratio") + c("digit_ratio") >= 0.4)
    # Items of two or three words, whatever their languages; lines of running text hold more.
    short = short | ((c("n_lines") >= 5) & (c("mean_line_words") <= 3.6) & (c("ascii_ratio") >= 0.25))
    # Records: lines whose indentation or length comes again and again, without the ends of sentences or the words of prose.
    records = ((c("indent_period") >= 1) | (c("length_period") >= 1)) & (c("mean_line_words") <= 12) & (c("terminal_line_share") <= 0.34) & (sentences <= 0.05) & (c("common_word_share") < 0.1)
    records = records & (c("mean_word_length") <= 12)  # scripts without blanks have no words to count
    return F.when(junk, "junk").when(table, "table").when(mash, "junk").when(by_lines | inline | short | records, "list").otherwise("prose")


def not_prose(documents: DataFrame, id_col: str, text_col: str, common_words: list[str]) -> DataFrame:
    """(id, kind) of the documents that are mostly a list, a table or junk; repeated rows come out once."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("bigint").alias("digest"))
    kinds = _statistics(rows, common_words).select("id", text_kind().alias("kind")).select("id", F.when(F.col("kind") != "prose", F.array("kind")).alias("kinds"))
    # The outer form, since a filter on the kind would be pushed below and every statistic written out, and computed, a second time.
    return kinds.select("id", F.explode_outer("kinds").alias("kind")).where(F.col("kind").isNotNull()).distinct()
