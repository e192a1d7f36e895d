"""Noise in text read from scanned pages, found and repaired.

Words that differ only in glyphs a scanner confuses have one skeleton; a rare form that confusions of one of the skeleton's frequent
forms can give is a misreading, of the form that the corpus has beside its neighbours if there are several. Lines that come again in a text once their digits are masked are running headers;
lone numbers between lines of text are page numbers. What remains is reflowed by windows over the lines: words that were split by a
hyphen-like mark are joined unless the corpus writes them with a hyphen, and lines run on until a paragraph ends.

Word counts cover the whole corpus; the most frequent words that are no misreadings are broadcast (at most ``FREQUENT`` of them) so that
only the rows of other words are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumidex.functions.text import not_blank
from lumidex.session import cut_lineage

FREQUENT = 10_000
LEAST_FORM, LEAST_RATIO = 8, 25  # documents with the frequent form; times as many as with the rare one
WORD = r"[\p{L}\p{M}\p{N}ﬁﬂ]+"
# Glyph sequences and glyphs that scanners take for each other; the skeleton puts the second in place of the first.
SEQUENCES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ü", "u"), ("li", "h"))
DIGITS = ("0159", "olsg")
GLYPHS = ("bcfai", "hetol")
# A letter and the glyph it is read as.
READ_AS = "ec hb ao tf o0 l1 i1 il s5 g9 b6 B8".split()
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
SOFT = "‐¬\xad"
MARKS = f"-–{SOFT}"
PAGE = r"^(?:(?:page|seite|p\.|pág\.|pag\.|s\.|стр\.|str\.|σελ\.|sayfa) ?)?[-–—\[(]? ?\p{Nd}{1,4}(?: ?(?:of|von|de|из|/) ?\p{Nd}{1,4})? ?[-–—\])]?\.?$"
# Abbreviations before a number that may begin the next line.
BEFORE_NUMBER = "p pp s pág art nr no núm n abs fig sec стр str σελ αρ ca approx env ок ok yakl см ص सं".split()


def skeleton(word: Column) -> Column:
    out = F.translate(word, *DIGITS)
    for a, b in SEQUENCES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, *GLYPHS)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.where(F.col("id").isNotNull() & not_blank(F.col("text")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): in how many rows each word stands; words joined by hyphens count as a word of their own too."""
    joined = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}+(?:-\p{L}+)+)"), F.lit(1))
    return texts.select(F.explode(F.array_distinct(F.concat(_words(F.col("text")), joined))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def misread_words(counts: DataFrame) -> DataFrame:
    """(word, form, n): rare words of at least four glyphs and the frequent words they may have been."""
    rows = counts.where((F.length("word") >= 4) & ~F.col("word").rlike(r"^\p{N}+$|-")).withColumn("skeleton", skeleton(F.col("word")))
    top = rows.where(F.col("n") >= LEAST_FORM).select("skeleton", F.col("word").alias("form"), F.col("n").alias("n_form"))
    rare = rows.join(top, "skeleton").where((F.col("word") != F.col("form")) & (F.col("n_form") >= LEAST_RATIO * F.col("n")))
    letters = F.zip_with(F.split("word", ""), F.split("form", ""), lambda x, y: (x == y) | F.concat(y, x).isin(READ_AS))
    possible = (F.length("word") != F.length("form")) | F.forall(letters, lambda ok: ok)
    pairs = cut_lineage(rare.where(possible).select("word", "form", F.col("n_form").alias("n")))
    # What is a misreading itself is no form.
    return pairs.join(pairs.select(F.col("word").alias("form")).distinct(), "form", "left_anti").select("word", "form", "n")


def _most_frequent(counts: DataFrame, word: str) -> DataFrame:
    return counts.where(F.col("n") >= LEAST_FORM).orderBy(F.desc("n"), word).limit(FREQUENT).select(word)


def _in_context(texts: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, word, form) of (id, word, left, right, form, n) rows, one form a word of a text: the one that the corpus has most often
    beside the word's neighbours there, then the most frequent one.

    Neighbours are counted only beside the forms of words that have several. The ``FREQUENT`` most frequent of these are broadcast, the
    others joined, for which the corpus's most frequent words besides them are left out before the shuffle.
    """
    counted = cut_lineage(candidates.withColumn("forms", F.size(F.collect_set("form").over(Window.partitionBy("id", "word")))))
    several = counted.where("forms > 1").drop("forms")
    clear = counted.where("forms = 1").select("id", "word", "form").distinct()
    if several.isEmpty():
        return clear
    asked = several.distinct()
    tokens = texts.select(_words(F.col("text")).alias("t"))
    forms = cut_lineage(several.groupBy("form").agg(F.max("n").alias("n")))
    first = cut_lineage(forms.orderBy(F.desc("n"), "form").limit(FREQUENT).select("form"))
    others = forms.join(first, "form", "left_anti").select("form")
    # One pass over the corpus: each pair of neighbours from either word's side, kept only beside an asked form.
    ends = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = tokens.select(F.explode(F.arrays_zip(F.slice("t", 1, ends).alias("x"), F.slice("t", 2, ends).alias("y"))).alias("z"))
    sides = F.array(
        F.struct(F.col("z.x").alias("form"), F.lit(1).alias("side"), F.col("z.y").alias("other")),
        F.struct(F.col("z.y").alias("form"), F.lit(0).alias("side"), F.col("z.x").alias("other")),
    )
    ends_of_pairs = pairs.select(F.explode(sides).alias("s")).select("s.*")
    near = ends_of_pairs.join(F.broadcast(first), "form", "left_semi")
    if not others.isEmpty():
        spared = _most_frequent(counts.withColumnRenamed("word", "form").join(others, "form", "left_anti"), "form")
        near = near.unionByName(ends_of_pairs.join(F.broadcast(spared), "form", "left_anti").join(others, "form", "left_semi"))
    near = near.groupBy("form", "side", "other").agg(F.count("*").alias("c"))
    beside = F.array(F.struct(F.lit(1).alias("side"), F.col("right").alias("other")), F.struct(F.lit(0).alias("side"), F.col("left").alias("other")))
    asked = asked.select("id", "word", "form", "n", F.explode(beside).alias("b")).select("id", "word", "form", "n", "b.*")
    scored = asked.join(near, ["form", "side", "other"], "left").na.fill(0, ["c"])
    best = scored.groupBy("id", "word", "form", "n").agg(F.sum("c").alias("support"))
    chosen = best.groupBy("id", "word").agg(F.max(F.struct("support", "n", "form")).alias("b"))
    return clear.unionByName(chosen.select("id", "word", "b.form"))


def _lines(texts: DataFrame) -> DataFrame:
    """Lines that are not blank of texts that run over several, with what tells text, headers and page numbers apart."""
    lines = texts.where(F.col("text").contains("\n")).select("id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    # Repeated rows of an id become one; the windows below need no further shuffle.
    lines = lines.repartition("id").distinct().withColumn("line", F.trim("line", F.lit(BLANKS)))
    blank = Window.partitionBy("id").orderBy("n")
    lines = lines.withColumn("below_blank", F.coalesce(F.lag("line").over(blank) == "", F.lit(False))).where("line <> ''")
    squeezed = F.regexp_replace(F.regexp_replace(F.lower("line"), r"(?U)\s+", " "), r"\p{Nd}+", "#")
    key = F.regexp_replace(F.regexp_replace(squeezed, r"(?:page |seite |p\. )?#(?: of #)?$|^#", ""), r"^[\s|.·–—-]+|[\s|.·–—-]+$", "")
    lines = lines.withColumn("key", key).withColumn("n_words", F.regexp_count("line", F.lit(r"\p{L}{2,}")))
    # A number at an end of the line, set off by a separator or several blanks, or any number there.
    lines = lines.withColumn("number", F.coalesce(F.nullif(F.regexp_extract("line", r"(\p{Nd}{1,4})$", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^(\p{Nd}{1,4})\b", 1), F.lit(""))))
    whole, same, order = Window.partitionBy("id"), Window.partitionBy("id", "key"), Window.partitionBy("id").orderBy("n")
    lines = lines.withColumns(
        {
            "n_lines": F.count("*").over(whole),
            "mean_words": F.avg("n_words").over(whole),
            "gapped": F.avg(F.col("line").rlike(r"\S {3,}\S|\t|\|.*\||;.*;").cast("int")).over(whole),
            "marked": F.avg(F.col("line").rlike(r"^(?:[-–—*•·▪◦]|\[ ?\]|\p{N}{1,3}[.)]|[a-z]\)) ").cast("int")).over(whole),
            "same": F.count("*").over(same),
            "numbers": F.size(F.collect_set("number").over(same)),
            "before": F.lag("line").over(order),
            "after": F.lead("line").over(order),
        }
    )
    flowing = (F.col("n_lines") >= 3) & (F.col("mean_words") >= 3) & (F.col("gapped") < 0.5) & (F.col("marked") < 0.5)
    abbreviated = F.coalesce(F.lower("before").rlike(r"(?<![\p{L}\p{M}])(?:" + "|".join(BEFORE_NUMBER) + r")\.$"), F.lit(False))
    lone = F.lower("line").rlike(PAGE) & ~(abbreviated & F.col("line").rlike(r"^\p{Nd}+\.?$"))
    header = (
        (F.col("same") >= 2)
        & (F.col("same") <= 0.34 * F.col("n_lines") + 1)
        & F.col("key").rlike(r"\p{L}{2,}.*[^\p{L}]\p{L}{2,}")
        & (F.length("line") <= 90)
        & ~F.col("line").rlike(r"[.!?,;:…。！？।؟][\"”’»)]*$")
        & ~F.col("line").rlike(rf"\p{{L}}[{MARKS}]$")
        & F.col("line").rlike(r"^[\p{Lu}\p{Lt}\p{Lo}\p{N}\[(]")
    )
    pageno = flowing & F.col("before").isNotNull() & F.col("before").rlike(r"\p{L}") & (F.col("after").isNull() | F.col("after").rlike(r"\p{L}")) & lone
    lines = lines.withColumn("flowing", flowing).withColumn("is_page", pageno).withColumn("is_header", flowing & header & ~pageno)
    return lines.withColumn("holds_page", F.col("is_header") & F.col("number").isNotNull() & (F.col("numbers") >= 2))


def _splits(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, part, rest, mark) of words that may have been split: at a line's end, or in a line where the break was lost (n -1)."""
    body = Window.partitionBy("id").orderBy("n")
    at_end = (
        lines.where("flowing and not is_page and not is_header")
        .withColumn("next", F.lead("line").over(body))
        .where(F.col("line").rlike(rf"\p{{L}}[{MARKS}]$"))
        .select(
            "id",
            "n",
            F.regexp_extract("line", rf"(\p{{L}}[\p{{L}}\p{{M}}\p{{N}}]*(?:-\p{{L}}+)*)[{MARKS}]$", 1).alias("part"),
            F.regexp_extract("next", r"^(\p{L}[\p{L}\p{M}\p{N}]*(?:-\p{L}+)*)", 1).alias("rest"),
            F.regexp_extract("line", rf"([{MARKS}])$", 1).alias("mark"),
        )
    )
    shape = rf"(\p{{L}}{{2,}}(?:[{MARKS}] |[{SOFT}])\p{{L}}{{2,}})"
    found = texts.where(F.col("text").rlike(shape)).select("id", F.explode(F.regexp_extract_all("text", F.lit(shape), F.lit(1))).alias("x"))
    inside = found.select(
        "id",
        F.lit(-1).alias("n"),
        F.regexp_extract("x", r"^(\p{L}+)", 1).alias("part"),
        F.regexp_extract("x", r"(\p{L}+)$", 1).alias("rest"),
        F.regexp_extract("x", r"^\p{L}+(.)", 1).alias("mark"),
    )
    return at_end.where("part <> '' and rest <> ''").unionByName(inside).distinct()


def _judged(splits: DataFrame, counts: DataFrame) -> DataFrame:
    """The splits that are none of the word's own hyphens: those the corpus does not write with a hyphen (more often)."""
    own = splits.withColumn("whole", F.lower(F.concat("part", "rest"))).withColumn("hyphened", F.lower(F.concat_ws("-", "part", "rest")))
    a = counts.select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    b = counts.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened"))
    j = own.join(a, "whole", "left").join(b, "hyphened", "left").na.fill(0, ["n_whole", "n_hyphened"])
    keeps = (F.col("n_hyphened") > F.col("n_whole")) & (F.col("mark").isin("-", "‐") | (F.col("n_hyphened") >= 3))
    linked = F.lower("rest").isin("und", "oder", "bzw", "and", "or", "y", "o", "et", "ou")
    return j.where(F.when(F.col("n") >= 0, ~keeps & ~linked).otherwise((F.col("n_whole") >= 2) & ~keeps))


SPACED = r"(?<![\p{L}\p{M}\p{N}.'’\-])(\p{L}\p{M}*(?: \p{L}\p{M}*){2,})(?![\p{L}\p{M}\p{N}'’\-])"


def _misreadings(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, word, form) of misread words and (id, spaced letters, word)."""
    misread = cut_lineage(misread_words(counts))
    # A misreading may itself be among the frequent words; what is spared the shuffle are those that are no candidates.
    spared = _most_frequent(counts.join(misread, "word", "left_anti"), "word")
    rare = texts.select("id", _words(F.col("text")).alias("t")).select("id", "t", F.posexplode("t").alias("p", "word")).where(F.length("word") >= 4)
    rare = rare.select("id", "word", F.get("t", F.col("p") - 1).alias("left"), F.get("t", F.col("p") + 1).alias("right"))
    rare = rare.join(F.broadcast(spared), "word", "left_anti").join(misread, "word")
    rare = _in_context(texts, rare, counts)
    spaced = texts.where(F.col("text").rlike(SPACED)).select("id", F.explode(F.regexp_extract_all("text", F.lit(SPACED), F.lit(1))).alias("word"))
    spaced = spaced.withColumn("form", F.regexp_replace("word", " ", "")).withColumn("key", F.lower("form"))
    known = counts.select(F.col("word").alias("key"), "n")
    spaced = spaced.join(known, "key", "left").where((F.length("form") >= 5) | (F.col("n") >= 5)).select("id", "word", "form")
    return rare.select("id", "word", "form").unionByName(spaced).distinct()


def find_noise(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, noise) with one row for each kind in a text: hyphen, misread, header or pageno.

    Null ids, null and blank texts give no row; repeated rows count once; an empty table gives no rows; a text of any length is read whole.
    """
    texts = _texts(documents, id_col, text_col)
    counts = cut_lineage(word_counts(texts))
    lines = cut_lineage(_lines(texts))
    hyphens = _judged(_splits(lines, texts), counts).select("id", F.lit("hyphen").alias("noise"))
    misread = _misreadings(texts, counts).select("id", F.lit("misread").alias("noise"))
    kinds = F.array_compact(F.array(F.when(F.col("is_page") | F.col("holds_page"), F.lit("pageno")), F.when(F.col("is_header"), F.lit("header"))))
    marked = lines.select("id", F.explode(kinds).alias("noise"))
    return hyphens.unionByName(misread).unionByName(marked).distinct()


def repair(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the texts with noise, repaired: headers and page numbers dropped, split and misread words restored, lines run together
    into paragraphs. Texts without noise give no row; otherwise as ``find_noise``. Misread words are restored in lower case or, where the
    misreading began with a capital, with one.
    """
    texts = _texts(documents, id_col, text_col).dropDuplicates(["id"])
    counts = cut_lineage(word_counts(texts))
    lines = cut_lineage(_lines(texts))
    splits = _judged(_splits(lines, texts), counts)
    misread = _misreadings(texts, counts)
    noisy = splits.select("id").union(misread.select("id")).union(lines.where("is_page or is_header").select("id")).distinct()
    body = lines.where("not is_page and not is_header").select("id", "n", "line", "below_blank", "flowing")
    single = texts.where(~F.col("text").contains("\n")).select("id", F.lit(0).alias("n"), F.col("text").alias("line"), F.lit(False).alias("below_blank"), F.lit(True).alias("flowing"))
    body = body.unionByName(single).join(noisy, "id", "left_semi")
    ends = splits.where("n >= 0").select("id", "n", F.lit(True).alias("split"))
    order = Window.partitionBy("id").orderBy("n")
    body = body.join(ends, ["id", "n"], "left").withColumn("split", F.coalesce("split", F.lit(False)))
    # A line begins a paragraph below a blank line, unless a header or page number stood there within a sentence, or where lines do not run on.
    last = F.lag("line").over(order)
    cut = F.lag("split").over(order)
    runs_on = F.coalesce(cut, F.lit(False)) | (F.col("flowing") & (~F.col("below_blank") | ~last.rlike(r"[.!?…。！？।؟:;][\"”’»)]*$")))
    put = F.when(last.isNull(), "").when(F.coalesce(cut, F.lit(False)) | (F.col("flowing") & last.rlike(r"\p{L}[-‐]$")), "").when(runs_on, " ").when(F.col("below_blank"), "\n\n").otherwise("\n")
    text = F.when(F.col("split"), F.regexp_replace("line", rf"[{MARKS}]$", "")).otherwise(F.col("line"))
    body = body.withColumn("piece", F.concat(put, text))
    whole = body.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("text"))
    inner = splits.where("n < 0").select("id", F.concat("part", "mark").alias("word"), F.concat("part", "rest").alias("form"), F.col("rest"), F.col("mark"))
    changes = misread.select("id", "word", "form").unionByName(
        inner.select("id", F.expr("concat(word, ' ', rest)").alias("word"), "form").unionByName(inner.select("id", F.expr("concat(word, rest)").alias("word"), "form"))
    )
    changes = changes.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.length("word")).alias("l"), "word", "form"))).alias("changes"))

    def change(t: Column, x: Column) -> Column:
        capital = F.concat(F.upper(F.substring(x["form"], 1, 1)), F.substring(x["form"], F.lit(2), F.length(x["form"])))
        literal = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["word"], F.lit(r"\E(?![\p{L}\p{N}])"))
        first = F.concat(F.upper(F.substring(x["word"], 1, 1)), F.substring(x["word"], F.lit(2), F.length(x["word"])))
        upper = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), first, F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.regexp_replace(F.regexp_replace(t, literal, x["form"]), upper, capital)

    fixed = whole.join(changes, "id", "left")
    return fixed.select("id", F.when(F.col("changes").isNull(), F.col("text")).otherwise(F.aggregate("changes", F.col("text"), change)).alias("text"))
