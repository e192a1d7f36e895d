"""Sentences of texts in many languages and scripts, in SQL expressions alone.

Marks that end nothing (in numbers, addresses, file names, initials and abbreviations) are replaced by a private-use
placeholder of one code point, so that offsets hold; a break is then written after every remaining terminator of the text's
scripts and taken out again inside quotations that their sentence runs past; the text is split at the breaks and the
placeholders are turned back. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumidex.functions.arrays import running_totals
from lumidex.functions.text import not_blank
from lumidex.llm.text_quality import words_pattern

DOT, BREAK, UNIT = "\ue000", "\ue001", "\ue002"  # a masked dot; the end of a sentence; of a paragraph, heading or list item
BEFORE = r"(?<![\p{L}\p{M}\p{N}])"

# Abbreviations after which a sentence goes on whatever follows (titles, streets, examples).
ALWAYS = (
    "Mr Mrs Ms Dr Prof St Rev Gen Sen Capt Lt Col Hon Messrs Mt e.g i.e vs cf viz "
    "Hr Fr Frl Dipl Ing z.B d.h u.a bzw "
    "Sr Sra Srta Sres Dra Avda Ud Uds D Dª p.ej "
    "MM Mme Mlle Mgr Me p.ex "
    "Exmo Av Eng "
    "ul al dr inż mgr prof ks tj tzn m.in np "
    "ул пр пер д-р проф г-н г-жа гр акад т.е т.к "
    "Sn Doç Av örn bkz "
    "κ κα κος π.χ βλ "
    "د أ م "
    "डॉ श्री प्रो"
).split()
# Abbreviations that go on only before a number.
NUMBERED = (
    "p pp Fig Figs Sec Secs No Nos Vol Ch Art Eq approx ca c Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec "
    "Nr Abs Nrn S Bd Kap Str Art geb etwa "
    "pág págs núm núms aprox art cap "
    "env n no fig chap vol "
    "nr str poz ok godz tel pkt "
    "стр с рис п ст гл ок см е № "
    "s no sf yakl md "
    "σελ αρ περ "
    "ص رقم "
    "सं पृ"
).split()
# German words before, or months behind, an ordinal's dot.
ORDINAL_BEFORE = "dem den der die das des am vom zum bis ab im"
ORDINAL_BEHIND = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
CLOSING = r"[\"”“’'»)\]]"
GO_ON = r"(?:\p{Ll}|[–—])"


def _holds(text: Column, bytes_: str) -> Column:
    """Whether a text holds a sequence of bytes in UTF-8, such as the ones that all characters of a script begin with."""
    return F.contains(text, F.expr(f"cast(X'{bytes_}' as string)"))


def _dots() -> str:
    """A pattern for the dots that end nothing, in one pass: marks of numbered items, dots within numbers, addresses and file names, of
    abbreviations, initials and ordinals."""
    item = rf"((?:^|{UNIT})\s*\p{{Nd}}{{1,3}})\.(?=[ \t])"
    within = r"(?=[\p{L}\p{N}_/])"
    always = rf"(?<={BEFORE}(?:{words_pattern(ALWAYS)})\.)"
    initial = rf"(?=\s+\p{{Lu}})(?<={BEFORE}\p{{Lu}}\.)|(?=\s\p{{L}}\.)(?<={BEFORE}\p{{L}}\.)"
    ordinal = rf"(?<=\p{{Nd}}\.)(?:(?=\s(?:{words_pattern(ORDINAL_BEHIND.split())})\b)|(?=\s\p{{Lu}})(?<={BEFORE}(?:{words_pattern(ORDINAL_BEFORE.split())})\s\p{{Nd}}{{1,2}}\.))"
    numbered = rf"(?=\s*[\p{{N}}№])(?<={BEFORE}(?:{words_pattern(NUMBERED)})\.)"
    return rf"{item}|\.(?:{within}|(?=\s)(?:{always}|{initial}|{ordinal})|{numbered})"


QUOTATIONS = (
    ("“", "„“”", rf"“(?:\s+{GO_ON}|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"),
    ("”", "„“”", rf"”(?:\s+{GO_ON}|[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}])"),
    ('"', '"', rf'"\s+{GO_ON}'),
    ("»", "«»", rf"»\s+{GO_ON}"),
    ("’", "‘’", rf"’\s+{GO_ON}"),
    ("」", "「」", r"」\p{L}"),
    ("』", "『』", r"』\p{L}"),
)


def _mark(rows: DataFrame, column: str) -> DataFrame:
    """Breaks written into a text column after each sentence and unit; without them the text has its former length.

    Each step is a projection of its own: a step that names the text twice would otherwise double the work of all before it. Steps that few texts
    need stand behind a search for bytes, which reads a text several times as fast as a pattern does.
    """
    t = F.col(column)

    def step(pattern: str, put: str, only: Column | None = None) -> None:
        nonlocal rows
        new = F.regexp_replace(t, pattern, put)
        rows = rows.withColumn(column, new if only is None else F.when(only, new).otherwise(t))

    rows = rows.withColumn(column, F.when(t.contains(DOT) | t.contains(BREAK) | t.contains(UNIT), F.translate(t, DOT + BREAK + UNIT, "\ufffd\ufffd\ufffd")).otherwise(t))
    # Units: blank lines, then list items, numbered ones only below a blank line or another item.
    step(r"(\n[ \t\r]*\n|\n[ \t]*[-*•‣▪◦·+#][ \t])", UNIT + "$1", t.contains("\n"))
    number = r"[ \t]*\p{Nd}{1,3}[.)][ \t]"
    step(rf"((?:^|\n){number}[^\n]+)(?=\n{number})", "$1" + UNIT, t.contains("\n") & t.rlike(rf"\n{number}"))
    step(_dots(), "$1" + DOT)
    # Terminators with white space behind them, unless what follows shows that the sentence goes on; those of scripts without spaces at once.
    step(rf"([.!?…؟۔।॥]+(?:\s?»|{CLOSING})*+)(?=\s+(?!{GO_ON})\S)", "$1" + BREAK)
    step(r"([。！？]++(?:[」』”’）】》]++(?!\p{L}))?+)(?![」』”’）】》])", "$1" + BREAK, _holds(t, "E38082") | _holds(t, "EFBC81") | _holds(t, "EFBC9F"))
    step(
        rf"((?<=[\u0370-\u03ff\u1f00-\u1fff]);{CLOSING}*|;{CLOSING}*(?=\s+[\u0370-\u03ff]))(?=\s+(?!{GO_ON})\S)",
        "$1" + BREAK,
        t.contains(";") & (_holds(t, "CD") | _holds(t, "CE") | _holds(t, "CF") | _holds(t, "E1BC") | _holds(t, "E1BD") | _holds(t, "E1BE") | _holds(t, "E1BF")),
    )
    step(rf"(?<=[\u0e00-\u0e7f])(?=[ \t]+[^\s\p{{Nd}}{BREAK}])|(?<=[^\s\p{{Nd}}{BREAK}])(?=[ \t]+[\u0e00-\u0e7f])", BREAK, _holds(t, "E0B8") | _holds(t, "E0B9"))
    # Breaks within quotations that the sentence runs past: a text cut before each of their marks and each unit, whose pieces lose their breaks where the next one begins with such a mark.
    for closing, inner, beyond in QUOTATIONS:
        pieces = F.split(t, f"(?=[{inner}{UNIT}])")
        behind = F.concat(F.slice("pieces", 2, F.size("pieces")), F.array(F.lit("")))
        joined = F.zip_with("pieces", behind, lambda x, y: F.when(y.rlike(f"^{beyond}"), F.replace(x, F.lit(BREAK), F.lit(""))).otherwise(x))
        rows = rows.withColumn("pieces", F.when(t.contains(closing) & t.rlike(beyond), pieces))
        rows = rows.withColumn(column, F.when(F.col("pieces").isNull(), t).otherwise(F.array_join(joined, ""))).drop("pieces")
    return rows.withColumn(column, F.replace(t, F.lit(UNIT), F.lit(BREAK)))


def split_sentences(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, start, end, sentence): sentences as code-point offsets from 0, end exclusive, without surrounding white space.

    Null and blank texts give no sentences, nor does an empty table; a text without any terminator is one sentence. Private-use characters
    U+E000 to U+E002 of a text count as ordinary characters and come out as U+FFFD in ``sentence``, not in the offsets. Every row is split,
    rows with a null or repeated id too; other columns are not read.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(not_blank(F.col("text")))
    rows = _mark(rows, "text").select("id", F.split("text", BREAK).alias("parts"))
    rows = rows.select("id", F.arrays_zip(F.col("parts").alias("part"), running_totals(F.transform("parts", F.length)).alias("at")).alias("parts"))
    parts = F.filter("parts", lambda x: F.ltrim(x["part"], F.lit(BLANKS)) != "")
    # The outer form, since Spark would otherwise infer a filter on the array and push it, written out, below all steps.
    found = rows.select("id", F.posexplode_outer(parts).alias("position", "x")).where(F.col("position").isNotNull()).select("id", "position", "x.*")
    found = found.withColumn("tail", F.ltrim(F.col("part"), F.lit(BLANKS))).withColumn("body", F.rtrim(F.col("tail"), F.lit(BLANKS)))
    start = F.col("at") + F.length("part") - F.length("tail")
    return found.select("id", "position", start.cast("bigint").alias("start"), (start + F.length("body")).cast("bigint").alias("end"), F.replace("body", F.lit(DOT), F.lit(".")).alias("sentence"))
