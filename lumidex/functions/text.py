"""Text functions on columns: words, tokens, white space."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumidex.config import FILLERS

#: White space as a character class for Java's regular expressions, Unicode blanks and separators included.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"


def plain_words(text: Column) -> Column:
    """Words of a text: pieces between white space, lower case, only their letters and digits, none empty.
    Null stays null; a text without words gives an empty array."""
    # Texts of ASCII alone, which most are, take classes of single characters: one look at a table a character.
    lower, plain, blanks = F.lower(text), "abcdefghijklmnopqrstuvwxyz0123456789", r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F"
    ascii_words = F.split(F.regexp_replace(lower, f"[^{plain}{blanks}]+", ""), f"[{blanks}]+")
    words = F.split(F.regexp_replace(lower, rf"[^\p{{L}}\p{{N}}{SPACE}]+", ""), rf"[{SPACE}]+")
    return F.array_remove(F.when(is_ascii(text), ascii_words).otherwise(words), "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def not_blank(text: Column) -> Column:
    return text.isNotNull() & text.rlike(rf"[^{SPACE}]")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case for ASCII letters alone, as file names are compared."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(word: str) -> str:
    """A LIKE pattern for a word anywhere; % and _ in it stay wildcards, a backslash stands for itself."""
    return "%" + word.replace("\\", "\\\\") + "%"


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def query_words(text: Column) -> Column:
    """A query's words in lower case without fillers and single characters."""
    fillers = F.array(*[F.lit(w) for w in sorted(FILLERS)])
    return F.filter(split_words(F.lower(text)), lambda w: ~F.array_contains(fillers, w) & (F.length(w) > 1))


def clean_query(text: Column) -> Column:
    """The query of its words alone, or the query itself where none is left."""
    words = query_words(text)
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(text)


def query_words_of(query: str) -> list[str]:
    """``query_words`` of one string on the driver."""
    return [w for w in query.lower().split() if w not in FILLERS and len(w) > 1]


def _folds() -> tuple[str, str]:
    """Latin letters with diacritics and their plain letters, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a.islower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()
TOKEN_CHAR = r"[\p{L}\p{M}\p{N}]"
TOKEN = TOKEN_CHAR + "+"


def fts_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters and digits in lower case, Latin diacritics removed."""
    return F.regexp_extract_all(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit(f"({TOKEN})"), F.lit(1))


def fts_tokens_of(text: str) -> list[str]:
    folded = text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return regex.findall(TOKEN, folded)


def snippet_head(text: Column, length: int = 300) -> Column:
    return strip(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, length), F.lit("\n"), F.lit(" ")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.element_at(F.slice(F.split(path, "/"), -2, 1), 1)
