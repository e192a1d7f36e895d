"""Texts garbled by a wrong character encoding, found and restored.

Texts that hold nothing beyond ASCII and no escape never leave the JVM. In the others, passages of implausible words are
sought, and for each the cheapest text that can be reached by encoding, decoding and unescaping: a best-first search over
texts and byte strings, each visited once (by hash), led by a cost of characters and neighbours that is low for the words of any
one script and high for controls, symbols within words, mixed scripts, unusual letters and capitals after small letters. A passage is
garbled if the cheapest text costs much less than it does, or if it holds replacement characters, which cannot be undone.
"""

from __future__ import annotations

import heapq
import html
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Encodings under which bytes may have been read, and those in which they may have been written.
READ_AS = "latin-1 cp1252 cp1250 cp1251 cp437 cp850 mac_roman cp866 koi8-r cp1254 cp1253 iso8859-2 iso8859-15 cp852 gbk shift_jis".split()
WRITTEN_IN = "utf-8 cp1252 cp1251 cp1250 cp1254 koi8-r cp866 cp850 cp437 gbk euc_jp shift_jis cp1253 cp1256 cp874 iso8859-2 iso8859-5 cp852 big5 euc_kr mac_roman".split()
MULTIBYTE = {"utf-8", "gbk", "shift_jis", "euc_jp", "big5", "euc_kr"}
LONGEST = 4000  # characters of a passage searched at a time
MOST_STATES = 600  # of one search

# Letters beyond ASCII of French, German, Spanish, Portuguese, Italian, Polish and Turkish.
USUAL = set("àâæçéèêëîïôœùûüäößáíóúñãõìòąćęłńśźżğış")
SELDOM = set("æœÿëòìùûîôö")  # of these, letters that take part in fewer words than others
PRINTED = set("–—‘’‚“”„…«»¿¡°ºª№•§€‐‑·")
COST = {"a": 0.0, "e": 0.4, "E": 0.6, "r": 2.0, "R": 2.2, "c": 0.3, "C": 0.4, "y": 1.2, "g": 0.3, "G": 0.4, "b": 0.4, "d": 0.4, "t": 0.4, "k": 0.4, "h": 0.3, "H": 1.0, "p": 0.5, "s": 1.3, "B": 2.0, "X": 2.0, "u": 3.0, "f": 3.0, "n": 1.0, "w": 1.2, " ": 0.0, ".": 0.0}
LATIN, OTHER = "aeErR", "cCygGbdtkhH"
FAMILY = {**dict.fromkeys("aeErR", "L"), **dict.fromkeys("cCy", "C"), **dict.fromkeys("gG", "G"), "b": "A", "d": "D", "t": "T", "k": "K", "h": "H", "H": "H"}


def _usual_han(ch: str) -> bool:
    """Among the first-level characters of the Chinese or Japanese standard."""
    for name, low, high in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97)):
        try:
            if low <= ch.encode(name)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


#: Marks that stand between words, here within one.
WITHIN = re.compile(r"(?<=[A-Za-zÀ-ÿ])[‚„…“”«»¿¡•§€º](?=[A-Za-zÀ-ÿ])")
#: An accented capital behind a small letter.
CAPITAL = re.compile("[a-z][À-ÖØ-Þ]")
#: A symbol within a word.
SYMBOL = re.compile(r"[^\W\d_][^\w\s\x00-\x7f‐‑’‘·\xad][^\W\d_]")
#: Blanks between characters of scripts that are written without.
APART = re.compile(r"(?<=[\u3400-\u9fff]) (?=[\u3400-\u9fff])")


ESCAPE = re.compile(r"&#?\w{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")


@lru_cache(maxsize=None)
def kind(ch: str) -> str:
    """The class of a character."""
    o = ord(ch)
    if o < 0x80:
        return "a" if ch.isalpha() else " " if ch.isspace() else "." if o >= 0x20 else "u"
    if o < 0xA0:
        return "u"
    if ch in "\xa0\xad":
        return "n"
    if ch == "�":
        return "f"
    if 0xFB00 <= o <= 0xFB06:
        return "a"
    if ch in PRINTED or 0x3000 <= o <= 0x303F or ch in "！（），．：；？" or o in (0x060C, 0x061B, 0x061F, 0x0964, 0x0965, 0x30FB):
        return "p"
    if 0x0400 <= o <= 0x04FF:
        return ("C" if ch.isupper() else "c") if ch in "ёЁ" or 0x0410 <= o <= 0x044F else "y"
    if 0x0370 <= o <= 0x03FF or 0x1F00 <= o <= 0x1FFF:
        return "G" if ch.isupper() else "g"
    for low, high, name in ((0x0600, 0x06FF, "b"), (0x0900, 0x097F, "d"), (0x0E00, 0x0E7F, "t"), (0xAC00, 0xD7A3, "k"), (0x3040, 0x30FF, "h"), (0xFF00, 0xFFEF, "w")):
        if low <= o <= high:
            return name
    if 0x3400 <= o <= 0x9FFF:
        return "h" if _usual_han(ch) else "H"
    if ch.isalpha() and o < 0x250:
        if ch.lower() in USUAL or ch == "İ":
            return "e" if ch.islower() else "E"
        return "r" if ch.islower() else "R"
    if 0xE000 <= o <= 0xF8FF:
        return "u"
    return "X" if 0x2500 <= o <= 0x259F else "B" if o > 0x2100 else "s"


@lru_cache(maxsize=None)
def _together(a: str, b: str) -> float:
    """The cost of two classes side by side, beyond their own."""
    fa, fb = FAMILY.get(a), FAMILY.get(b)
    if fa and fb and fa != fb:
        return 1.5 if "H" in (fa, fb) or "L" not in (fa, fb) else 1.0
    if fa and fb:
        extra = 0.0
        if a in "eErR" and b in "eErR":
            extra += 0.3 if a in "eE" and b in "eE" else 0.8
        if (a, b) in (("C", "C"), ("G", "G")):
            extra += 0.3
        if (a, b) in (("c", "C"), ("g", "G")) or (a in "er" and b in "ER"):
            extra += 1.2
        return extra
    if (a in "sBXu" and fb) or (b in "sBXu" and fa) or (a in "sBX" and b in "sBX"):
        return 0.8
    return 0.0


@lru_cache(maxsize=200_000)
def cost(text: str) -> float:
    """How implausible a text is; nothing for ASCII but escapes."""
    total, before, last = 0.0, " ", ""
    for ch in text:
        k = kind(ch)
        total += COST[k] + _together(before, k)
        if ch in SELDOM:
            total += 0.3
        if last.islower() and ch.isupper() and (k in "ER" if before == "a" else k == "a"):
            total += 0.6
        before, last = k, ch
    return total + 1.5 * len(WITHIN.findall(text)) + 1.5 * len(APART.findall(text)) + 2.0 * len(ESCAPE.findall(text))


def _tables(name: str) -> dict[int, int] | None:
    """For an encoding of one byte a character, the byte of each; bytes without a character stand for themselves."""
    if name in MULTIBYTE:
        return None
    table = {}
    for b in range(255, -1, -1):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    return table


TO_BYTES = {name: _tables(name) for name in READ_AS}
FROM_BYTES = {name: "".join(chr(c) for c in sorted(t, key=t.get)) if (t := _tables(name)) and len(t) == 256 else None for name in WRITTEN_IN}


def encode(text: str, name: str) -> bytes | None:
    table = TO_BYTES[name]
    try:
        if table is None:
            return text.encode(name)
        return bytes([table[ord(c)] for c in text])
    except (KeyError, UnicodeEncodeError):
        return None


def decode(data: bytes, name: str) -> str | None:
    """Strictly, but for characters of East Asian encodings that were cut at a passage's ends or lost a byte."""
    try:
        return data.decode(name)
    except UnicodeDecodeError:
        if name not in MULTIBYTE or name == "utf-8" or len(data) < 20:
            return None
        text = data.decode(name, "replace")
        return text if text.count("\ufffd") <= len(text) // 40 + 1 else None


def unescape(text: str) -> str:
    out = html.unescape(text) if "&" in text else text
    if "\\" in out:
        out = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), out)
    return out


def cheapest(text: str) -> tuple[tuple[str, float], tuple[str, float]]:
    """The cheapest text within reach and its cost; the same of those reached by UTF-8 alone, which chance hardly allows."""
    start = cost(text)
    best = certain_best = (text, start)
    visited = {hash(text)}
    order = itertools.count()
    queue: list[tuple[float, int, int, str | bytes, bool]] = [(start, 0, next(order), text, True)]
    while queue and len(visited) < MOST_STATES:
        price, depth, _, state, sure = heapq.heappop(queue)
        if isinstance(state, bytes):
            for name in WRITTEN_IN:
                new = decode(state, name)
                if new is None or hash(new) in visited:
                    continue
                visited.add(hash(new))
                paid = cost(new) + 0.2 * (name != "utf-8") + 0.3 * (depth // 2)
                certain = sure and name == "utf-8"
                if paid < best[1] - 1e-9:
                    best = (new, paid)
                if certain and paid < certain_best[1] - 1e-9:
                    certain_best = (new, paid)
                if depth < 5 and paid < price + 1:
                    heapq.heappush(queue, (paid, depth + 1, next(order), new, certain))
                if name == "utf-8" and paid < price:
                    break
            continue
        if depth and price <= 0.45 * sum(c > "\x7f" for c in state):
            break
        new = unescape(state)
        if hash(new) not in visited:
            visited.add(hash(new))
            paid = cost(new)
            if paid <= best[1]:
                best = (new, paid)
            if sure and paid <= certain_best[1]:
                certain_best = (new, paid - 0.8)
            heapq.heappush(queue, (paid, depth + 1, next(order), new, sure))
        for name in READ_AS:
            data = encode(state, name)
            if data is not None and ~hash(data) not in visited:  # texts and bytes alike in memory have one hash
                visited.add(~hash(data))
                heapq.heappush(queue, (price, depth + 1, next(order), data, sure))
    return best, certain_best


CONTROLS = re.compile("[\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=100_000)
def repaired(passage: str) -> str | None:
    """The text that a passage was, if it is garbled and can be restored."""
    before = cost(passage)
    (new, after), (certain, paid) = cheapest(passage)
    if certain != passage and before - paid >= max(0.75, 0.3 * before):
        return certain
    # What no text has: controls, and accented capitals behind small letters.
    freed = any(rx.search(passage) and not rx.search(new) for rx in (CONTROLS, CAPITAL))
    within = bool(SYMBOL.search(passage)) and not SYMBOL.search(new)
    least = max(0.75, 0.35 * before) if freed else max(2.0 if within else 3.0, 0.5 * before)
    return new if new != passage and before - after >= least else None


@lru_cache(maxsize=100_000)
def repaired_word(word: str) -> str | None:
    """The same for one word, by UTF-8 alone."""
    before, (_, (certain, paid)) = cost(word), cheapest(word)
    return certain if certain != word and before - paid >= max(0.75, 0.3 * before) else None


BEYOND = re.compile(r"[^\x00-\x7f]")
ODD = re.compile("[rRsBXufnywH]")


@lru_cache(maxsize=200_000)
def odd(token: str) -> bool:
    """Whether a word has anything that no plain text has; only then is a search worth while. Marks of
    hyphenation at its end and words of symbols alone are nothing."""
    kinds = "".join(map(kind, re.sub(r"(?<=[^\W\d_Ã├])[¬\xad]$", "", token)))
    if not re.search("[^sB.n ]", kinds):
        return False
    if ODD.search(kinds) or WITHIN.search(token) or CAPITAL.search(token):
        return True
    return any(_together(a, b) > 0.5 for a, b in zip(kinds, kinds[1:])) or bool(ESCAPE.search(token))


def restore(text: str) -> tuple[str, int]:
    """(the text with its garbled passages restored, how many passages are garbled)."""
    tokens = re.split(r"([ \t\r\n]+)", text)
    marks = [i for i in range(0, len(tokens), 2) if tokens[i] and (BEYOND.search(tokens[i]) or "&" in tokens[i] or "\\" in tokens[i]) and odd(tokens[i])]
    found = 0
    left = []
    for i in marks:  # words that UTF-8 explains, whatever stands around them
        one = repaired_word(tokens[i])
        if one is None or odd(one):
            left.append(i)
        if one is not None:
            tokens[i] = one
            found += 1
    if found:  # beside garbled words, short ones that would pass for plain text are tried too
        for i in set(range(0, len(tokens), 2)) - set(marks):
            if BEYOND.search(tokens[i]) and (one := repaired_word(tokens[i])) is not None:
                tokens[i] = one
    at = 0
    while at < len(left):
        # A passage: odd words with at most eight others between them.
        end = at
        while end + 1 < len(left) and left[end + 1] - left[end] <= 16 and left[end + 1] - left[at] < LONGEST // 4:
            end += 1
        first, last = left[at], left[end]
        new = repaired("".join(tokens[first : last + 1]))
        if new is not None:
            tokens[first : last + 1] = [new] + [""] * (last - first)
            found += 1
        else:
            for i in left[at : end + 1]:
                one = repaired(tokens[i]) if end > at else None
                if one is not None:
                    tokens[i] = one
                    found += 1
                elif "�" in tokens[i] or CONTROLS.search(tokens[i]):
                    found += 1
        at = end + 1
    return "".join(tokens), found


def restore_texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, passages) of the texts with at least one garbled passage.

    Replacement and control characters that cannot be undone stay as they are, their passages count. Null texts are never garbled; repeated rows come out once; an empty table gives no
    rows; other columns are not read.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"[^\x00-\x7f]|&#?\w{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [restore(t) for t in batch.column(1).to_pylist()]
            keep = pa.array([n > 0 for _, n in done], pa.bool_())
            out = [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], names=["id", "restored", "passages"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, restored string, passages int").distinct()
