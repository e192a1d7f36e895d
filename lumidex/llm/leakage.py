"""Passages of held-out items inside a corpus.

A passage has leaked into a document when enough of its word positions are covered by sequences of ``width`` or more
words that stand in both. Such pieces may be scattered over the document in any order, so the compared windows have the
size of the smallest piece (``width`` words) and slide over every word of every document and passage.

Each window is embedded by a CGK random walk over its words: 2 * width steps, each emitting the current word and
moving on or not by a random bit of that word, which maps small edit distances to small Hamming distances. Each of
several repetitions samples some of the emitted positions as its key (bit-sampling LSH). Document windows whose key
meets a passage's are verified by the edit distance to the passage's window, up to ``edits``. Equal windows have equal walks and
meet in every repetition; the repetitions bring those that differ slightly to the target recall (``REPETITIONS``, ``SAMPLES``).
Before the walks, a window must share the pairs of neighbouring words with the passages that so few edits leave: each edit takes away two
pairs at most, so that no window within reach is lost.

At last the positions are counted that verified windows cover: those of equal windows alone, and those of all.

Only the items' windows are broadcast, in blocks of at most ``BLOCK`` windows; the corpus is read once a block and never
shuffled. What is left are the texts with enough of an item, a few narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.text import not_blank, plain_words, word_hashes
from lumidex.llm.arrow import parts

BLOCK = 500_000  # item windows broadcast at a time: 36 MB with 8 words each
TABLE_BITS = 22
EDITS, REPETITIONS, SAMPLES = 1, 3, 10  # six samples and eight repetitions find 0.96 of the windows with one edit
PIECE = 500_000  # pairs of windows verified at a time


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def walk_keys(words: np.ndarray, at: np.ndarray, width: int, seed: int, samples: int) -> np.ndarray:
    """LSH keys of the windows words[at : at + width]: a CGK walk and the words met at the sampled steps.

    ``words`` are 64-bit hashes with at least one spare place at the end; a walk that has passed the window's end stays there and emits nothing.
    """
    steps = 2 * width
    rng = np.random.default_rng(seed)
    sampled = set(rng.choice(steps, size=min(samples, steps), replace=False).tolist())
    last = max(sampled)
    coins = _mix(words ^ np.uint64(seed * 2 + 1))  # bit j of a word's coins: whether step j moves past this word
    i = np.zeros(len(at), np.int64)
    key = np.full(len(at), seed + 1, np.uint64)
    for step in range(last + 1):
        here = at + i
        if step in sampled:
            met = np.where(i < width, words[here], np.uint64(0))
            key = _mix(key * np.uint64(31) + met)
        i += ((coins[here] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        np.minimum(i, width, out=i)
    return key


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Edit distances of rows of words, exact up to ``limit`` (beyond it any larger number)."""
    if limit <= 1:  # rows of one length with one edit differ in one place
        return (a != b).sum(axis=1)
    n, w = a.shape
    row = np.tile(np.arange(w + 1), (n, 1))
    for i in range(1, w + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, w + 1):
            swap = row[:, j - 1] + (a[:, i - 1] != b[:, j - 1])
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, swap)
        row = new
    return row[:, w]


def _window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of texts laid end to end, and each one's text."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n), text


class ItemWindows:
    """The windows of a block of items, sorted by their key for each repetition."""

    def __init__(self, item: np.ndarray, pos: np.ndarray, words: np.ndarray, seeds: list[int], samples: int):
        n, self.width = words.shape
        self.item, self.pos, self.words, self.seeds, self.samples = item, pos, words, seeds, samples
        # An item's windows all lie in one block, from its first word to its last.
        self.items, self.place = np.unique(item, return_inverse=True)
        self.sizes = np.bincount(self.place) + self.width - 1
        flat = np.concatenate([words.ravel(), np.zeros(1, np.uint64)])
        self.pairs = np.zeros(1 << TABLE_BITS, bool)
        self.pairs[self._pairs(words[:, :-1], words[:, 1:]).ravel()] = True
        self.sorted = []
        for seed in seeds:
            keys = walk_keys(flat, np.arange(n) * self.width, self.width, seed, samples)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << TABLE_BITS, bool)
            seen[(keys & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            self.sorted.append((keys[order], order, seen))

    @staticmethod
    def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (_mix(left * np.uint64(31) + right) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def within_reach(self, words: np.ndarray, at: np.ndarray, edits: int) -> np.ndarray:
        """Which windows have as many of the items' pairs of neighbouring words as ``edits`` edits leave at least."""
        least = self.width - 1 - 2 * edits
        if least <= 0:
            return np.arange(len(at))
        total = np.concatenate(([0], np.cumsum(self.pairs[self._pairs(words[:-1], words[1:])])))
        return np.flatnonzero(total[at + self.width - 1] - total[at] >= least)

    def candidates(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item window) pairs whose keys meet, repetition by repetition, in pieces of about ``PIECE``."""
        for seed, (keys, order, seen) in zip(self.seeds, self.sorted):
            own = walk_keys(words, at, self.width, seed, self.samples)
            hit = np.flatnonzero(seen[(own & np.uint64(len(seen) - 1)).astype(np.int64)])
            low = np.searchsorted(keys, own[hit], "left")
            n = np.searchsorted(keys, own[hit], "right") - low
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            for s in range(0, total, PIECE):
                pair = np.arange(s, min(s + PIECE, total))
                row = np.searchsorted(ends, pair, "right")
                yield hit[row], order[low[row] + pair - (ends[row] - n[row])]


def _hits(windows: ItemWindows, edits: int, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, item window, edits) columns of the verified pairs of texts laid end to end, in this order and each once."""
    words = np.concatenate([values, np.zeros(1, np.uint64)])
    at, text = _window_starts(offsets, windows.width)
    found = [np.empty((3, 0), np.int64)]
    if len(at):
        near = windows.within_reach(words, at, edits)
        at, text = at[near], text[near]
        for mine, theirs in windows.candidates(words, at):
            paid = edit_distance(words[at[mine][:, None] + np.arange(windows.width)], windows.words[theirs], edits)
            good = paid <= edits
            found.append(np.unique(np.stack([text[mine[good]], theirs[good], paid[good]]), axis=1))
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _matcher(block, edits: int):
    """Rows for each window found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: ItemWindows = block.value
        for batch in batches:
            for part, values, offsets in parts(batch, "words"):
                text, window, paid = _hits(windows, edits, values, offsets)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                columns = [pa.array(ids[text], pa.int64()), pa.array(windows.item[window], pa.int64()), pa.array(windows.pos[window], pa.int32()), pa.array(paid, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "pos", "edits"])

    return run


def covered(text: np.ndarray, item: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, positions covered) by windows, in this order of (text, item, pos); each covers its width, or as far as the next one begins."""
    if not len(text):
        return text, item, pos
    last = np.append((np.diff(text) != 0) | (np.diff(item) != 0), True)
    steps = np.where(last, width, np.minimum(np.append(np.diff(pos), 0), width))
    first = np.flatnonzero(np.concatenate(([True], last[:-1])))
    return text[first], item[first], np.add.reduceat(steps, first)


def _coverer(block, edits: int, least: float):
    """Rows for each text and item of which windows within so many edits cover enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: ItemWindows = block.value
        for batch in batches:
            for part, values, offsets in parts(batch, "words"):
                text, window, paid = _hits(windows, edits, values, offsets)
                item, pos = windows.place[window], windows.pos[window]
                order = np.lexsort((pos, item, text))
                text, item, pos, equal = text[order], item[order], pos[order], paid[order] == 0
                near = covered(text, item, pos, windows.width)
                exact = covered(text[equal], item[equal], pos[equal], windows.width)
                n_items = len(windows.items)
                counts = np.zeros(len(near[0]), np.int64)
                counts[np.searchsorted(near[0] * n_items + near[1], exact[0] * n_items + exact[1])] = exact[2]
                sizes = windows.sizes[near[1]]
                enough = np.flatnonzero(near[2] >= least * sizes)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                columns = [pa.array(ids[near[0][enough]], pa.int64()), pa.array(windows.items[near[1][enough]], pa.int64()), pa.array((counts / sizes)[enough]), pa.array((near[2] / sizes)[enough])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "near_coverage"])

    return run


def _item_blocks(items: DataFrame, width: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item windows in blocks of about ``block``; items come to the driver one at a time, in the order of their ids."""
    ids, positions, rows, n = [], [], [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        words = np.array(row["words"], np.int64).view(np.uint64)
        if len(words) < width:
            continue
        at = np.arange(len(words) - width + 1)
        ids.append(np.full(len(at), row["item_id"]))
        positions.append(at)
        rows.append(words[at[:, None] + np.arange(width)])
        n += len(at)
        if n >= block:
            yield np.concatenate(ids), np.concatenate(positions), np.concatenate(rows)
            ids, positions, rows, n = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(positions), np.concatenate(rows)


def _searched(documents: DataFrame, items: DataFrame, search, shape: str, doc_id: str, doc_text: str, item_id: str, item_text: str, width: int, repetitions: int, samples: int, block: int) -> DataFrame:
    """What ``search`` makes of the documents' words and each block of the items' windows."""
    chosen = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    chosen = chosen.where(F.col("item_id").isNotNull() & not_blank(F.col("text"))).dropDuplicates(["item_id"])
    chosen = chosen.select("item_id", word_hashes(plain_words(F.col("text"))).alias("words"))
    rows = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")).where(F.col("id").isNotNull() & not_blank(F.col("text")))
    rows = rows.select("id", word_hashes(plain_words(F.col("text"))).alias("words")).where(F.size("words") >= width)
    spark = documents.sparkSession
    found = spark.createDataFrame([], shape)
    for n, (ids, positions, words) in enumerate(_item_blocks(chosen, width, block)):
        windows = spark.sparkContext.broadcast(ItemWindows(ids, positions, words, list(range(1, repetitions + 1)), samples))
        part = rows.mapInArrow(search(windows), shape)
        found = part if n == 0 else found.unionByName(part)
    return found


def leaked_windows(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "passage",
    width: int = 8, edits: int = EDITS, repetitions: int = REPETITIONS, samples: int = SAMPLES, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, pos, edits) of the passages' windows that stand in documents with at most so many edits.

    Null ids, null and blank texts take no part; texts of fewer than ``width`` words have no window.
    """
    shape = "doc_id bigint, item_id bigint, pos int, edits int"
    return _searched(documents, items, lambda w: _matcher(w, edits), shape, doc_id, doc_text, item_id, item_text, width, repetitions, samples, block)


def leak_coverage(
    documents: DataFrame, items: DataFrame, *, least: float = 0.5, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "passage",
    width: int = 8, edits: int = EDITS, repetitions: int = REPETITIONS, samples: int = SAMPLES, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id, coverage, near_coverage) where at least the share ``least`` of a passage's word positions is covered by windows of ``width`` words that
    the document has with at most ``edits`` edits (``near_coverage``); ``coverage`` is the share covered by equal ones.

    A position counts once however often the document repeats it; of rows that repeat a document's id the highest shares count; without items or documents there are no rows.
    """
    shape = "doc_id bigint, item_id bigint, coverage double, near_coverage double"
    found = _searched(documents, items, lambda w: _coverer(w, edits, least), shape, doc_id, doc_text, item_id, item_text, width, repetitions, samples, block)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("near_coverage").alias("near_coverage"))


def leaked_items(documents: DataFrame, items: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """(doc_id, item_id, coverage) where at least the share ``least`` of a passage's word positions is covered by sequences of ``width`` or more words
    that the document has just so; otherwise as ``leak_coverage``."""
    return leak_coverage(documents, items, least=least, **options).where(F.col("coverage") >= least).drop("near_coverage")
