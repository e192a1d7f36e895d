"""Filling inputs of a fixed number of tokens with documents of varying length.

Sizes are counted by a public tokenizer in the tasks that read the texts; only ids and sizes are shuffled. Documents above the
capacity are cut into full inputs and a rest. What is left is packed in blocks of about ``BLOCK`` documents, chosen by a
hash of the id, so that no task ever holds more than a block and all blocks are packed at once; a block wastes at most a
few inputs. In a block: best-two-fit. A bin takes the largest documents that fit until none does; then its smallest one
is given back for the two unpacked documents that fill the larger gap most tightly, as long as that leaves less room.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.functions.text import not_blank

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The word pattern that goes with the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 512
BLOCK = 5000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file of base64 tokens and ranks, one a line; once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens) of the rows with an id and a text that is not blank."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & not_blank(F.col("text")))
    return rows.mapInArrow(count, "id bigint, tokens bigint")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (sizes between 1 and capacity). Ties go to the item that comes first."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        stacks[sizes[i]].append(i)
    there = 0  # bit s: an item of size s is left
    for s in range(1, capacity + 1):
        if stacks[s]:
            there |= 1 << s

    def largest(most: int) -> int:
        """The largest size left up to ``most``, or -1."""
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(s: int) -> int:
        nonlocal there
        item = stacks[s].pop()
        if not stacks[s]:
            there &= ~(1 << s)
        return item

    def best_pair(most: int, above: int) -> tuple[int, int] | None:
        best, pair = above, None
        a = largest(most - 1)
        while a > 0 and 2 * a > best:
            b = largest(min(most - a, a))
            if b == a and len(stacks[a]) < 2:
                b = largest(a - 1)
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == most:
                    break
            a = largest(a - 1)
        return pair

    bins, n = np.empty(len(sizes), np.int64), 0
    while there:
        held, gap = [], capacity
        while (s := largest(gap)) > 0:
            held.append((s, take(s)))
            gap -= s
        while gap and (pair := best_pair(gap + held[-1][0], held[-1][0])):
            s, item = held.pop()
            for x in pair:
                held.append((x, take(x)))
            stacks[s].append(item)
            there |= 1 << s
            gap += s - sum(pair)
            held.sort(key=lambda x: -x[0])
        for _, item in held:
            bins[item] = n
        n += 1
    return bins


def pack_documents(
    documents: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK
) -> DataFrame:
    """(id, piece, token_start, n_tokens, bin): every document, or every piece of one above the capacity, in one bin.

    Null ids, null and blank texts take no room and give no row; an id that comes again counts once, with its largest size; an empty table gives
    no rows. The sum of n_tokens of a bin never exceeds the capacity; bins are numbered without gaps only within a block.
    """
    blocks = max(1, ceil(documents.count() / block))
    sized = token_counts(documents, id_col, text_col, vocabulary).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    shape = "id bigint, piece int, token_start bigint, n_tokens int, bin bigint"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tokens"]).drop_duplicates("id", keep="last")
        full = (rows.tokens // capacity).to_numpy()
        pieces = full + (rows.tokens % capacity > 0).to_numpy()
        at = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(rows.tokens.to_numpy()[at] - piece * capacity, capacity)
        bins = best_two_fit(size, capacity) + (int(rows.block.iloc[0]) << 40)
        return pd.DataFrame({"id": rows.id.to_numpy()[at], "piece": piece.astype(np.int32), "token_start": piece * capacity, "n_tokens": size.astype(np.int32), "bin": bins})

    return sized.groupBy("block").applyInPandas(pack, shape)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, tokens, the least number of bins that could hold them, and the share of room used."""
    return packed.agg(F.countDistinct("bin").alias("bins"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).select(
        "bins", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * capacity), 6).alias("used")
    )
