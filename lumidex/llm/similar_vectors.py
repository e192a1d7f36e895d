"""The k most similar vectors of every vector, by cells of additive codebooks and two looks at each vector.

Codebooks of full-dimensional words are trained on a bounded sample (``SAMPLE`` vectors): the first by k-means over the unit
vectors, each further one over what the ones before left. The nearest word of the first codebook is a vector's cell, or a path of
two or three words where the sample says that a cell would hold too many rows. In a cell all similarities are exact.

In a large collection the sample holds few vectors of a cluster, or none, so that a cluster's vectors fall into several cells. Therefore there
are two sets of codebooks. In its cell of the first set a vector meets some of its neighbours; the mean of these and itself lies much nearer to
the cluster's centre, and the means of a cluster's vectors mostly fall into one cell of the second set, whose borders are others. There the vector is
searched for and searches again, and also searches up to ``probes - 1`` more cells where its mean lies close to a border (``MARGIN``). The neighbours of
both looks are merged. Rows carry the full vector (in 10 or 16 bits a number where that loses nothing).

Cells that stay large at the full depth are cut into blocks of about ``BLOCK`` rows; the first look stays within a block, in the second each
block of queries meets each block of rows in a group of its own, so that no group holds more than two blocks.
Vectors that the sample holds in three or more copies are set apart: only the ``k + 1`` copies with the smallest ids can be among
anything's k nearest, so only they enter the cells; further copies have the k smallest ids as neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 16_384
WORDS = (4096, 256, 256)  # of each codebook at most
SEEDS = (11, 12)  # of the two sets of codebooks
MARGIN = 0.01  # a second cell is asked where its squared distance is larger than the first one's by less
REACH = 4  # words that are followed from each prefix when cells are sought
CELL = 1000  # rows of a cell on average
HEAVY = 8  # times as many rows before a prefix is cut further
BLOCK = 20_000
NONE = -9_000_000  # similarity, in millionths, of a neighbour that there is not
SENT = "cell bigint, block bigint, id bigint, base boolean, query boolean, vector binary, near binary"


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows of a batch (id, vector) that have an id and ``dim`` finite numbers, not all zero."""
    ids, lists = batch.column(0), batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    right = (np.diff(offsets) == dim) & ~lists.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float32)
    rows = flat[(offsets[:-1][right][:, None] + np.arange(dim))] if right.any() else np.empty((0, dim), np.float32)
    good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
    return ids.to_numpy(zero_copy_only=False)[right][good].astype(np.int64), rows[good] + np.float32(0)  # no negative zeros


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def fingerprints(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each vector's numbers."""
    multipliers = np.random.default_rng(5).integers(1, 2**63, size=x.shape[1], dtype=np.uint64) | np.uint64(1)
    bits = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    h = (bits * multipliers).sum(axis=1, dtype=np.uint64)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def pack(x: np.ndarray) -> pa.Array:
    """Vectors as bytes without loss: as 10-bit multiples of a power of two (its exponent first) where they are such, as vectors given to few digits
    are, else of 16-bit numbers where these are the same, else of 32-bit ones."""
    n, dim = x.shape
    few = 1 + dim + (dim + 3) // 4
    exponents = np.full(n, -1)
    for e in range(6, 13) if few < 2 * dim else ():
        left = np.flatnonzero(exponents < 0)
        with np.errstate(over="ignore", invalid="ignore"):
            y = x[left] * np.float32(1 << e)
            exponents[left[((y == np.rint(y)) & (y >= -512) & (y < 512)).all(axis=1)]] = e
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    short = (exponents < 0) & (half.astype(np.float32) == x).all(axis=1)
    widths = np.where(exponents >= 0, few, np.where(short, 2, 4) * dim)
    ends = np.concatenate(([0], np.cumsum(widths)))
    data = np.empty(int(ends[-1]), np.uint8)
    at = np.flatnonzero(exponents >= 0)
    if len(at):
        y = np.zeros((len(at), (dim + 3) // 4 * 4), np.uint16)
        y[:, :dim] = (x[at] * (1 << exponents[at])[:, None] + 512).astype(np.uint16)
        high = (y >> 8).astype(np.uint8).reshape(len(at), -1, 4)
        high = high[:, :, 0] | high[:, :, 1] << 2 | high[:, :, 2] << 4 | high[:, :, 3] << 6
        data[ends[at][:, None] + np.arange(few)] = np.concatenate([exponents[at][:, None].astype(np.uint8), (y[:, :dim] & 255).astype(np.uint8), high], axis=1)
    for at, kept in ((np.flatnonzero(short), half), (np.flatnonzero((exponents < 0) & ~short), x)):
        if len(at):
            raw = np.ascontiguousarray(kept[at]).view(np.uint8)
            data[ends[at][:, None] + np.arange(raw.shape[1])] = raw
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    out = np.empty((len(column), dim), np.float32)
    few = 1 + dim + (dim + 3) // 4
    for width, kind in ((few if few < 2 * dim else -1, None), (2 * dim, np.float16), (4 * dim, np.float32)):
        at = np.flatnonzero(np.diff(offsets) == width)
        if not len(at):
            continue
        raw = np.ascontiguousarray(data[offsets[at][:, None] + np.arange(width)])
        if kind:
            out[at] = raw.view(kind)
        else:
            high = (raw[:, 1 + dim :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(at), -1)[:, :dim]
            y = (high.astype(np.int16) << 8) + raw[:, 1 : 1 + dim] - 512
            out[at] = y.astype(np.float32) * np.exp2(-raw[:, :1].astype(np.float32))
    return out


def _closest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The nearest word of each vector."""
    half = 0.5 * (words**2).sum(axis=1)
    return np.concatenate([(x[s : s + 2000] @ words.T - half).argmax(axis=1) for s in range(0, len(x), 2000)])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = _closest(x, words)
        order = np.argsort(near, kind="stable")
        held, at = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], at, axis=0)
        words[held] = sums / np.diff(np.append(at, len(x)))[:, None]
    return words


@dataclass
class Codebooks:
    words: np.ndarray  # all codebooks' words, one below the other
    sizes: list[int]
    heavy: list[np.ndarray]  # by depth 1, 2: prefixes that are cut further
    large: dict[int, int]  # cells of more than one block, and their blocks

    def cell(self, codes: np.ndarray) -> np.ndarray:
        """The cell of codes (..., at least 3): their prefix, as long as the prefixes are heavy."""
        one = codes[..., 0]
        two = one * self.sizes[1] + codes[..., 1]
        three = two * self.sizes[2] + codes[..., 2]
        a, b = len(self.heavy[0]), len(self.heavy[1])
        return np.where(~self.heavy[0][one], one, np.where(~self.heavy[1][two], a + two, a + b + three))

    def paths(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """((n, paths, 3) first words of codes by their distance, a vector's own one first; whether it lies close to a border). A word below a prefix that is not heavy is 0.

        The own path descends to the nearest word. The others lie below the nearest ``reach`` first words; where the own
        first word is heavy, each of these is followed to its best ``REACH`` children and all are compared at that depth, so that the
        cells beside a heavy prefix are reached as well as those within it.
        """
        n, first = len(x), self.sizes[0]
        norms = (self.words**2).sum(axis=1)
        errors = norms[:first] - 2 * x @ self.words[:first].T
        reach = min(reach, first)
        one = np.argpartition(errors, reach - 1, axis=1)[:, :reach]
        one = np.take_along_axis(one, np.take_along_axis(errors, one, 1).argsort(axis=1, kind="stable"), 1)
        best = np.take_along_axis(errors, one[:, :2], 1)
        close = self.heavy[0][one[:, 0]] | (best[:, -1] - best[:, 0] < MARGIN)
        if not self.heavy[0].any():
            return np.stack([one, np.zeros_like(one), np.zeros_like(one)], axis=2), close
        second, third = self.sizes[1], self.sizes[2]
        keep = min(REACH, second)
        own = slice(first, first + second)
        below = (norms[own] - 2 * x @ self.words[own].T)[:, None, :] + (2 * self.words[:first] @ self.words[own].T)[one]
        two = np.argpartition(below, keep - 1, axis=2)[:, :, :keep]
        two = np.take_along_axis(two, np.take_along_axis(below, two, 2).argsort(axis=2, kind="stable"), 2)
        single = np.take_along_axis(errors, one, 1)[:, :, None]
        whole = np.where(self.heavy[0][one[:, :1]][:, :, None], single + np.take_along_axis(below, two, 2), single).reshape(n, -1)
        whole[:, 0] = -np.inf  # the nearest word and its nearest child
        one, two = np.repeat(one, keep, axis=1), two.reshape(n, -1)
        order = whole.argsort(axis=1, kind="stable")
        one, two = np.take_along_axis(one, order, 1), np.take_along_axis(two, order, 1)
        two = np.where(self.heavy[0][one], two, 0)
        three = np.zeros_like(two)
        row, path = np.nonzero(self.heavy[0][one] & self.heavy[1][one * second + two])
        last = slice(first + second, first + second + third)
        for s in range(0, len(row), 20_000):
            r, p = row[s : s + 20_000], path[s : s + 20_000]
            left = x[r] - self.words[one[r, p]] - self.words[first + two[r, p]]
            three[r, p] = (norms[last] - 2 * left @ self.words[last].T).argmin(axis=1)
        return np.stack([one, two, three], axis=2), close

    def probed(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(n, probes) cells, a vector's own one first, then, where it lies close to a border, others by their distance; -1 where there are no more."""
        paths, close = self.paths(x, max(REACH, probes))
        cells = self.cell(paths)
        out = np.full((len(x), probes), -1, np.int64)
        out[:, 0] = cells[:, 0]
        filled = np.ones(len(x), np.int64)
        for c in cells.T[1:]:
            new = close & (filled < probes) & ~(out == c[:, None]).any(axis=1)
            out[np.flatnonzero(new), filled[new]] = c[new]
            filled += new
        return out


def train(sample: np.ndarray, n: int, cell_rows: int = CELL, rounds: int = 5, seed: int = SEEDS[0]) -> Codebooks:
    """Codebooks from unit vectors of a sample of a collection of n; which prefixes are heavy is carried over from the sample's shares."""
    rng = np.random.default_rng(seed)
    left, words, sizes = np.unique(sample, axis=0), [], []
    for m, most in enumerate(WORDS):
        # A heavy cell is cut into few parts, so that they don't become much smaller than other cells.
        k = max(1, min(most, len(left) // 4, ceil(n / cell_rows) if m == 0 else max(16, 4 * ceil(n / cell_rows / sizes[0]))))
        book = _kmeans(left, k, rounds if m else 2 * rounds, rng)
        words.append(book)
        sizes.append(k)
        left = left - book[_closest(left, book)]
    books = Codebooks(np.concatenate(words), sizes, [np.zeros(sizes[0], bool), np.zeros(sizes[0] * sizes[1], bool)], {})
    scale, least = n / len(sample), HEAVY * cell_rows
    own = lambda: np.concatenate([books.paths(sample[s : s + 2000], 1)[0][:, 0] for s in range(0, len(sample), 2000)])
    books.heavy[0] = np.bincount(own()[:, 0], minlength=sizes[0]) * scale > least
    path = own()
    if books.heavy[0].any():
        path = path[books.heavy[0][path[:, 0]]]
        books.heavy[1] = np.bincount(path[:, 0] * sizes[1] + path[:, 1], minlength=sizes[0] * sizes[1]) * scale > least
        path = own()
    cells, counts = np.unique(books.cell(path), return_counts=True)
    books.large = {int(c): ceil(s * scale / BLOCK) for c, s in zip(cells, counts) if s > 2 and s * scale > BLOCK}
    return books


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers of one width as bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(rows) * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _sent(cell: np.ndarray, block: np.ndarray, ids: np.ndarray, base: bool, query: bool, vectors: pa.Array, near: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(cell.astype(np.int64)), pa.array(block.astype(np.int64)), pa.array(ids), pa.array(np.full(n, base)), pa.array(np.full(n, query)), vectors, near]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "block", "id", "base", "query", "vector", "near"])


def _first_look(ids: np.ndarray, x: np.ndarray, books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks of the cells that vectors belong to."""
    if len(ids):
        cell = books.cell(books.paths(unit(x), 1)[0])[:, 0]
        blocks = np.array([books.large.get(c, 1) for c in cell.tolist()], np.int64)
        yield _sent(cell, ids % blocks, ids, True, True, pack(x), pa.nulls(len(ids), pa.binary()))


def _second_look(ids: np.ndarray, cells: np.ndarray, vectors: pa.Array, near: pa.Array, books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Rows for the cells that vectors belong to and search in. In a cell of B blocks a vector of block i is a row of the groups
    (every query block, i) and a query of the groups (i, every block). What was found before goes with one of the rows."""
    for p in range(cells.shape[1]):
        at = np.flatnonzero(cells[:, p] >= 0)
        cell = cells[at, p]
        blocks = np.array([books.large.get(c, 1) for c in cell.tolist()], np.int64)
        mine = ids[at] % blocks
        for other in range(int(blocks.max(initial=0))):
            inside = blocks > other
            # As a query to block ``other``, and (in the own cell) as a row for the queries of block ``other``; both at once where they are one group.
            for query, base, there in ((True, p == 0, inside & (mine == other)), (True, False, inside & (mine != other)), (False, True, inside & (mine != other) & (p == 0))):
                j = np.flatnonzero(there)
                if len(j):
                    group = mine[j] * blocks[j] + other if query else other * blocks[j] + mine[j]
                    take = pa.array(at[j])
                    yield _sent(cell[j], group, ids[at[j]], base, query, vectors.take(take), near.take(take) if base and query else pa.nulls(len(j), pa.binary()))


def _nearest(queries: np.ndarray, own: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities in millionths, rows of the base), each (n, k), best first and equal ones by the smaller id, of each query's neighbours among vectors
    with ascending ids; similarity NONE where there are fewer. The products of single precision only choose whom double precision compares."""
    n, m = len(queries), len(ids)
    sims = queries @ base.T
    at = np.minimum(np.searchsorted(ids, own), m - 1)
    self_at = np.flatnonzero(ids[at] == own)
    sims[self_at, at[self_at]] = -9
    wide = queries.astype(np.float64)

    def ranked(rows: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = np.rint(np.einsum("qkd,qd->qk", base[top].astype(np.float64), wide[rows]) * 1e6).astype(np.int64)
        exact[ids[top] == own[rows][:, None]] = NONE
        order = np.lexsort((top, -exact), axis=1)[:, :k]
        return np.take_along_axis(exact, order, 1), np.take_along_axis(top, order, 1)

    keep = min(k + 6, m)
    top = np.argpartition(sims, m - keep, axis=1)[:, m - keep :]
    floor = np.take_along_axis(sims, top, 1).min(axis=1)
    exact, top = ranked(np.arange(n), top)
    if keep < m:  # more candidates where others may be as similar as the last one
        for r in np.flatnonzero((floor + 2e-6) * 1e6 >= exact[:, -1]):
            exact[r : r + 1], top[r : r + 1] = ranked(np.array([r]), np.flatnonzero(sims[r] >= exact[r, -1] / 1e6 - 2e-6)[None, :])
    short = ((0, 0), (0, k - exact.shape[1]))
    return np.pad(exact, short, constant_values=NONE), np.pad(top, short)


def _unpacked(group: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(ids, unit vectors, which are rows of the cell, which are queries, the row of what was found before or -1, the group). One row an id, which is a row of the cell or a query if any of its rows is."""
    group = group.combine_chunks()
    column = lambda name: group.column(name).to_numpy() if group.num_rows else np.empty(0, np.int64)
    ids, first, where = np.unique(column("id"), return_index=True, return_inverse=True)
    held, asked = (np.flatnonzero(np.bincount(where, weights=column(flag), minlength=len(ids))) for flag in ("base", "query"))
    before = np.full(len(ids), -1)
    has = np.flatnonzero(group.column("near").is_valid().to_numpy())
    before[where[has]] = has
    x = unit(unpack(group.column("vector").chunk(0).take(pa.array(first)), dim)) if len(ids) else np.empty((0, dim), np.float32)
    return ids, x, held, asked, before, group.take(pa.array(first)) if len(ids) else group


def _slices(asked: np.ndarray, held: int) -> Iterator[np.ndarray]:
    step = max(1, min(256, 4_000_000 // max(held, 1)))
    return (asked[s : s + step] for s in range(0, len(asked), step))


NEAR = np.dtype([("neighbour", "<i8"), ("similarity", "<i4")])


def _looked_at(second, dim: int, k: int, probes: int):
    """The first look: of each row of a block what it found there, and the cells of the second set that its mean belongs to and searches in."""

    def run(group: pa.Table) -> pa.Table:
        ids, x, held, _, _, rows = _unpacked(group, dim)
        out = []
        vectors = rows.column("vector").chunk(0) if len(ids) else None
        for at in _slices(held, len(held)):
            sims, top = _nearest(x[at], ids[at], x, ids, k)
            near = np.empty(sims.shape, NEAR)
            near["neighbour"], near["similarity"] = np.where(sims > NONE, ids[top], -1), sims
            # Neighbours far below the best one belong to another cluster.
            alike = (sims > 0) & (sims >= 0.8 * sims[:, :1])
            mean = unit(x[at] + np.einsum("qk,qkd->qd", alike.astype(np.float32), x[top]))
            out += _second_look(ids[at], second.value.probed(mean, probes), vectors.take(pa.array(at)), _binary(near), second.value)
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_sent(ids, ids, ids, True, True, pa.nulls(0, pa.binary()), pa.nulls(0, pa.binary()))])

    return run


def _searched(dim: int, k: int):
    """The second look: of each query in a cell its neighbours there, merged with those of the first look."""

    def run(group: pa.Table) -> pa.Table:
        kept = group.column("near").combine_chunks()
        ids, x, held, asked, before, _ = _unpacked(group, dim)
        all_sims, all_found = [np.empty((0, k), np.int64)], [np.empty((0, k), np.int64)]
        base, base_ids = x[held], ids[held]
        for at in _slices(asked, len(held)):
            sims, found = np.full((len(at), 2 * k), NONE), np.full((len(at), 2 * k), -1)
            if len(held):
                sims[:, :k], top = _nearest(x[at], ids[at], base, base_ids, k)
                found[:, :k] = base_ids[top]
            has = np.flatnonzero(before[at] >= 0)
            if len(has):
                old = np.frombuffer(b"".join(kept.take(pa.array(before[at][has])).to_pylist()), NEAR).reshape(len(has), k)
                sims[has, k:], found[has, k:] = old["similarity"], old["neighbour"]
            order = np.lexsort((found, -sims), axis=1)
            sims, found = np.take_along_axis(sims, order, 1), np.take_along_axis(found, order, 1)
            again = (found[:, 1:] == found[:, :-1]) & (sims[:, 1:] > NONE)
            sims[:, 1:][again] = NONE
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            all_sims.append(np.take_along_axis(sims, order, 1))
            all_found.append(np.take_along_axis(found, order, 1))
        sims, found = np.concatenate(all_sims), np.concatenate(all_found)
        real = sims > NONE
        ends = np.concatenate(([0], np.cumsum(real.sum(axis=1)))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(-sims[real] / 1e6), pa.array(found[real])], names=["distance", "neighbour"])
        return pa.Table.from_arrays([pa.array(ids[asked]), pa.ListArray.from_arrays(ends, pairs)], names=["id", "near"])

    return run


def _sampled(rows: DataFrame, dim: int, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, vectors, share) of about ``size`` usable vectors, drawn by a hash of the id; of all of them where there are fewer. Where most rows are
    unusable the share grows eightfold until an eighth of the size is reached, so that no more than about ``size`` vectors ever come to the driver."""
    whole = 1 << 30

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable(batch, dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pack(x)], names=["id", "vector"])

    share = min(whole, ceil(whole * size / max(rows.count(), 1)))
    while True:
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(whole)) < share).mapInArrow(cleaned, "id bigint, vector binary").toArrow().combine_chunks()
        if share == whole or drawn.num_rows * 8 >= size:
            break
        share = min(whole, share * 8)
    if not drawn.num_rows:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32), 1.0
    return drawn.column("id").chunk(0).to_numpy(), unpack(drawn.column("vector").chunk(0), dim), share / whole


def similar_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, *, k: int = 10, dim: int = 384, probes: int = 2, sample: int = SAMPLE, cell_rows: int = CELL
) -> DataFrame:
    """(id, neighbour, similarity, rank) of the k vectors most similar to each by cosine; equal ones by the smaller id.

    Rows without an id and vectors that are null, not ``dim`` long, all zero or hold a null, NaN or infinity take no part; rows that repeat an id
    count once; a collection of one vector has no neighbours and an empty one no rows. Similarities are rounded to six digits.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    own, raw, share = _sampled(rows, dim, sample)
    if not len(raw):
        return spark.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    hashes = fingerprints(raw)
    distinct = np.unique(np.stack([hashes, own]), axis=1)
    values, copies = np.unique(distinct[0], return_counts=True)
    hot = values[copies >= 3]
    first_set, second_set = (spark.sparkContext.broadcast(train(unit(raw), ceil(len(raw) / share), cell_rows, seed=seed)) for seed in SEEDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                ids, x = usable(batch.slice(s, 2000), dim)
                cold = ~np.isin(fingerprints(x), hot)
                yield from _first_look(ids[cold], x[cold], first_set.value)

    encoded = rows.mapInArrow(encode, SENT)
    rest = None
    if len(hot):

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = usable(batch, dim)
                h = fingerprints(x)
                at = np.isin(h, hot)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(ids[at])], names=["hash", "id"])

        at = np.unique(hashes, return_index=True)[1]
        held = {int(hashes[i]): raw[i] for i in at[copies >= 3]}

        def encode_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.stack([held[h] for h in batch.column(0).to_pylist()])
                    yield from _first_look(batch.column(1).to_numpy(), x, first_set.value)

        # Copies are ranked within 64 shares of their class first, so that no task sorts a whole class.
        marked = rows.mapInArrow(marks, "hash bigint, id bigint").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        part = marked.withColumn("r", F.row_number().over(Window.partitionBy("hash", "salt").orderBy("id"))).where(f"r <= {k + 1}")
        first = part.withColumn("r", F.row_number().over(Window.partitionBy("hash").orderBy("id"))).where(f"r <= {k + 1}").select("hash", "id")
        encoded = encoded.unionByName(first.mapInArrow(encode_hot, SENT))
        lists = first.groupBy("hash").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"), F.max("id").alias("last"))
        rest = marked.join(F.broadcast(lists), "hash").where((F.col("id") > F.col("last"))).select("id", F.posexplode("ids").alias("rank", "neighbour"))
        rest = rest.select("id", "neighbour", F.lit(1.0).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))
    looked = encoded.groupBy("cell", "block").applyInArrow(_looked_at(second_set, dim, k, probes), SENT)
    near = looked.groupBy("cell", "block").applyInArrow(_searched(dim, k), "id bigint, near array<struct<distance: double, neighbour: bigint>>")
    merged = near.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    out = merged.select("id", F.posexplode("near").alias("p", "x")).select(
        "id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.distance")).alias("similarity"), (F.col("p") + 1).cast("int").alias("rank")
    )
    return out if rest is None else out.unionByName(rest)


def similar_vector_pairs(vectors: DataFrame, id_col: str, vector_col: str, **options) -> DataFrame:
    """(a, b), a < b: pairs of which one is among the other's most similar vectors."""
    found = similar_vectors(vectors, id_col, vector_col, **options)
    return found.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
