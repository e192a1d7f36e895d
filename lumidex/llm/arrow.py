"""Arrow batches in tasks: lists of numbers laid end to end, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def parts(batch: pa.RecordBatch, column: str, most: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` list elements in ``column`` (or one row with more), each with the
    elements laid end to end and the rows' offsets into them. The list must hold 8-byte integers without nulls."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(row, end - row), values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
