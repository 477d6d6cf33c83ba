"""Arrow batches in parts of bounded size, so that Python's memory follows a part and not a batch of ten thousand rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

ROWS, SIZE = 512, 1 << 20


def cuts(column: pa.Array, rows: int = ROWS, size: int = SIZE) -> list[tuple[int, int]]:
    """Consecutive (start, length) of at most so many rows, and of about ``size`` bytes or list items in all; a larger value is alone."""
    if not len(column):
        return []
    n = pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    upto = np.cumsum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(column):
        before = upto[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        out.append((at, end - at))
        at = end
    return out


def by_parts(fn: Callable[[pa.Array], pa.Array], kind: str):
    """A column function of one column, called with parts of each batch; kind is the result's type."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for at, n in cuts(column):
                yield fn(column.slice(at, n))

    return run


def lists(values: list[np.ndarray | None]) -> pa.ListArray:
    """Arrays of longs, or nulls, as one list column, without an object for each number."""
    ends = np.cumsum([0, *[0 if v is None else len(v) for v in values]]).astype(np.int32)
    none = pa.array([v is None for v in values], pa.bool_())
    flat = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64), pa.int64()), mask=none)


def rows_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's longs, as a view; none for a null row."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return (flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist()))
