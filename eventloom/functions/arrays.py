"""Arrow lists of numbers as NumPy arrays and back, by their offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def arrays(column: pa.Array) -> list[np.ndarray | None]:
    """Each list as an array of doubles; a null list is None, a null element not a number."""
    if not len(column):
        return []
    offsets = column.offsets.to_numpy()
    values = pc.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False)
    parts = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    if column.null_count:
        return [p if ok else None for p, ok in zip(parts, column.is_valid().to_pylist())]
    return parts


def known(values: np.ndarray | None) -> np.ndarray:
    """The values that are numbers; none for None."""
    return np.zeros(0) if values is None else values[~np.isnan(values)]


def lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """Arrays as a column of lists; None as a null list."""
    sizes = [0 if r is None else len(r) for r in rows]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    some = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(some) if some else np.zeros(0)).cast(kind)
    gone = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(ends, values, mask=gone) if rows else pa.array([], pa.list_(kind))


#: Rows up to this size share a group however they differ.
SHORT = 64


def alike(sizes: list[int], cells: int) -> list[np.ndarray]:
    """Places of rows of like size in groups, the longest first.

    A group padded to its longest row holds at most `cells` values (or one row), and no row
    under half of that one's size, so padding at most doubles what there is.
    """
    order = np.argsort([-n for n in sizes], kind="stable")
    down = -np.asarray(sizes, np.int64)[order] if len(order) else np.zeros(0, np.int64)
    out, k = [], 0
    while k < len(order):
        longest = -int(down[k])
        end = k + max(1, cells // max(longest, 1))
        if longest > SHORT:
            end = min(end, int(np.searchsorted(down, -(longest // 2), side="right")))
        out.append(order[k:end])
        k = end
    return out
