"""Trees of an Arrow batch as arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.geodesic import Edges
from ..functions.newick import WORD


def offsets(column: pa.ListArray) -> np.ndarray:
    """First places of the lists in ``column.flatten()``, and the end; a null is an empty list."""
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.concatenate([[0], np.cumsum(size)])


def edges(column: pa.ListArray, taxa: int) -> Edges:
    """Interior edges of trees (lists of split, size, length)."""
    flat = column.flatten()
    masks = flat.field("split").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -(-max(taxa, 1) // WORD))
    return Edges(offsets(column), masks, flat.field("length").to_numpy(zero_copy_only=False))


def leaves(column: pa.ListArray, taxa: int, lacking: float = 0.0) -> np.ndarray:
    """Leaf lengths, a row for each tree; ``lacking`` for a taxon that it lacks."""
    flat, bounds = column.flatten(), offsets(column)
    out = np.full((len(column), taxa), lacking)
    out[np.repeat(np.arange(len(column)), np.diff(bounds)), flat.field("taxon_id").to_numpy(zero_copy_only=False)] = flat.field("length").to_numpy(zero_copy_only=False)
    return out


def lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def structs(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def splits(masks: np.ndarray) -> pa.ListArray:
    """Rows of words as lists."""
    return lists(np.arange(len(masks) + 1) * masks.shape[1], pa.array(masks.ravel()))


def sizes(masks: np.ndarray) -> np.ndarray:
    """Taxa of each mask."""
    return np.bitwise_count(masks).sum(axis=1).astype(np.int32)


def parsed(e: Edges) -> pa.ListArray:
    """Edges as a column ``splits``."""
    return lists(e.bounds, structs(split=splits(e.masks), size=sizes(e.masks), length=e.lengths))


def chunks(work: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts rows into runs of about ``most`` work each, of one row at least."""
    total = np.cumsum(work)
    out, at = [], 0
    while at < len(work):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        out.append((at, end))
        at = end
    return out
