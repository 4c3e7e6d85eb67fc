"""Rows that reach a Python task sorted by a key, in pieces that hold whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes after which a piece is handed on whatever its rows are.
BYTES = 16 << 20


def begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin; keys without nulls."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        x = t.column(k).combine_chunks()
        new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[0, np.flatnonzero(new) + 1]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``least`` rows or more that hold whole groups of ``keys``, with the places where these begin."""
    held, rows, size, wanted, room = [], 0, 0, least, BYTES
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows < wanted and size < room:
            continue
        t = pa.Table.from_batches(held)
        at = begins(t, keys)
        if at[-1]:
            yield t.slice(0, at[-1]), at[:-1]
            t = t.slice(at[-1])
        # a group that goes on is looked at again when it has doubled
        held, rows, size = t.to_batches(), t.num_rows, t.nbytes
        wanted, room = max(least, 2 * rows), max(BYTES, 2 * size)
    if held:
        t = pa.Table.from_batches(held)
        yield t, begins(t, keys)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def ranks(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Dense ranks of values, null before all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.rank(column, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)


def dense(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same where all columns agree."""
    by = np.lexsort(columns)
    new = np.zeros(len(by), bool)
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new)
    return out


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """The columns as places in one list of values, -1 where null, and that list."""
    parts = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    made = pa.concat_arrays(parts).dictionary_encode()
    found = made.indices.fill_null(-1).to_numpy().astype(np.int64)
    return np.split(found, np.cumsum([len(p) for p in parts])[:-1]), made.dictionary
