"""Helpers for work on whole examples as columns of numbers, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands for a null number.
NO_PLACE = np.iinfo(np.int64).min // 4

#: Rows that are worked on together, about; an example is never cut.
TOGETHER = 1 << 17


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the row before it."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return new


def coded(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of a column's texts, null first."""
    codes = column.combine_chunks().dictionary_encode()
    order = np.asarray(pc.array_sort_indices(codes.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.asarray(pc.fill_null(codes.indices, -1))
    return np.where(at < 0, -1, rank[at]) if len(rank) else np.full(len(at), -1)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, … for each pair, `count` of them."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _changes(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    codes = (table[k].combine_chunks().dictionary_encode().indices for k in keys)
    return firsts(*[np.asarray(pc.fill_null(c, -1)) for c in codes])


def whole_examples(batches: Iterator[pa.RecordBatch], together: int = TOGETHER,
                   keys: tuple[str, ...] = ("ex",)) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `keys` as tables of about `together` rows that cut no example, and where an example starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < together:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(_changes(table, keys))
        if starts[-1]:
            whole = table.slice(0, starts[-1])
            yield whole, _changes(whole, keys)
            held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, _changes(table, keys)
