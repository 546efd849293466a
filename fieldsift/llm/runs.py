"""Streams sorted Arrow batches as whole groups of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least_rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with at least least_rows rows (the last may have fewer), and where each group begins.

    Batches come sorted by keys (long columns without nulls). What is held is bounded by least_rows, a batch and one group.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows < least_rows:
            continue
        starts = _starts(held, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield held.slice(0, cut).combine_chunks(), starts[:-1]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _starts(held, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)
