"""Whole pages out of the batches of a partition that is sorted by page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(keys: list[pa.Array]) -> np.ndarray:
    """Where a row's key is not the one before."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for k in keys:
        new |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def whole_pages(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole pages, whose keys are the first columns, and where the pages begin."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(held)
        return whole, np.r_[0, changes(whole.columns[:n_keys])]

    for batch in batches:
        if not batch.num_rows:
            continue
        inner = changes(batch.columns[:n_keys])
        last = int(inner[-1]) if len(inner) else 0
        if held and not last:
            ends = pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if not len(changes(ends.columns[:n_keys])):
                held.append(batch)
                continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield joined()
        held = [batch.slice(last)]
    if held:
        yield joined()
