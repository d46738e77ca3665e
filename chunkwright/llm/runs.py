"""Streams of sorted rows, cut where the key changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that split no run of equal keys; the rows must come grouped by the keys.

    A run longer than ``rows`` is given whole, so the keys have to be bounded.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        at = None
        for k in keys:
            col = whole[k].combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            differs = pc.fill_null(pc.not_equal(col[1:], col[:-1]), True)
            at = differs if at is None else pc.or_(at, differs)
        cuts = pc.indices_nonzero(at)
        if not len(cuts):
            continue
        last = cuts[-1].as_py() + 1
        yield whole.slice(0, last)
        held = whole.slice(last).combine_chunks().to_batches()
        n = whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
