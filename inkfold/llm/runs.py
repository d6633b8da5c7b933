"""Reading sorted Arrow batches run by run, a run being neighbouring rows of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs only: a run that goes on in the next batch waits for its end.

    The keys are int columns without nulls. What is held is one batch and one run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = run_starts(batch, keys)
        same = held and all(held[-1][k][-1].as_py() == batch[k][0].as_py() for k in keys)
        last = int(starts[-1])
        if held and not (same and last == 0):
            cut = 0 if not same else int(starts[1]) if len(starts) > 1 else batch.num_rows
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            if last > cut:
                yield pa.Table.from_batches([batch.slice(cut, last - cut)])
            held = [batch.slice(last)]
        elif held:
            held.append(batch)
        else:
            if last:
                yield pa.Table.from_batches([batch.slice(0, last)])
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def run_starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Indexes at which a run begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = column(rows, k)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def column(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    v = rows[name]
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
        if isinstance(v, pa.ChunkedArray):
            v = pa.concat_arrays(v.chunks)
    return v.to_numpy(zero_copy_only=False)


def fixed_binary(rows: pa.RecordBatch | pa.Table, name: str, dtype, width: int) -> np.ndarray:
    """A binary column whose values all hold width numbers, as an array of shape (rows, width)."""
    v = rows[name]
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    parts = v.chunks if isinstance(v, pa.ChunkedArray) else [v]
    return np.concatenate(
        [np.frombuffer(b"".join(p.to_pylist()), dtype=dtype).reshape(-1, width) for p in parts]
        or [np.empty((0, width), dtype)]
    )
