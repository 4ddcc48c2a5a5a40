"""Work on runs of equal keys inside Arrow batches of sorted partitions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

__all__ = ["in_runs", "release_memory"]


def release_memory() -> None:
    """Give what a finished partition used back to the system: Spark keeps its Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_runs(key: list[str], work: Callable, out_schema: pa.Schema):
    """Arrow function over batches sorted by ``key``: calls ``work(rows)`` once per run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, found = [], []

        def finish(tab: pa.Table) -> None:
            found.extend(work(tab))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[] for _ in out_schema]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if s == e:
                    continue
                here = tuple(c[s] for c in cols)
                if waiting and waiting[0] != here:
                    finish(pa.Table.from_batches(waiting[1]))
                    waiting = []
                if waiting:
                    waiting[1].append(batch.slice(s, e - s))
                else:
                    waiting = [here, [batch.slice(s, e - s)]]
            if len(found) >= 20_000:
                yield emit()
        if waiting:
            finish(pa.Table.from_batches(waiting[1]))
        yield emit()
        waiting = []
        release_memory()

    return run
