"""Streaming whole frames through Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def per_frame(
    df: DataFrame, keys: list[str], kernel: Callable[[pa.Table], pa.Table], schema: str, order: list[str] | None = None, rows: int = 50_000
) -> DataFrame:
    """Apply ``kernel`` to tables of whole frames, many small frames at a time.

    Rows of one frame meet in one task, sorted by ``keys`` and ``order``; a
    table closes at the first frame border after ``rows`` rows, so the cost of
    a call is shared by many frames and memory is bounded by the largest frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(count, dtype=bool)
            for k in keys:
                c = whole.column(k).to_numpy(zero_copy_only=False)
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield from kernel(whole.slice(0, cut)).to_batches()
                whole = whole.slice(cut)
            held, count = whole.to_batches(), whole.num_rows
        if count:
            yield from kernel(pa.Table.from_batches(held).combine_chunks()).to_batches()

    sorted_ = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return sorted_.mapInArrow(run, schema)


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """First row of every run of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.nonzero(new)[0]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node linked to it by edges ``a - b``."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent
