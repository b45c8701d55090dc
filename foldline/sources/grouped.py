"""Files, each whole, out of a table of their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of results that are handed on together.
ROWS, BYTES = 4096, 4 << 20


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each run of equal file_id."""
    parts: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        ids, at = b.column("file_id").to_pylist(), 0
        while at < len(ids):
            if parts and ids[at] != now:
                yield pa.Table.from_batches(parts)
                parts = []
            now, end = ids[at], at + 1
            while end < len(ids) and ids[end] == now:
                end += 1
            parts.append(b.slice(at, end - at))
            at = end
    if parts:
        yield pa.Table.from_batches(parts)


def _together(results: list[pa.Table]) -> list[pa.RecordBatch]:
    return pa.concat_tables(results, promote_options="default").combine_chunks().to_batches()


def per_file(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over the rows of each file_id, which come in any order.  As applyInArrow, but files
    share Arrow batches: a group of its own costs Spark more than a short file's work.  A
    task holds a batch and a file."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        n = size = 0
        for t in tables(batches):
            done.append(run(t))
            n, size = n + done[-1].num_rows, size + done[-1].nbytes
            if n >= ROWS or size >= BYTES:
                yield from _together(done)
                done, n, size = [], 0, 0
        if done:
            yield from _together(done)

    return rows.repartition("file_id").sortWithinPartitions("file_id").mapInArrow(over, schema)
