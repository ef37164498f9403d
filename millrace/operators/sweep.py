"""Sweeps over sorted rows: one range exchange, then passes over the partitions that carry what crosses their edges.

Rows are cut into ranges of (key, order), so a key with a third of all rows lies in many tasks. Each task sweeps its rows
as Arrow arrays; what a task has to know of its neighbours (one row per partition) is gathered before and handed to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.session import cut


def sorted_rows(df: DataFrame, by: list[str], then: list[str] | None = None) -> DataFrame:
    """df in order of `by` (and `then` among equals) over its partitions, checkpointed so that partitions keep their numbers.

    Rows with equal `by` share a partition. df should be written, as it is read twice (for the ranges, then for the rows).
    """
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by, *(then or [])))


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where an array's element differs from the one before (nulls are equal); the first counts as a change."""
    if len(column) == 0:
        return np.empty(0, bool)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a, b = flat[1:], flat[:-1]
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.append(True, differs)


def edges(rows: DataFrame, columns: list[str], last: bool) -> dict[int, tuple]:
    """The first (or last) row of each partition that has any: at most one row per partition is gathered."""
    schema = rows.select(F.lit(0).alias("part"), *columns).schema

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows and (last or held is None):
                held = batch.slice(batch.num_rows - 1 if last else 0, 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *held.columns], names=["part", *columns])

    return {r[0]: tuple(r[1:]) for r in rows.select(*columns).mapInArrow(edge, schema).collect()}


def sweep(rows: DataFrame, schema: str, each: Callable[[pa.Table, dict, bool], pa.Table | None], carry: dict[int, dict]) -> DataFrame:
    """Every partition's rows through `each`, batch by batch: each(rows, state, ended). carry: the state a partition begins
    with, by number. At the end it is called once more, without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, table = dict(carry.get(TaskContext.get().partitionId(), {})), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if batch.num_rows and (out := each(table, state, False)) is not None:
                yield from out.to_batches()
        if table is not None and (out := each(table.slice(0, 0), state, True)) is not None:
            yield from out.to_batches()

    return rows.mapInArrow(run, schema)
