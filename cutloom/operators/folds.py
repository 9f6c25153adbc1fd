"""Ordered folds as scans of composed functions, so that one recording spreads over tasks.

A step moves a cursor: to c where the cursor is at most t, else on by d.  Steps compose to constants below bounds and a shift
above the last one.  Blocks of rows are composed on their own, the few compositions of a recording run in order, and each
block is then filled in from the cursor that reaches it.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Stands for no bound.
ENDLESS = 2**62


class Composed:
    """A composition of steps: values[i] up to bounds[i], above the last bound the cursor moved by shift."""

    def __init__(self, bounds: list[int] | None = None, values: list[int] | None = None, shift: int = 0):
        self.bounds, self.values, self.shift = bounds or [], values or [], shift

    def then(self, c: int, t: int | None, d: int) -> None:
        t = ENDLESS if t is None else t
        values = [c if v <= t else v + d for v in self.values]
        bounds, bound = self.bounds, min(ENDLESS, t - self.shift if t < ENDLESS else ENDLESS)
        if not bounds or bound > bounds[-1]:
            bounds, values = [*bounds, bound], [*values, c]
        last = [i for i in range(len(values)) if i + 1 == len(values) or values[i + 1] != values[i]]
        self.bounds, self.values, self.shift = [bounds[i] for i in last], [values[i] for i in last], self.shift + d

    def __call__(self, cursor: int | None) -> int:
        if cursor is None:  # before all rows, below every bound
            return self.values[0]
        at = bisect.bisect_left(self.bounds, cursor)
        return self.values[at] if at < len(self.bounds) else cursor + self.shift


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


_BLOCKS = pa.schema([("asset_id", pa.int64()), ("_block", pa.int64()), ("bounds", pa.list_(pa.int64())), ("values", pa.list_(pa.int64())), ("shift", pa.int64())])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, key, f = [], None, Composed()
    for asset, block, c, t, d in _runs(batches, "asset_id", "_block", "_c", "_t", "_d"):
        if (asset, block) != key:
            if key is not None:
                rows.append((*key, f.bounds, f.values, f.shift))
            key, f = (asset, block), Composed()
        f.then(c, t, d)
    if key is not None:
        rows.append((*key, f.bounds, f.values, f.shift))
    yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows) if rows else [[]] * 5, _BLOCKS)], schema=_BLOCKS)


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, cursor = None, None
    for batch in batches:
        out = []
        for asset, bounds, values, shift in _runs([batch], "asset_id", "bounds", "values", "shift"):
            own, cursor = (own, cursor) if asset == own else (asset, None)
            out.append(cursor)
            cursor = Composed(bounds, values, shift)(cursor)
        yield pa.RecordBatch.from_arrays([batch.column("asset_id"), batch.column("_block"), pa.array(out, pa.int64())], names=["asset_id", "_block", "_reach"])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, cursor = None, None
    for batch in batches:
        out = []
        for asset, block, reach, c, t, d in _runs([batch], "asset_id", "_block", "_reach", "_c", "_t", "_d"):
            if (asset, block) != key:
                key, cursor = (asset, block), reach
            out.append(cursor)
            cursor = c if cursor is None or t is None or cursor <= t else cursor + d
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_last"])


def with_cursor(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds _last: where the cursor of an asset stands before each row, null before its first.

    rows: asset_id, longs _c, _t (null: no bound) and _d, and the columns of order, by which rows are taken; size: how far the
    first of these may go within a block."""
    rows = rows.withColumn("_block", F.floor(F.col(order[0]) / size))
    dealt = rows.select("asset_id", "_block", *order, "_c", "_t", "_d").repartition("asset_id", "_block").sortWithinPartitions("asset_id", "_block", *order)
    blocks = dealt.mapInArrow(_compose, "asset_id long, _block long, bounds array<long>, values array<long>, shift long")
    blocks = blocks.repartition("asset_id").sortWithinPartitions("asset_id", "_block")
    reach = blocks.mapInArrow(_reached, "asset_id long, _block long, _reach long")
    # Dealt by another expression than the join's keys: Spark drops a repartition by those behind a sort-merge join, and may then
    # turn this into a broadcast join at run time, whose local reads leave a block's rows in several tasks.
    joined = rows.join(reach, ["asset_id", "_block"]).repartition(F.struct("asset_id", "_block")).sortWithinPartitions("asset_id", "_block", *order)
    return joined.mapInArrow(_fill, StructType([*joined.schema.fields, StructField("_last", LongType())])).drop("_block", "_reach", "_c", "_t", "_d")
