"""Repeated n-grams of characters, all sizes in one pass.

Every place of a text gives one row, its window of the longest size; windows that share their first characters go to one task
and are sorted.  There each size's grams stand together as runs of equal prefixes, and a gram that stands once is not looked
at for longer sizes, whatever follows.  One shuffle moves a window a place, counted before it moves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that a task counts before it hands them on.
HELD = 500_000


def _windows(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        assets, windows = zip(*counts) if counts else ((), ())
        out = pa.RecordBatch.from_arrays([pa.array(assets, pa.int64()), pa.array(windows, pa.string()), pa.array(counts.values(), pa.int64())], names=["asset_id", "w", "n"])
        counts.clear()
        return out

    for batch in batches:
        for asset, text in zip(batch.column("asset_id").to_pylist(), batch.column("t").to_pylist()):
            for at in range(0, len(text or "") - low + 1, HELD):
                counts.update((asset, text[i : i + high]) for i in range(at, min(at + HELD, len(text) - low + 1)))
                if len(counts) > HELD:
                    yield rows()
    yield rows()


def _runs(table: pa.Table, low: int, high: int, least: int) -> pa.RecordBatch:
    """The grams of rows that hold all windows with their first low characters, in order."""
    asset, n = table["asset_id"].fill_null(0).to_numpy(), table["n"].to_numpy()
    unnamed = table["asset_id"].is_null().to_numpy()
    windows = np.array(table["w"].to_pylist(), dtype=f"U{high}")
    letters = windows.view(np.uint32).reshape(len(windows), high)
    out = []
    changed = np.ones(len(windows), dtype=bool)
    changed[1:] = (asset[1:] != asset[:-1]) | (unnamed[1:] != unnamed[:-1]) | (letters[1:, : low - 1] != letters[:-1, : low - 1]).any(axis=1)
    rows = np.arange(len(windows))  # that may still belong to a repeated gram
    for size in range(low, high + 1):
        changed[1:] |= letters[rows[1:], size - 1] != letters[rows[:-1], size - 1]
        begin = np.flatnonzero(changed)
        times = np.add.reduceat(n[rows], begin) if len(rows) else n[:0]
        found = (times >= least) & (letters[rows[begin], size - 1] > 0)
        first = rows[begin[found]]
        grams = np.array(windows[first].astype(f"U{size}").tolist(), dtype=object)
        out.append((asset[first], unnamed[first], np.full(len(first), size), grams, times[found]))
        keep = np.repeat(found, np.diff(np.append(begin, len(rows))))
        rows, changed = rows[keep], changed[keep]
    asset, unnamed, sizes, grams, times = (np.concatenate(x) for x in zip(*out))
    columns = [pa.array(asset, pa.int64(), mask=unnamed), pa.array(sizes, pa.int64()), pa.array(grams, pa.string()), pa.array(times, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["asset_id", "n", "gram", "times"])


def _repeated(batches: Iterator[pa.RecordBatch], low: int, high: int, least: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows between first characters, so that no run is torn."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = [(a, w[:low]) for a, w in zip(batch.column("asset_id").to_pylist(), batch.column("w").to_pylist())]
        last = next((i for i in range(len(heads) - 1, 0, -1) if heads[i - 1] != heads[i]), 0)
        if not last and held and (held[-1].column("asset_id")[-1].as_py(), held[-1].column("w")[-1].as_py()[:low]) == heads[0]:
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, last)] if last else held
        if whole:
            yield _runs(pa.Table.from_batches(whole), low, high, least)
        held = [batch.slice(last)]
    if held:
        yield _runs(pa.Table.from_batches(held), low, high, least)


def repeated_ngrams(texts: DataFrame, low: int = 4, high: int = 8, least: int = 2) -> DataFrame:
    """texts(asset_id, t) -> asset_id, n, gram, times of the n-grams, n from low to high, that stand at least so often in an
    asset's texts.  Null and shorter texts have none; grams don't reach over texts."""
    w = texts.select(F.col("asset_id").cast("long").alias("asset_id"), "t").mapInArrow(lambda b: _windows(b, low, high), "asset_id long, w string, n long")
    dealt = w.repartition("asset_id", F.left("w", F.lit(low))).sortWithinPartitions("asset_id", "w")
    return dealt.mapInArrow(lambda b: _repeated(b, low, high, least), "asset_id long, n long, gram string, times long")
