"""What the operators of this subpackage share: tables, the shared scratch folder, files by any Hadoop-style path."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table; with columns, only these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; never copied, the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the driver runs
    all tasks itself (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"cutloom-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_names(df: DataFrame) -> list[str]:
    """Names for the columns of df that can't clash or hold a dot, which Spark's Arrow and pandas functions can't take."""
    return [f"_c{i}" for i in range(len(df.columns))]


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def filesystem(path: str):
    """pyarrow's file system and the path in it; a bare path is local."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _places(shift: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places to take: for each stretch its shift plus the running number, in 32 bits where they fit."""
    total = int(size.sum())
    kind = np.int32 if total < 1 << 30 and (not len(shift) or np.abs(shift).max() < 1 << 30) else np.int64
    out = np.repeat(shift.astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def picked(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[begin[i] : begin[i] + size[i]] one after the other."""
    return data[_places(begin - np.cumsum(size) + size, size)]


def merged_ranges(starts, ends) -> list[tuple[int, int]]:
    """Unions half-open ranges given in ascending order of their starts."""
    out: list[list[int]] = []
    for a, b in zip(starts, ends):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def give_back() -> None:
    """Returns freed memory to the system at a task's end: Spark keeps Python workers for the stages that follow."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cuts(texts, size: int = 4_000_000) -> Iterator[slice]:
    """Slices of an Arrow array of strings with about size bytes each, and one value at least: bounds what a task holds."""
    import pyarrow.compute as pc

    ends, begin, before = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)), 0, 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield slice(begin, stop)
        begin, before = stop, int(ends[stop - 1])
