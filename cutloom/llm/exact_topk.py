"""Exact search for the largest inner products by vector-approximation files.

1. Equal vectors form one class with its smallest ids, one more than results are wanted: further copies can't be results.
2. Marks cut every dimension into up to 256 cells at quantiles over all rows.  Tasks write two files for each partition of
   classes: a byte a component that names its cell, and records of fixed size with the exact vector and its ids.
3. A task takes a block of queries and scans the cells: the ends of a cell bound its components, so each class has a least
   and a largest score.  A class whose largest score is below the k + 1 best least scores so far is passed over.
4. The exact vectors of the rest are read by falling largest scores (the lower bound of a distance, turned round) until the
   k + 1st exact score is above all that is left.  A block whose list of classes grows long reads before its scan goes on.

Every file counts only through the manifest that Spark commits.  Each block of queries gives its own results; only few
queries, spread over stripes of files to use all tasks, are merged.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.functions.threads import one_thread
from cutloom.llm.common import filesystem, give_back, scratch, staged, table
from cutloom.llm.vectors import matrix, scaled, usable

K = 5
CELLS = 256
#: Queries that a task scans for at a time, classes of one step of a scan, and classes that a block holds unread.
BLOCK, STEP, PENDING = 256, 8192, 1_000_000
#: Records that lie nearer are read in one piece.
GAP = 16


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = matrix(batch.column("embedding"), size).astype("<i4")
        vectors = pa.array([r.tobytes() for r in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors], names=["vec_id", "v"])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """vec_id, v: the integers of a vector of the given size, as bytes."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(lambda b: _packed(b, size), "vec_id long, v binary")


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """v and ids: the k + 1 smallest ids of each distinct vector, null ids last.  Each task leaves out further copies before
    anything is moved."""
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = vectors.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id"))).alias("ids")).select("v", F.col("ids.vec_id").alias("ids"))


class Marks:
    """The cells of every dimension: least and largest value, by dimension and cell."""

    def __init__(self, bounds: list[list[int]]):
        self.low, self.high = np.zeros((len(bounds), CELLS)), np.zeros((len(bounds), CELLS))
        self.inner = []
        for d, b in enumerate(bounds):
            marks = np.unique(b)[: CELLS]  # of which the first is the least value
            ends = np.append(marks[1:] - 1, max(b))
            self.low[d, : len(marks)], self.high[d, : len(marks)] = marks, ends
            self.inner.append(marks[1:])

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, rows[:, d], side="right") for d, m in enumerate(self.inner)], axis=1).astype(np.uint8)


def marks(rows: DataFrame, size: int) -> Marks:
    """Cells of about as many rows each, over all rows; 257 numbers a dimension come to the driver."""
    steps = [i / (CELLS - 1) for i in range(1, CELLS - 1)]
    v = rows.select(F.posexplode(scaled()).alias("d", "x")).groupBy("d")
    found = v.agg(F.percentile_approx("x", steps, 2000).alias("inner"), F.min("x").alias("low"), F.max("x").alias("high"))
    bounds = {r.d: [int(x) for x in (r.low, *r.inner, r.high)] for r in found.collect()}  # a row for each dimension
    return Marks([bounds[d] for d in range(size)])


def _record(size: int, k: int) -> np.dtype:
    return np.dtype([("v", "<i4", size), ("known", "u1"), ("n", "u1"), ("ids", "<i8", k + 1)])


def write_files(found: DataFrame, cells: Marks, size: int, k: int) -> list[tuple[str, int]]:
    """Writes cells and records of classes; the base names of the files and their numbers of classes, a pair a task."""
    spark = found.sparkSession
    folder, kind = scratch(spark, "approximations"), _record(size, k)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name, n, streams = uuid.uuid4().hex, 0, None  # the attempt's own name
        for batch in batches:
            if not batch.num_rows:
                continue
            if streams is None:
                fs.create_dir(base, recursive=True)
                streams = [fs.open_output_stream(f"{base}/{name}.{x}") for x in ("cells", "records")]
            rows = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, size)
            records = np.zeros(len(rows), dtype=kind)
            records["v"] = rows
            for r, ids in zip(records, batch.column("ids").to_pylist()):
                known = [i for i in ids if i is not None]
                r["known"], r["n"], r["ids"][: len(known)] = len(known), len(ids), known
            streams[0].write(cells.cells(rows.astype(np.int64)).tobytes())
            streams[1].write(records.tobytes())
            n += len(rows)
        for s in streams or ():
            s.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] if n else [], pa.string()), pa.array([n] if n else [], pa.int64())], names=["path", "n"])

    manifest = staged(found.mapInArrow(write, "path string, n long"), "manifest")
    return sorted((r.path, r.n) for r in manifest.collect())  # a row for each partition


def _key(score: int, vec_id: int | None) -> tuple:
    """Order of results: higher scores first, then smaller ids, null ids last."""
    return -score, vec_id is None, vec_id or 0


class Search:
    """The best results of a block of distinct query vectors."""

    def __init__(self, queries: np.ndarray, cells: Marks, k: int):
        self.q, self.cells, self.k = queries, cells, k
        n, size = queries.shape
        self.kind = _record(size, k)
        self.best: list[list[tuple]] = [[] for _ in range(n)]
        # Twice the scores, so that the middles of cells are whole numbers; what rounding may add is put on top.
        self.least = np.full((n, k + 1), -np.inf)
        self.exact = np.full(n, -np.inf)
        reach = np.maximum(np.abs(cells.low), np.abs(cells.high)).max(axis=1)
        self.slack = np.abs(queries.astype(np.float64)) @ reach * 2.0**-38
        self.t, self.ta = queries.T.astype(np.float64), np.abs(queries.T).astype(np.float64)
        self.middle, self.half = (cells.low + cells.high).ravel(), (cells.high - cells.low).ravel()
        self.at = np.arange(size) * CELLS
        self.pending: list[tuple] = []
        self.held = 0

    def floor(self) -> np.ndarray:
        """Twice the score that a class must reach."""
        return np.maximum(self.least.min(axis=1), self.exact)

    def scan(self, number: int, path: str, n: int) -> None:
        fs, local = filesystem(path)
        size = self.q.shape[1]
        with fs.open_input_stream(f"{local}.cells") as f:
            for at in range(0, n, STEP):
                here = min(STEP, n - at)
                place = np.frombuffer(f.read(here * size), np.uint8).reshape(here, size) + self.at
                middle, half = self.middle[place] @ self.t, self.half[place] @ self.ta
                low = middle - half - self.slack
                better = np.flatnonzero((low > self.least.min(axis=1)).any(axis=0))
                if len(better):
                    both = np.concatenate([self.least[better], low[:, better].T], axis=1)
                    self.least[better] = np.partition(both, -self.k - 1, axis=1)[:, -self.k - 1 :]
                high = middle + half + self.slack
                row, query = np.nonzero(high >= self.floor())
                self.pending.append((query, np.full(len(row), number), row + at, high[row, query]))
                self.held += len(row)
                if self.held > PENDING:
                    self.read()

    def read(self) -> None:
        """Exact scores of the classes that are left, by falling largest scores, until none can be among the best."""
        query, number, row, high = (np.concatenate(x) for x in zip(*self.pending)) if self.pending else [np.zeros(0, dtype=np.int64)] * 4
        self.pending, self.held, width = [], 0, 2 * (self.k + 1)
        order = np.lexsort((-high, query))
        while len(order):
            order = order[high[order] >= self.floor()[query[order]]]
            begin = np.flatnonzero(np.diff(query[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            now = order[rank < width]
            self._take(query[now], number[now], row[now])
            order, width = order[rank >= width], 2 * width

    def _take(self, query: np.ndarray, number: np.ndarray, row: np.ndarray) -> None:
        gained = defaultdict(list)
        for f in np.unique(number):
            some = number == f
            places, back = np.unique(row[some], return_inverse=True)
            records = self._records(self.files[f][0], places)
            scores = np.einsum("ij,ij->i", records["v"].astype(np.int64)[back], self.q[query[some]])
            for q, b, score in zip(query[some].tolist(), back.tolist(), scores.tolist()):
                gained[q].append((score, records[b]))
        for q, found in gained.items():
            ids = [(s, int(i)) for s, r in found for i in r["ids"][: r["known"]]] + [(s, None) for s, r in found for _ in range(r["n"] - r["known"])]
            self.best[q] = sorted(self.best[q] + ids, key=lambda x: _key(*x))[: self.k + 1]
            if len(self.best[q]) > self.k:
                self.exact[q] = 2 * self.best[q][-1][0]

    def _records(self, path: str, places: np.ndarray) -> np.ndarray:
        fs, local = filesystem(path)
        out, step = [], self.kind.itemsize
        with fs.open_input_file(f"{local}.records") as f:
            for some in np.split(places, np.flatnonzero(np.diff(places) > GAP) + 1):
                piece = f.read_at(int(some[-1] - some[0] + 1) * step, int(some[0]) * step)
                out.append(np.frombuffer(piece, self.kind)[some - some[0]])
        return np.concatenate(out)

    def run(self, files: list[tuple[str, int]]) -> list[list[tuple]]:
        self.files = files
        for number, (path, n) in enumerate(files):
            self.scan(number, path, n)
        self.read()
        return self.best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, own: bool = True) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank from 1, vec_id, score.

    For each row of queries the k rows of vectors with the largest inner products of the integers floor(256 x), ties to the
    smaller vec_id, null ids last; all if there are fewer.  own: queries are rows of vectors, and their own row is no result.
    Rows that vectors.usable() leaves out take no part; neither do queries of another length.  Rows that share an id are
    different rows.  No queries or no vectors give no rows."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows, size = usable(vectors.select("vec_id", "embedding"))
    if not size:
        return spark.createDataFrame([], schema)
    cells = marks(rows, size)
    files = write_files(classes(packed(rows, size), k), cells, size, k)
    asked, _ = usable(queries.select("vec_id", "embedding"))
    asked = packed(asked.filter(F.size("embedding") == size), size)
    asked = staged(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    n = asked.count()
    blocks, tasks = max(1, -(-n // BLOCK)), 2 * spark.sparkContext.defaultParallelism
    blocks = max(blocks, min(n, tasks, -(-n // 32)))
    stripes = max(1, min(len(files), tasks // blocks))

    def search(key: tuple, block: pa.Table) -> pa.Table:
        one_thread()
        mine = files[key[0].as_py() // blocks :: stripes]
        rows = np.frombuffer(b"".join(block["v"].to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
        whole, back = np.unique(rows, axis=0, return_inverse=True)
        best, out = Search(whole, cells, k).run(mine), []
        for row, query_id, b in zip(block["row"].to_pylist(), block["vec_id"].to_pylist(), back.tolist()):
            out += [(row, query_id, int((whole[b] ** 2).sum()), vec_id, score) for score, vec_id in best[b]]
        give_back()
        return pa.table(dict(zip(("row", "query_id", "self", "vec_id", "score"), map(list, zip(*out)) if out else [[]] * 5)), schema=_FOUND)

    every = F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: s * blocks + F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    dealt = asked.withColumn("cell", F.explode(every))
    found = dealt.repartitionByRange(blocks * stripes, "cell").groupBy("cell").applyInArrow(search, "row long, query_id long, self long, vec_id long, score long")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    if own:  # of the k + 1 best one may be the query's own row; rows of its id and score are alike
        mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
        found = found.withColumn("own", mine & (F.row_number().over(Window.partitionBy("row", mine).orderBy("score")) == 1)).filter(~F.coalesce("own", F.lit(False)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


_FOUND = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "self", "vec_id", "score")])


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best of all embeddings for each whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


OP12_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
