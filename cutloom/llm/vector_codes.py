"""Vector codes: vectors are cut into parts, and each part is named by the nearest entry of its codebook.

The nearest entry is found by sliced bitmasks.  In every dimension the entries' coordinates are sorted, and a prefix mask
says which entries stand up to each place; the entries within a radius of a coordinate are the difference of two prefix
masks.  ANDed over all dimensions these give exactly the entries in a box.  If the best of them lies within the radius, no
entry outside the box is nearer; else the part is tried again with the distance found, or twice the radius.

Codebooks are fitted by rounds over all rows: tasks sum the parts that fall to each entry, Spark adds up the sums, and only
sums (one for each component of the codebooks) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import plain_names, staged, table
from cutloom.llm.vectors import matrix, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Bits to spare for products: two components may lie twice as far apart as each reaches.
SPARE = 2
#: Rows that a task compares at a time.
CHUNK = 8192
#: As many sums of labels are sent to every executor; more are joined by a shuffle.
SENT_LABELS = 100_000


class Slices:
    """The entries of one codebook (rows of integers) by their coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries, (n, width) = entries, entries.shape
        words = -(-n // 64)
        bit = np.zeros((n, words), dtype=np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.sorted, self.prefix = [], []
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            masks = np.zeros((n + 1, words), dtype=np.uint64)
            masks[1:] = np.bitwise_or.accumulate(bit[order], axis=0)
            self.sorted.append(entries[order, d])
            self.prefix.append(masks)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        self.radius = max(1, int(np.sqrt(np.median(apart.min(axis=1))))) if n > 1 else 1

    def box(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, entry), in order, of the entries that lie within the radius in every dimension."""
        mask = None
        for d, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, points[:, d] - radius, side="left")
            high = np.searchsorted(coordinates, points[:, d] + radius, side="right")
            here = prefix[high] ^ prefix[low]
            mask = here if mask is None else mask & here
        bits = np.unpackbits(mask.view(np.uint8).reshape(len(points), -1), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the first of equals, and its squared distance."""
        entry, distance = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        left, radius = np.arange(len(points)), np.full(len(points), self.radius, dtype=np.int64)
        while len(left):
            row, at = self.box(points[left], radius)
            far = ((points[left[row]] - self.entries[at]) ** 2).sum(axis=1)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            some = row[begin]
            low = np.minimum.reduceat(far, begin) if len(begin) else far
            best = np.flatnonzero(far == np.repeat(low, np.diff(np.append(begin, len(row)))))
            best = best[np.diff(row[best], prepend=-1) > 0]  # the first of equals
            sure = low <= radius[some] ** 2
            done = left[some[sure]]
            entry[done], distance[done] = at[best[sure]], low[sure]
            radius *= 2
            radius[some] = np.sqrt(low).astype(np.int64) + 1
            again = np.ones(len(left), dtype=bool)
            again[some[sure]] = False
            left, radius = left[again], radius[again]
        return entry, distance


def _nearest(books: list[Slices], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances, a column for each part."""
    found = [b.nearest(x) for b, x in zip(books, np.split(rows, len(books), axis=1))]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Stretches of batches and the integers of their vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            yield some, matrix(some.column("embedding"), size)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks of vectors(vec_id, embedding) as integers [part, entry, place in the part].

    Codebooks start as the parts of the smallest vec_ids (ties by the vector, null ids last); each round gives every entry
    the rounded-down mean of its parts, entries without parts stay.  Fewer rows than entries give fewer entries, none
    give an empty array.  Rows that usable() leaves out don't count; repeated rows count each."""
    rows, size = usable(vectors.select("vec_id", "embedding"), parts, SPARE)
    if not size:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toPandas()["embedding"]
    books = matrix(pa.array(list(seeds)), size).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    rows = rows.select("embedding")
    for _ in range(rounds):
        books = _moved(rows, size, books)
    return books


def _moved(rows: DataFrame, size: int, books: np.ndarray) -> np.ndarray:
    parts, n, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        total, count = np.zeros((parts, n, width), dtype=np.int64), np.zeros((parts, n), dtype=np.int64)
        for _, x in _chunks(batches, size):
            entry, _ = _nearest(slices, x)
            for p, part in enumerate(np.split(x, parts, axis=1)):
                np.add.at(total[p], entry[:, p], part)
                count[p] += np.bincount(entry[:, p], minlength=n)
        p, e = np.nonzero(count)
        place = np.tile(np.arange(width), len(p))
        at = (np.repeat(p, width), np.repeat(e, width), place)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(total[at]), pa.array(np.repeat(count[p, e], width))], names=["p", "e", "place", "total", "n"])

    found = rows.mapInArrow(sums, "p long, e long, place long, total long, n long").groupBy("p", "e", "place")
    out = books.copy()
    for r in found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # a row for each component
        out[r.p, r.e, r.place] = int(r.total) // r.n
    return out


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds code (binary, a byte for each part, two if a codebook has more than 256 entries) and error (the squared
    distance of the integers to their entries) to the rows that can be coded, in place of embedding; the others go, as do
    columns of these names."""
    parts, n, width = books.shape
    rows, size = usable(vectors, parts, SPARE)
    kind = np.uint8 if n <= 256 else np.dtype("<u2")
    others = [c for c in vectors.columns if c not in ("embedding", "_code", "_error")]
    rows = rows if size == parts * width and n else rows.limit(0)
    plain = rows.select(*[F.col(f"`{c}`") for c in others])
    rows = rows.select("embedding", *[F.col(f"`{c}`") for c in others]).toDF("embedding", *plain_names(plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch, x in _chunks(batches, size):
            entry, distance = _nearest(slices, x)
            codes = pa.array([r.tobytes() for r in entry.astype(kind)], pa.binary())
            columns = [*batch.columns[1:], codes, pa.array(distance.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "_code", "_error"])

    return rows.mapInArrow(run, rows.drop("embedding").schema.add("_code", "binary").add("_error", "long")).toDF(*others, "_code", "_error")


def decode(codes: DataFrame, books: np.ndarray, column: str = "_code") -> DataFrame:
    """Adds restored (array of doubles): the entries that a code names, scaled back to the middle of their steps."""
    from cutloom.llm.vectors import SCALE

    parts, n, _ = books.shape
    kind = np.uint8 if n <= 256 else np.dtype("<u2")

    @F.pandas_udf("array<double>")
    def restored(values):
        import pandas as pd

        return pd.Series([None if v is None else ((books[np.arange(parts), np.frombuffer(v, kind)].ravel() + 0.5) / SCALE).tolist() for v in values])

    return codes.withColumn("restored", restored(F.col(column)))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all embeddings.

    Rows without usable vectors have no code and give no row; equal rows are coded and counted each; null ids stay null;
    equal labels, nulls together, share the sum of their errors.  No rows give none."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = fit(rows)
    coded = staged(encode(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("_error").alias("label_error"))
    sums = staged(sums, "labels")
    if sums.count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("_code")).alias("code"), F.col("_error").alias("error"), "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_ASSIGN = """
d{i} AS (SELECT r, x.p, e, (x.a-c.a)*(x.a-c.a) + (x.b-c.b)*(x.b-c.b) + (x.c-c.c)*(x.c-c.c) + (x.d-c.d)*(x.d-c.d) AS d FROM x JOIN c{i} c ON c.p = x.p),
a{i} AS (SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM d{i} GROUP BY 1, 2)"""
_MOVE = """
m{i} AS (SELECT x.p, e, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(x.d) AS d FROM a{i} JOIN x ON x.r = a{i}.r AND x.p = a{i}.p GROUP BY 1, 2),
c{j} AS (SELECT c.p, c.e, """ + ", ".join(f"coalesce(CAST((m.{k} - ((m.{k} % m.n) + m.n) % m.n) // m.n AS BIGINT), c.{k}) AS {k}" for k in "abcd") + """
  FROM c{i} c LEFT JOIN m{i} m ON m.p = c.p AND m.e = c.e)"""
#: For vectors of 64 components and ids that stand once.
OP11_SQL = """WITH v AS (SELECT vec_id AS r, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM v, range(16) t(p)),
s AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS e FROM v ORDER BY r LIMIT 64),
c0 AS (SELECT p, e, a, b, c, d FROM x JOIN s ON s.r = x.r),""" + ",".join([
    _ASSIGN.format(i=0), _MOVE.format(i=0, j=1), _ASSIGN.format(i=1), _MOVE.format(i=1, j=2), _ASSIGN.format(i=2),
]) + """,
k AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1),
h AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) AS h FROM c2)
SELECT k.r AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN v ON v.r = k.r, h
"""  # fmt: skip
