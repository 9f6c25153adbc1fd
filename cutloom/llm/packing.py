"""Packing: cost-balanced sequences of bounded length.

Attention cost of a piece of n tokens is estimated as linear * n + quadratic * n * n.  A document longer than a
sequence fills whole sequences with its leading tokens; what is left of each document is packed, in blocks of bounded
size, by descending length: each piece goes to the sequence of the lowest cost so far that has room for it, which is
searched for exactly.  A piece that fits nowhere whole is cut and fills the sequence with most room, so that only the
last sequences of a block need padding.  Blocks are packed where their rows are read: there is no shuffle, and a task
holds one block of pieces at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, give_back, picked, table, tokenizer_path
from cutloom.llm.tokens import encoder, with_end

CAPACITY = 1024
#: Tokens that wait for a place in one task at most.
BLOCK_TOKENS = 8_000_000
END_ID = 0

Placed = tuple[int, int, int, int, int]  # piece, start in it, length, sequence, offset there


class _Open:
    """Open sequences by the room they have left, each room a heap of (cost, sequence), under a tree of the cheapest of any
    range of rooms: the cheapest sequence with room for a piece is found exactly, in steps of the tree's depth."""

    def __init__(self, n: int, capacity: int):
        self.base = 1 << (capacity - 1).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.low: list[tuple[float, int] | None] = [None] * (2 * self.base)
        self.heaps[capacity] = [(0.0, s) for s in range(n)]
        self._update(capacity)

    def _update(self, room: int) -> None:
        low, at = self.low, self.base + room - 1
        low[at] = self.heaps[room][0] if self.heaps[room] else None
        while at > 1:
            at >>= 1
            a, b = low[2 * at], low[2 * at + 1]
            low[at] = b if a is None or b is not None and b < a else a

    def put(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._update(room)

    def take(self, room: int) -> tuple[float, int]:
        out = heapq.heappop(self.heaps[room])
        self._update(room)
        return out

    def cheapest(self, size: int) -> tuple[float, int] | None:
        """Of the sequences with room for size the one of the lowest cost, the lower number of equals."""
        low, at = self.low, self.base + size - 1
        best = low[at]
        while at > 1:
            other = low[at + 1] if not at & 1 else None
            if best is None or other is not None and other < best:
                best = other
            at >>= 1
        return best

    def widest(self) -> int:
        """The largest room that any sequence has."""
        low, at = self.low, 1
        while at < self.base:
            at = 2 * at + (low[2 * at + 1] is not None)
        return at - self.base + 1


def assign(lengths: Iterable[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[Placed]:
    """Packs pieces of 1..capacity tokens into ceil(total / capacity) sequences of balanced cost: by descending length, each
    to the lowest-cost sequence with room for it.  Where none has room for the whole, the sequence with most room is filled
    and the rest goes on.  No gaps; no pieces give no sequences; ties go to the lower sequence number."""
    lengths = list(lengths)
    n = -(-sum(lengths) // capacity)
    room, out, left = [capacity] * n, [], _Open(n, capacity)
    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, size = 0, lengths[piece]
        while size:
            found = left.cheapest(size)
            cost, s = left.take(room[found[1]] if found else left.widest())
            part = min(size, room[s])
            out.append((piece, start, part, s, capacity - room[s]))
            room[s] -= part
            start, size = start + part, size - part
            if room[s]:
                left.put(cost + linear * part + quadratic * part * part, s, room[s])
    return out


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _rows(doc_ids: pa.Array, start, length, doc_tokens, sequence, offset, ids: np.ndarray, at, with_ids: bool) -> pa.RecordBatch:
    """Pieces ids[at : at + length], with their other columns."""
    from zlib import crc32

    data = memoryview(ids.astype("<u4", copy=False)).cast("B")
    each = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
    columns = [doc_ids, start, length, np.fromiter(map(crc32, each), np.int64, len(each)), doc_tokens, sequence, offset]
    columns.append([bytes(x) for x in each] if with_ids else pa.nulls(len(each), pa.binary()))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))


def _packer(path: str, capacity: int, block_tokens: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        token_ids = encoder(path).ids
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []  # doc_ids, starts, lengths, tokens of the documents, ids
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, rest, waiting
            if rest:
                doc_ids = pa.concat_arrays([x[0] for x in rest])
                start, length, total, ids = (np.concatenate([x[k] for x in rest]) for k in range(1, 5))
                begin = np.cumsum(length) - length
                placed = np.array(assign(length.tolist(), capacity), dtype=np.int64).reshape(-1, 5)
                for i in range(0, len(placed), 20_000):
                    p, a, size, s, o = placed[i : i + 20_000].T
                    yield _rows(doc_ids.take(pa.array(p)), start[p] + a, size, total[p], sequence + s, o, ids, begin[p] + a, with_ids)
                sequence += -(-waiting // capacity)
            rest, waiting = [], 0

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for some in cuts(texts):
                ids, size = with_end(*token_ids(texts[some]), end_id)
                known, begin = doc_ids[some], np.cumsum(size) - size
                # Whole sequences are the longest pieces of all, and each opens the cheapest sequence, an empty one.
                whole = size // capacity
                doc = np.repeat(np.arange(len(size)), whole)
                if len(doc):
                    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
                    full = np.full(len(doc), capacity)
                    yield _rows(known.take(pa.array(doc)), start, full, size[doc], sequence + np.arange(len(doc)), full - capacity, ids, begin[doc] + start, with_ids)
                    sequence += len(doc)
                short = np.flatnonzero(size % capacity)
                at, n = (whole * capacity)[short], (size % capacity)[short]
                rest.append((known.take(pa.array(short)), at, n, size[short], picked(ids, begin[short] + at, n)))
                waiting += int(n.sum())
                if waiting >= block_tokens:
                    yield from flush()
        yield from flush()
        give_back()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with_ids, the piece's ids (little-endian unsigned 32-bit).

    Every document ends with end_id.  Null and empty texts are documents of that one id; null doc_ids stay null;
    repeated rows are packed each for itself; other columns are dropped, whatever their names; no rows give no rows.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = some.mapInArrow(_packer(tokenizer, capacity, block_tokens, end_id, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)
