"""Token ids in a file format of our own: canonical length-limited Huffman codes over all counted ids.

Documents are dealt out by ranges of doc_id and tokenised once; the ids of a range wait as Parquet in the shared
folder.  A global count of every id gives code lengths (at most MAX_BITS, by the package-merge method) and so the
canonical codes.  Each range becomes one file:

    magic "HUFIDS1\\n", header length (4 bytes), header as JSON, bit offsets of the blocks (8 bytes each), token counts
    of the documents (4 bytes each), doc_ids (8 bytes each), code lengths (1 byte for each id), the packed bits

A block is BLOCK ids that can be decoded alone from its bit offset; the last may be shorter.  Decoding looks up MAX_BITS
bits at a time in one table, for all blocks of a file at once.  File names carry the task attempt, and only files in
the manifest, which Spark commits, are read, so tasks may fail, run twice or be lost.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, filesystem, give_back, scratch, staged, table, tokenizer_path
from cutloom.llm.tokens import encoder, vocabulary_size, with_end

MAGIC = b"HUFIDS1\n"
MAX_BITS = 20
BLOCK = 256
END_ID = 0
#: A file is closed at the document that brings it to so many ids; a longer range gives several files.
FILE_IDS = 2_000_000
#: Ids that one task decodes.
TASK_IDS = 4_000_000


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits (package-merge); 0 for ids that don't occur.  A single id gets 1."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(ids) <= 1:
        out[ids] = 1
        return out
    if len(ids) > 1 << max_bits:
        raise ValueError(f"{len(ids)} ids don't fit codes of {max_bits} bits")
    order = ids[np.lexsort((ids, counts[ids]))]
    weight = counts[order].astype(np.float64)
    n = len(order)
    coins, levels = weight, []
    for _ in range(max_bits - 1):  # from the smallest coins up: pair what a level holds, merge with the next level's
        pairs = coins[: len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        at = np.argsort(merged, kind="stable")
        levels.append(at)
        coins = merged[at]
    take, depth = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for at in reversed(levels):
        chosen = at[:take]
        leaves = chosen[chosen < n]
        depth[leaves] += 1
        take = 2 * int((chosen >= n).sum())
    depth[:take] += 1
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as canonical Huffman coding numbers them."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    last = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - last
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
        last = bits
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every max_bits bits ahead: the id and how many bits it takes (0: no code)."""
    symbol, bits = np.zeros(1 << max_bits, dtype=np.uint32), np.zeros(1 << max_bits, dtype=np.uint8)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    span = np.left_shift(1, max_bits - lengths[ids].astype(np.int64))
    full = int(span.sum())
    symbol[:full] = np.repeat(ids, span)
    bits[:full] = np.repeat(lengths[ids], span)
    return symbol, bits


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The packed codes, with 8 spare bytes, and each block's bit offset."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, dtype=np.uint32)
    if len(ids):
        wide = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        both = np.bitwise_or.reduceat(wide, first)
        words[word[first]] |= (both >> np.uint64(32)).astype(np.uint32)
        words[word[first] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes(), at[::block].astype("<i8")


def decode_bits(packed: bytes, offsets: np.ndarray, n: int, symbol, bits, block: int = BLOCK, max_bits: int = MAX_BITS) -> np.ndarray:
    """n ids from blocks that start at the bit offsets, all blocks side by side."""
    words = np.frombuffer(packed, ">u4").astype(np.uint64)
    out = np.zeros((len(offsets), block), dtype=np.uint32)
    at = offsets.astype(np.int64)
    last = n - block * (len(offsets) - 1)
    for k in range(min(block, n)):
        if k == last:
            at = at[:-1]
        word = at >> 5
        ahead = (words[word] << np.uint64(32)) | words[word + 1]
        peek = (ahead >> (64 - max_bits - (at & 31)).astype(np.uint64)) & np.uint64((1 << max_bits) - 1)
        out[: len(at), k] = symbol[peek]
        step = bits[peek]
        if not step.all():
            raise ValueError("bits that are no code")
        at = at + step
    return out.reshape(-1)[:n]


_IDS = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _tokenise(path: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        token_ids, part, at = encoder(path).ids, TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for some in cuts(texts):
                ids, sizes = with_end(*token_ids(texts[some]), end_id)
                n, ids = len(sizes), ids.astype(kind)
                ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
                # Bytes of one cut stay far below what 32-bit offsets hold, but for a single text beyond 500 M ids.
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), doc_ids[some], packed], schema=_IDS)
                at += n
        give_back()

    return run


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column one after the other, and where each row's end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return data, (ends[1:].astype(np.int64) - int(ends[0])) // size


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            got = np.bincount(_flat(batch.column(0), kind)[0])
            if len(got) > len(counts):
                counts, got = got, counts
            counts[: len(got)] += got
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    return run


def file_bytes(ids: np.ndarray, doc_ids: list, sizes, part: int, seq: int, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    packed, offsets = encode_bits(ids, lengths, codes)
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    header = json.dumps({"part": part, "seq": seq, "ids": len(ids), "docs": len(doc_ids), "block": BLOCK, "max_bits": MAX_BITS, "blocks": len(offsets), "vocab": len(lengths), "null_docs": np.flatnonzero(~known).tolist()}).encode()
    return b"".join([
        MAGIC, struct.pack("<I", len(header)), header, offsets.tobytes(), np.array(sizes, "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype(np.uint8).tobytes(), packed,
    ])


@functools.lru_cache(maxsize=1)
def _table(lengths: bytes, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of the last code: all files of a manifest share it."""
    return decode_table(np.frombuffer(lengths, np.uint8), max_bits)


def read_file(data: bytes) -> tuple[dict, list, np.ndarray, np.ndarray]:
    """header, doc_ids, token counts, ids of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    size = struct.unpack_from("<I", data, 8)[0]
    h = json.loads(data[12 : 12 + size])
    at = 12 + size
    parts = []
    for n, kind in ((h["blocks"], "<i8"), (h["docs"], "<u4"), (h["docs"], "<i8"), (h["vocab"], "u1")):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    offsets, sizes, doc_ids, lengths = parts
    symbol, bits = _table(lengths.tobytes(), h["max_bits"])
    ids = decode_bits(data[at:], offsets, h["ids"], symbol, bits, h["block"], h["max_bits"]) if h["ids"] else np.zeros(0, np.uint32)
    null = set(h["null_docs"])
    return h, [None if i in null else d for i, d in enumerate(doc_ids.tolist())], sizes, ids


_FILES = "path string, part int, seq long, n_ids long, n_bytes long"


def _write(folder: str, lengths: np.ndarray, kind: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []  # doc_ids, token counts, ids
        done: list[tuple] = []
        part, seq, following, waiting = -1, 0, -1, 0

        def flush() -> None:
            nonlocal held, waiting
            if held:
                ids = np.concatenate([x[2] for x in held])
                data = file_bytes(ids, [d for x in held for d in x[0]], np.concatenate([x[1] for x in held]), part, seq, lengths, codes)
                name = f"part-{part:06d}-{seq:010d}-{uuid.uuid4().hex}.huf"
                with fs.open_output_stream(f"{base}/{name}") as f:
                    f.write(data)
                done.append((f"{folder}/{name}", part, seq, len(ids), len(data)))
                held, waiting = [], 0

        for batch in batches:
            ids, ends = _flat(batch.column(3), kind)
            parts, pos, doc_ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            breaks = np.flatnonzero((np.diff(parts) != 0) | (np.diff(pos) != 1)) + 1
            for a, stop in zip([0, *breaks], [*breaks, len(pos)]):
                while a < stop:
                    if parts[a] != part or pos[a] != following or not held:  # seq is the place of a file's first document in its range
                        flush()
                        part, seq = int(parts[a]), int(pos[a])
                    begin = int(ends[a - 1]) if a else 0
                    b = min(int(stop), int(np.searchsorted(ends, begin + file_ids - waiting)) + 1)
                    held.append((doc_ids[a:b], np.diff(ends[a:b], prepend=begin), ids[begin : ends[b - 1]]))
                    waiting += int(ends[b - 1]) - begin
                    following, a = int(pos[b - 1]) + 1, b
                    if waiting >= file_ids:
                        flush()
        flush()
        columns = list(zip(*done)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _FILES.split(", ")])
        give_back()

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order; the manifest: path, part, seq, n_ids, n_bytes, start.

    Null texts are empty (the end id alone), null doc_ids come first, rows with equal ids keep next to each other by a hash of
    their texts, so that an id on very many rows spreads; columns besides these two are left out; no rows give an empty
    manifest.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "<u2" if max(end_id, vocabulary_size(tokenizer) - 1) < 1 << 16 else "<u4"
    ids = staged(dealt.mapInArrow(_tokenise(tokenizer, end_id, kind), "part int, pos long, doc_id long, ids binary"), "ids")
    # One row for each id of the vocabulary at most.
    counted = ids.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r.id for r in counted)]) + 1, dtype=np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    # No shuffle: Spark reads stretches of a range in their order, and each becomes files with its place in the range.
    files = staged(ids.mapInArrow(_write(folder, lengths, kind, file_ids), _FILES), "ids-manifest")
    # Ids before a range: a sum over one row for each range that Spark dealt out; ids before a file in its range: a window.
    sums, start, rows = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}, 0, []
    for part in sorted(sums):
        rows.append((part, start))
        start += sums[part]
    bases = F.broadcast(spark.createDataFrame(rows, "part int, base long"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(bases, "part").select("path", "part", "seq", "n_ids", "n_bytes", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start"))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The files of a manifest -> doc_id, start, n_tokens, ids_crc32 and, with_ids, the ids; ascending in each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zlib import crc32

        for batch in batches:
            for path, begin in zip(batch["path"], batch["start"]):
                fs, local = filesystem(path)
                with fs.open_input_stream(local) as f:
                    _, doc_ids, sizes, ids = read_file(f.read())
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                ends = np.cumsum(sizes, dtype=np.int64)
                each = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                out = pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": begin + ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": [crc32(x) for x in each]})
                for i in range(0, len(out), 5_000):
                    part = out.iloc[i : i + 5_000]
                    yield part.assign(ids=[bytes(x) for x in each[i : i + 5_000]]) if with_ids else part

    n = max(1, -(-(manifest.agg(F.sum("n_ids")).first()[0] or 0) // TASK_IDS))
    # Files of about one size, so ranges of places deal them out evenly.
    return manifest.select("path", "start").repartitionByRange(n, "start").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op5_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to files of Huffman codes and read back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_ids(docs, tokenizer_path("byte_bpe_50k.json"), scratch(spark, "huffman"))
    return read_ids(manifest, with_ids=False)
