"""Benchmark decontamination with an FM-index per training shard.

Test phrases are windows of WINDOW consecutive words of the items (an item of fewer words is one window).  A task cuts
the texts it reads into shards of about SHARD_BYTES.  Over all words of a shard, whose distinct words are its alphabet,
lies one FM-index: a suffix order, its Burrows-Wheeler transform in a wavelet matrix of packed bits, and every SAMPLE-th
suffix position.  All windows of all blocks of items are searched in that index, backward and side by side, through the
matrix's ranks; occurrences are located by walking to a sampled position and confirmed word by word, and their spans are
merged for each document.

Words are told apart by 64-bit hashes in the index, and by both of their keys when an occurrence is confirmed.  Texts are
indexed in overlapping blocks, so that copies of a text can't make suffixes equal over more than BLOCK words.  The items
are a query set: tasks write the phrases of blocks of items to files, of which a task holds a few at a time.  Documents
are not shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, filesystem, give_back, plain_names, merged_ranges, scratch, table

WINDOW = 10
BLOCK = 118
SAMPLE = 8
SHARD_BYTES = 8_000_000
CUT_BYTES = 1_000_000
#: Items, and bytes of their texts, in a block of phrases.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 4_000_000

_PRIME = 0x9E3779B97F4A7C15
_LETTER = np.zeros(256, dtype=np.uint8)  # a word's bytes, lower-cased; 0: not in a word
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LETTER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LETTER[_b] = _b + 32


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_cached: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cached.get("up", ())) < n:
        size = max(n, 1 << 16)
        _cached["up"], _cached["down"] = _powers(size, _PRIME), _powers(size, pow(_PRIME, -1, 1 << 64))
    return _cached["up"][:n], _cached["down"]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes data[offsets[i] : offsets[i + 1]] -> key of each word (two columns: a hash of all its bytes, and its
    first 8 bytes with its length mixed in), and the index of the first word of each text (and the end)."""
    low = _LETTER[data]
    inside = low != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(low * up[: len(data)], out=total[1:], dtype=np.uint64)
    key = (total[ends] - total[starts]) * down[starts]
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    size = np.minimum(ends - starts, 8).astype(np.uint64)
    ahead = np.ndarray(len(low), dtype="<u8", buffer=padded, strides=(1,))[starts] if len(low) else np.zeros(0, np.uint64)
    ahead = np.where(size < 8, ahead & ((np.uint64(1) << (size * np.uint64(8) % np.uint64(64))) - np.uint64(1)), ahead)
    second = ahead ^ ((ends - starts).astype(np.uint64) * np.uint64(_PRIME))
    return key, second, np.searchsorted(starts, offsets)


def _words(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of both keys."""
    x = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
    return (x ^ (x >> np.uint64(32))) * np.uint64(_PRIME)


@dataclass
class Phrases:
    """All windows of a block of items.  Words are numbered from 1; rows of windows are padded with 0 in front."""

    word: np.ndarray
    key: np.ndarray
    second: np.ndarray
    windows: np.ndarray  # windows x WINDOW numbers of words
    size: np.ndarray
    item_at: np.ndarray  # window i belongs to items[item[item_at[i] : item_at[i + 1]]]
    items: list[str]
    item: np.ndarray


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases | None:
    """Windows of (item_id, text); None if no item has a word."""
    texts = [(t or "").encode() for _, t in items]
    offsets = np.cumsum([0, *map(len, texts)])
    key, second, first = words_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
    if not len(key):
        return None
    word, at, number = np.unique(_words(key, second), return_index=True, return_inverse=True)
    n = np.diff(first)
    size = np.minimum(n, window)
    count = np.where(n > 0, n - size + 1, 0)  # windows of each item
    item = np.repeat(np.arange(len(items)), count)
    begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    place = np.arange(window) - window + size[item, None]
    rows = np.where(place >= 0, number[np.minimum(begin[:, None] + np.maximum(place, 0), len(number) - 1)] + 1, 0)
    windows, of = np.unique(rows, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([of.ravel(), item], axis=1), axis=0)
    return Phrases(
        word, key[at], second[at], windows, (windows > 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)),
        [i if i is None else str(i) for i, _ in items], pairs[:, 1],
    )


def suffix_order(text: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Positions in order of their suffixes; text: ints whose equal stretches are bounded by unique values; order: positions
    in order of their ints, if known.  Doubles the compared length in each round, for the suffixes still tied only."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    order = (np.argsort(text) if order is None else order).astype(kind)
    new = np.ones(n, dtype=bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    rank = np.empty(n, dtype=kind)  # where the ties of a suffix begin
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0))
    h = 1
    while True:
        rows = np.flatnonzero(~(new & np.append(new[1:], True))).astype(kind)
        if not len(rows):
            return order
        tied = order[rows]
        both = rank[tied].astype(np.int64) * (n + 1)
        inside = tied < n - h
        both[inside] += rank[tied[inside] + h] + 1
        at = np.argsort(both)
        order[rows], both = tied[at], both[at]
        new[rows] = np.concatenate([[True], both[1:] != both[:-1]])
        rank[order[rows]] = np.maximum.accumulate(np.where(new[rows], rows, 0))
        h *= 2


class _Bits:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.total = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    """Over text: symbols from 1; 0 ends a block (these are told apart by their place)."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE, order: np.ndarray | None = None):
        ends = np.flatnonzero(text == 0)
        told = text.astype(np.int32) + np.int32(len(ends))
        told[ends] = np.arange(len(ends))
        order = suffix_order(told, order)
        del told
        self.n = len(text)
        bwt = text[order - 1].astype(np.int32)  # the last symbol is 0, and so is the one before position 0
        # Sampled suffix positions: every sample-th, and each block's first (no walk leaves its block).
        kept = (order % sample == 0) | (bwt == 0)
        self.kept, self.position = _Bits(kept), order[kept].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # The wavelet matrix: for each bit, from the highest, where zeros stand; then zeros before ones.
        self.levels = []
        for bit in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            zero = (bwt >> bit) & 1 == 0
            self.levels.append((bit, _Bits(zero)))
            bwt = np.concatenate([bwt[zero], bwt[~zero]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of symbol stand before place."""
        at, begin = place, np.zeros_like(place)
        for bit, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            za, zb = zeros.rank(at), zeros.rank(begin)
            at, begin = np.where(one, zeros.total + at - za, za), np.where(one, zeros.total + begin - zb, zb)
        return at - begin

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros_like(place), place
        for bit, zeros in self.levels:
            one = ~zeros.at(at)
            za = zeros.rank(at)
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros.total + at - za, za)
        return symbol

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of symbol rows padded with 0 in front: the rows found, and their ranges of suffixes."""
        alive = np.arange(len(windows))
        low, high = self.first[windows[:, -1]], self.first[windows[:, -1] + 1]
        for k in range(windows.shape[1] - 2, -1, -1):
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            symbol = windows[alive, k]
            more = symbol > 0
            s = symbol[more]
            low[more] = self.first[s] + self.rank(s, low[more])
            high[more] = self.first[s] + self.rank(s, high[more])
        keep = low < high
        return alive[keep], low[keep], high[keep]

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        out, steps, at, index = np.zeros_like(place), 0, place.copy(), np.arange(len(place))
        while len(index):
            done = self.kept.at(at)
            out[index[done]] = self.position[self.kept.rank(at[done])] + steps
            index, at = index[~done], at[~done]
            symbol = self.symbol_at(at)
            at = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return out


class Shard:
    """Texts in order, added one batch after the other; build() makes their index, hits(p) searches it for a block of phrases."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_words: list[np.ndarray] = []
        self.n_docs = self.size = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        key, second, first = words_of(data, offsets)
        self.parts.append((key, second))
        self.n_words.append(np.diff(first))
        self.n_docs += len(offsets) - 1
        self.size += len(data)

    def build(self, block: int = BLOCK, overlap: int = WINDOW - 1) -> None:
        self.key, self.second = (np.concatenate([p[k] for p in self.parts]) for k in range(2))
        self.parts = []
        n = np.concatenate(self.n_words)
        self.first = np.concatenate([[0], np.cumsum(n)])
        # Blocks of a text: each has its own words, those of the next one that a window may reach, and an end.
        blocks = np.where(n > 0, np.maximum(1, -(-(n - overlap) // block)), 0)
        number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(self.first[:-1], blocks) + number * block
        size = np.minimum(np.repeat(self.first[1:], blocks) - begin, block + overlap) + 1
        # The number of each place's word.
        self.word = np.arange(size.sum(), dtype=np.int32) - np.repeat((np.cumsum(size) - size - begin).astype(np.int32), size)
        ends = np.cumsum(size) - 1
        self.word[ends] = 0
        inside = np.ones(len(self.word), dtype=bool)
        inside[ends] = False
        places = np.flatnonzero(inside).astype(np.int32)
        words = _words(self.key, self.second)[self.word[places]]
        at = np.argsort(words)
        words, places = words[at], places[at]
        del at, inside
        new = np.ones(len(words), dtype=bool)
        new[1:] = words[1:] != words[:-1]
        self.alphabet = words[new]
        del words
        text = np.zeros(len(self.word), dtype=np.int32)
        text[places] = np.cumsum(new)
        self.index = FmIndex(text, len(self.alphabet), order=np.concatenate([ends.astype(np.int32), places])) if len(text) else None

    def hits(self, p: Phrases):
        """document, first word, end word, window of every occurrence."""
        none = np.zeros(0, dtype=np.int64)
        if self.index is None:
            return none, none, none, none
        at = np.minimum(np.searchsorted(self.alphabet, p.word), len(self.alphabet) - 1)
        symbol = np.concatenate([[0], np.where(self.alphabet[at] == p.word, at + 1, 0)])
        there = np.flatnonzero(((symbol[p.windows] > 0) | (p.windows == 0)).all(axis=1))
        row, low, high = self.index.search(symbol[p.windows[there]])
        count = high - low
        place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        start, window = self.word[self.index.locate(place)].astype(np.int64), np.repeat(there[row], count)
        same = np.ones(len(start), dtype=bool)
        for k in range(p.windows.shape[1]):
            number = p.windows[window, k] - 1
            word = np.maximum(start + k - p.windows.shape[1] + p.size[window], 0)
            same &= (number < 0) | ((self.key[word] == p.key[number]) & (self.second[word] == p.second[number]))
        start, window = start[same], window[same]
        doc = np.searchsorted(self.first, start, side="right") - 1
        start = start - self.first[doc]
        return doc, start, start + p.size[window], window


SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
    " spans array<struct<first:int,stop:int>>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))),
])


@functools.lru_cache(maxsize=3)
def _load(path: str) -> Phrases:
    fs, local = filesystem(path)
    with fs.open_input_stream(local) as f:
        return pickle.loads(f.read())


def _report(doc_ids: pa.Array, shard: Shard, blocks: list[str]) -> pa.RecordBatch:
    n = shard.n_docs
    spans: dict[int, list] = {}
    items: dict[int, set[str | None]] = {}
    for block in blocks:
        p = _load(block)
        doc, first, stop, window = shard.hits(p)
        for d, a, b, w in zip(*(x.tolist() for x in (doc, first, stop, window))):
            spans.setdefault(d, []).append((a, b))
            items.setdefault(d, set()).update(p.items[j] for j in p.item[p.item_at[w] : p.item_at[w + 1]])
    merged = {d: merged_ranges(*zip(*sorted(s))) for d, s in spans.items()}
    hit = np.zeros(n, dtype=np.int64)
    for d, s in merged.items():
        hit[d] = sum(b - a for a, b in s)
    none = hashlib.sha256(b"").hexdigest()
    digest = [hashlib.sha256(",".join(sorted(items[d] - {None})).encode()).hexdigest() if d in items else none for d in range(n)]
    return pa.RecordBatch.from_arrays([
        doc_ids.cast(pa.int64()), pa.array(np.concatenate(shard.n_words)), pa.array(hit),
        pa.array([len(items.get(d, ())) for d in range(n)], pa.int64()), pa.array(digest), pa.array(hit > 0),
        pa.array([[{"first": a, "stop": b} for a, b in merged.get(d, ())] for d in range(n)], _ARROW.field("spans").type),
    ], schema=_ARROW)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    """Rows, whose last column is the text, and the index of their words, a shard at a time."""
    shard, held = Shard(), []
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for some in cuts(text, CUT_BYTES):
            texts = text[some].cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            shard.add(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
            held.append(batch[some])
            if shard.size >= SHARD_BYTES:
                shard.build()
                yield held, shard
                shard, held = Shard(), []
    if held:
        shard.build()
        yield held, shard


def _blocks(benchmark: DataFrame, block_items: int) -> list[str]:
    """Files of phrases in the shared folder, each written by a task from a block of items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull())
    r = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    n = max(-(-r.n // block_items), -(-r.size // BLOCK_BYTES))
    folder = scratch(items.sparkSession, "phrases")

    def write(block: pa.Table) -> pa.Table:
        p = phrases(list(zip(block["item_id"].to_pylist(), block["text"].to_pylist())))
        if p is None:
            return pa.table({"path": pa.array([], pa.string())})
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = uuid.uuid4().hex  # the attempt's own: only files that Spark reports are read
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(pickle.dumps(p))
        return pa.table({"path": [f"{folder}/{name}"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    return sorted(r.path for r in dealt.groupBy("block").applyInArrow(write, "path string").collect())  # one path for a block


def contamination(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: the merged ranges of hit words, numbered from 0.  Null and empty texts have no words; items with null
    texts are left out; those with null ids count as one item, which the digest leaves out; an item id on several rows
    counts once; rows are reported each for itself, other
    columns dropped; no items hit nothing.
    """
    blocks = _blocks(benchmark, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _shards(batches):
            yield _report(pa.concat_arrays([b.column(0) for b in held]), shard, blocks)
        give_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs without a hit word, all columns as they were; items without an id count too."""
    blocks = _blocks(benchmark, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, shard in _shards(batches):
            clean = np.ones(shard.n_docs, dtype=bool)
            for block in blocks:
                clean[shard.hits(_load(block))[0]] = False
            at = 0
            for batch in held:
                own = batch.select(range(batch.num_columns - 1))
                yield own.filter(pa.array(clean[at : at + len(own)]))
                at += len(own)
        give_back()

    plain = docs.select("*", F.col("text").cast("string")).toDF(*plain_names(docs), "text")
    return plain.mapInArrow(run, plain.drop("text").schema).toDF(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination(docs, items).drop("spans")


# Windows of documents meet windows of items of the same length; words are numbered from 0.
OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS k,
         array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS g
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, ks WHERE len(words) >= k)),
hits AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""
