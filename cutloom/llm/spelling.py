"""Spelling variants: words that one edit tells apart, found in a trie of frequency vectors.

1. Tasks count the words of whole texts; Spark adds up the counts of distinct words.
2. Letters are dealt into GROUPS groups of about equal frequency, and a word becomes the numbers of its letters in each
   group.  A trie arranges words by these numbers, a level a group.
3. One edit adds a letter to a group, takes one from a group, or both.  So a depth-first search that may spend a surplus of
   one and a deficit of one on its way down meets all words that one edit leads to, and few others; leaves are verified.
4. The trie is spread: nodes over LEAF words are cut at their next level, the others are one group of a Spark job each.
   Every word is sent to the groups that its searches lead to, and each pair is found in the group of its second word.
   A full path over LEAF words is dealt into several groups.  Only nodes over LEAF words, GROUPS * words / LEAF at most,
   come to the driver.
5. A word's form is its most frequent near word if that is at least twice as frequent; roots follow by pointer doubling,
   where the doubling of frequencies bounds the rounds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, give_back, staged, table

GROUPS, LEAF = 10, 20_000
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: One occurrence in about so many loses a letter.
NOISE = 97
#: Letters with a group of their own choosing; rarer ones follow from their code points.
LETTERS = 4096
#: Distinct words that a task holds before it hands them on, bytes of a text that it cuts into words at a time.
HELD, STRETCH = 500_000, 4_000_000
#: Longer words are compared one by one.
WIDE = 48
#: Pairs verified at a time, and places of a level of the trie that are looked up without a search.
PAIRS, DENSE = 200_000, 2_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# After lower-casing; U+00C0 to U+00FF are C3 80 to C3 BF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def _runs(text: bytes) -> Iterator[Counter]:
    """Counts of the lower-cased runs of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > STRETCH:
            found = _BREAK.search(text, at + STRETCH)
            stop = found.start() if found else stop
        yield Counter(_RUN.findall(text[at:stop].translate(_LOWER)))
        at = stop


def _damaged(run: bytes, h: int) -> bytes:
    letters = run.decode()
    p = h % len(letters)
    return (letters[:p] + letters[p + 1 :]).encode()


def _counts(batches: Iterator[pa.RecordBatch], noise: int, least: int) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for some in cuts(texts, STRETCH):
            for doc_id, text in zip(ids[some].to_pylist(), texts[some].cast(pa.binary()).to_pylist()):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for counts in _runs(text or b""):
                    for run, n in counts.items():
                        if len(run) < least:  # bytes, of which there are at least as many as letters
                            continue
                        if noise and (h := zlib.crc32(run, start)) % noise == 0:
                            run = _damaged(run, h)
                        total[run] = total.get(run, 0) + n
                    if len(total) > HELD:
                        yield rows()
    yield rows()
    give_back()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """docs(doc_id, text) -> word, n of the words with at least so many letters and occurrences.

    A word is a run of Latin letters, A-Z lower-cased.  With noise, a run whose crc32 with its doc_id is divisible by it
    loses a letter first; 0 leaves all as they are.  Null texts have no words; a null id counts as no letters before the
    colon; repeated rows count each."""
    picked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = picked.mapInArrow(lambda b: _counts(b, noise, least_length), "word string, n long").filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[int, int]:
    """The group of every frequent letter: most frequent first, each to the group with the fewest so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    held, out = [0] * groups, {}
    for r in letters.orderBy(F.desc("n"), "c").limit(LETTERS).collect():
        g = held.index(min(held))
        out[ord(r.c)] = g
        held[g] += r.n
    return out


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the lengths of the words."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


def vectors(words: list[str], groups: dict[int, int], n: int = GROUPS) -> np.ndarray:
    """The numbers of letters in each group, a row a word."""
    points, size = _points(words)
    of = np.arange(0x110000) % n
    of[list(groups)] = list(groups.values())
    place = np.repeat(np.arange(len(words)), size) * n + of[points]
    return np.bincount(place, minlength=len(words) * n).reshape(-1, n)


class Trie:
    """Rows of numbers arranged by their columns; a node's children by number."""

    def __init__(self, rows: np.ndarray):
        self.order = np.lexsort(rows.T[::-1])
        self.rows = rows[self.order]
        changed, node = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=np.int64)
        changed[:1] = True
        self.levels = []  # a level's branches, the keys of its nodes (the parent's number and the branch), and what a key leads to
        for column in self.rows.T:
            changed[1:] |= column[1:] != column[:-1]
            wide = int(column.max(initial=0)) + 1
            keys = node[changed] * wide + column[changed]
            table = None
            if len(keys) and (node[-1] + 1) * wide <= DENSE:
                table = np.full((node[-1] + 1) * wide, -1, dtype=np.int32)
                table[keys] = np.arange(len(keys))
            self.levels.append((wide, keys, table))
            node = np.cumsum(changed) - 1
        self.begin = np.append(np.flatnonzero(changed), len(rows))

    def child(self, level: int, node: np.ndarray, branch: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        wide, keys, table = self.levels[level]
        key, inside = node * wide + branch, (branch >= 0) & (branch < wide)
        if table is not None:
            return np.where(inside, table[np.where(inside, key, 0)], -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & inside, at, -1)

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, row) that differ by a surplus of one and a deficit of one at most, each once."""
        if not len(self.rows):
            return
        for query, leaf in _walk(queries, self.child, 0, np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), 1, 1):
            n = self.begin[leaf + 1] - self.begin[leaf]
            for cut in _slices(n):
                q, first, size = query[cut], self.begin[leaf[cut]], n[cut]
                place = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
                yield np.repeat(q, size), self.order[place]


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Slices of about PAIRS in sum."""
    total, at, before = np.cumsum(n), 0, 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        yield slice(at, stop)
        at, before = stop, int(total[stop - 1])


def _walk(queries: np.ndarray, child: Callable, level: int, query: np.ndarray, node: np.ndarray, surplus: int, deficit: int):
    """Depth-first over the ways to spend the budget, for all queries that still have a node; yields queries and leaves."""
    if level == queries.shape[1]:
        yield query, node
        return
    for more in (0, 1, -1):
        if more == 1 and not surplus or more == -1 and not deficit:
            continue
        found = child(level, node, queries[query, level] + more)
        there = found >= 0
        if there.any():
            yield from _walk(queries, child, level + 1, query[there], found[there], surplus - (more == 1), deficit - (more == -1))


class Top:
    """The nodes of the whole trie with more than leaf words; what hangs below them are groups, named by numbers."""

    def __init__(self, big: dict[tuple, int], leaf: int):
        self.number = {p: i for i, p in enumerate(sorted(big))}
        self.parts = [-(-big[p] // leaf) for p in sorted(big)]
        self.wide = max((max(p, default=0) for p in big), default=0) + 1
        keys = {self.number[p[:-1]] * self.wide + p[-1]: i for p, i in self.number.items() if p}
        self.keys = np.array(sorted(keys), dtype=np.int64)
        self.nodes = np.array([keys[k] for k in self.keys.tolist()], dtype=np.int64)

    def groups(self, rows: np.ndarray, salt: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, group): those that a search with the budget leads to, or with none its own."""
        if not self.number:
            return np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def child(level, node, branch):
            key = node * self.wide + branch
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            big = (branch >= 0) & (branch < self.wide) & ((self.keys[at] == key) if len(self.keys) else False)
            return np.where(big, self.nodes[at] if len(self.nodes) else -1, -1)

        def walk(level, row, node, surplus, deficit):
            if level == rows.shape[1]:  # all words here have the same numbers
                n = np.array(self.parts)[node] if budget else np.ones(len(node), dtype=np.int64)
                part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if budget else salt[row] % np.array(self.parts)[node]
                out.append((np.repeat(row, n), -1 - (np.repeat(node, n) << 20) - part))
                return
            for more in (0, 1, -1):
                if more == 1 and not surplus or more == -1 and not deficit:
                    continue
                branch = rows[row, level] + more
                found = child(level, node, branch)
                small = (found < 0) & (branch >= 0)
                out.append((row[small], (node[small] << 32) + branch[small] + 1))
                if (found >= 0).any():
                    walk(level + 1, row[found >= 0], found[found >= 0], surplus - (more == 1), deficit - (more == -1))

        walk(0, np.arange(len(rows)), np.full(len(rows), self.number[()]), budget, budget)
        return tuple(np.concatenate(x) for x in zip(*out))

    def homes(self, rows: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The group in which each row stands."""
        row, group = self.groups(rows, salt, 0)
        return group[np.argsort(row)]


def _prefixes(batches: Iterator[pa.RecordBatch], groups: dict[int, int], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = vectors(batch.column("word").to_pylist(), groups, n)
        rows = rows[np.lexsort(rows.T[::-1])]
        changed = np.zeros(len(rows), dtype=bool)
        changed[:1] = True
        out = [("", len(rows))]
        for level in range(n):
            changed[1:] |= rows[1:, level] != rows[:-1, level]
            begin = np.flatnonzero(changed)
            out += zip([",".join(map(str, r)) for r in rows[begin, : level + 1].tolist()], np.diff(np.append(begin, len(rows))).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["prefix", "n"])


def top(words: DataFrame, groups: dict[int, int], leaf: int = LEAF, n: int = GROUPS) -> Top:
    """The nodes over leaf words, counted over all words."""
    counted = words.select("word").mapInArrow(lambda b: _prefixes(b, groups, n), "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    big = counted.filter(F.col("n") > leaf).collect()  # n * words / leaf nodes at most
    return Top({tuple(map(int, r.prefix.split(","))) if r.prefix else (): r.n for r in big}, leaf)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return (len(a) == len(b) and p < len(a) and a[p + 1 :] == b[p + 1 :]) or (len(a) + 1 == len(b) and a[p:] == b[p + 1 :])


class Verifier:
    """Tells pairs of words apart by one edit."""

    def __init__(self, words: list[str]):
        self.words = words
        points, self.size = _points(words)
        short = self.size <= WIDE
        values, letter = np.unique(points, return_inverse=True)
        kind = np.uint8 if len(values) < 256 else np.uint32
        # Short words as rows of letters' numbers from 1; behind a word's end and for long words 0.
        self.rows = np.zeros((len(words), int(self.size[short].max(initial=0)) + 1), dtype=kind)
        owner = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        inside = short[owner]
        self.rows[owner[inside], place[inside]] = letter[inside] + 1

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        more = self.size[b] - self.size[a]
        out = np.zeros(len(a), dtype=bool)
        plain = np.flatnonzero((more <= 1) & (self.size[b] <= WIDE))
        wide = int(self.size[b[plain]].max(initial=0)) + 1
        x, y = self.rows[a[plain], :wide], self.rows[b[plain], :wide]
        other = x != y
        replaced = (more[plain] == 0) & (other.sum(axis=1) == 1)
        before = other.argmax(axis=1)[:, None] > np.arange(wide - 1)  # up to the first letter that differs
        shifted = (x[:, :-1] != y[:, 1:]) & ~before & (np.arange(wide - 1) < self.size[a[plain]][:, None])
        out[plain] = replaced | ((more[plain] == 1) & ~shifted.any(axis=1))
        for i in np.flatnonzero((more <= 1) & (self.size[b] > WIDE)).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


_NEAR = "word string, n_near long, best_n long, best string"


def _near_in_group(table: pa.Table, groups: dict[int, int], n: int) -> pa.Table:
    """Near words of all words of a group among the group's own ones."""
    words = table["word"].to_pylist()
    order = sorted(range(len(words)), key=words.__getitem__)  # by code points
    words = [words[i] for i in order]
    times, own = table["n"].to_numpy()[order], np.flatnonzero(table["own"].to_numpy()[order])
    rows, check = vectors(words, groups, n), Verifier(words)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for query, at in Trie(rows[own]).near(rows):
        ok = check.near(query, own[at])
        found.append((query[ok], own[at[ok]]))
    query, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2
    order = np.lexsort((near, -times[near], query))
    query, near = query[order], near[order]
    begin = np.flatnonzero(np.diff(query, prepend=-1))
    best = near[begin]
    give_back()
    return pa.table({
        "word": pa.array([words[q] for q in query[begin]], pa.string()), "n_near": np.diff(np.append(begin, len(query))),
        "best_n": times[best], "best": pa.array([words[b] for b in best], pa.string()),
    })


def near_words(words: DataFrame, leaf: int = LEAF, groups: int = GROUPS) -> DataFrame:
    """words(word, n), each word once -> word, n, n_near, best_n, best: the number of words that one edit leads to, and the
    most frequent of them (ties: the first in code-point order); 0 and nulls if there is none.  words is read several times."""
    letters = letter_groups(words, groups)
    spread = top(words, letters, leaf, groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("word").to_pylist()
            rows, salt = vectors(text, letters, groups), np.array([zlib.crc32(w.encode()) for w in text], dtype=np.int64)
            home = spread.homes(rows, salt)
            row, group = spread.groups(rows, salt, 1)
            yield pa.RecordBatch.from_arrays([pa.array(group), *(c.take(pa.array(row)) for c in batch.columns), pa.array(group == home[row])], names=["group", "word", "n", "own"])

    sent = words.select("word", "n").mapInArrow(send, "group long, word string, n long, own boolean")
    found = sent.groupBy("group").applyInArrow(lambda table: _near_in_group(table, letters, groups), _NEAR)
    found = found.unionByName(words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
    return words.join(out, "word").select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """forms(word, form) without cycles -> word, root, after rounds of pointer doubling: 2^rounds steps."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ahead = out.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = out.join(ahead, F.col("root") == F.col("_word"), "left")
        out = staged(joined.select("word", F.coalesce("_root", "root").alias("root")), "roots")
    return out


def variants(words: DataFrame, factor: int = FACTOR, leaf: int = LEAF, groups: int = GROUPS) -> DataFrame:
    """words(word, n), each word once -> word, form, root, n, n_near, form_n; see op13_spelling."""
    near = near_words(words, leaf, groups)
    good = F.col("best_n") >= factor * F.col("n")
    near = staged(near.withColumns({"form": F.when(good, F.col("best")), "form_n": F.when(good, F.col("best_n"))}).drop("best", "best_n"), "near")
    r = near.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = math.floor(math.log(r.most / r.least, factor) + 1e-9) if r.most else 0  # forms are factor times as frequent each
    found = roots(near.filter(F.col("form").isNotNull()), math.ceil(math.log2(steps)) if steps > 1 else 0)
    return near.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of documents.

    Null and empty texts have no words; no words give no rows; words of one form share their root; see word_counts for
    ids and repeated rows."""
    return variants(staged(word_counts(table(spark, sf_dir, "documents", "doc_id", "text")), "words"))


#: crc32 by its table, near words by deleted letters.
OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM d GROUP BY 1, 2),
b AS (SELECT *, hex(concat(doc_id, ':', w)) AS x FROM r),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM b, t),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS w, n FROM h),
k AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
e AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS cut FROM k, LATERAL (SELECT unnest(range(length(w))) AS i)),
p AS (SELECT a.w, b.w AS x, b.n FROM e a JOIN e b ON a.i = b.i AND a.cut = b.cut AND a.w <> b.w
  UNION SELECT k.w, e.w, e.n FROM k JOIN e ON e.cut = k.w UNION SELECT e.w, k.w, k.n FROM k JOIN e ON e.cut = k.w),
g AS (SELECT w, count(*) AS n_near, first(x ORDER BY n DESC, x) AS x, max(n) AS m FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT k.w, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * k.n THEN x END AS form, CASE WHEN m >= 2 * k.n THEN m END AS form_n FROM k LEFT JOIN g ON g.w = k.w),
c AS (SELECT w, w AS at FROM f UNION ALL SELECT c.w, f.form FROM c JOIN f ON f.w = c.at WHERE f.form IS NOT NULL),
z AS (SELECT c.w, c.at FROM c JOIN f ON f.w = c.at WHERE f.form IS NULL)
SELECT f.w AS word, form, z.at AS root, n, n_near, form_n FROM f JOIN z ON z.w = f.w
"""
