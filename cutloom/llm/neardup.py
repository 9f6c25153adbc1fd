"""Near-duplicates: chosen-path set similarity join over word shingles, confirmed on full sets.

1. Every text becomes the set of its 5-word shingles (64-bit hashes) and a sketch of SIZE minwise tokens; documents with
   equal sets form a class and are represented by their smallest doc_id.
2. Independent trees, as many as a target recall takes: a node of a tree is chosen by a path of (coordinate, token) pairs.  At every node a hash of
   the path picks the coordinates to branch by, 1/threshold of them on average, so that a pair at the threshold is
   expected to share one child.  Paths start two levels deep; nodes with one class end at once.
3. In a node every class is compared with the node's smallest one, by sketches, with a margin below the threshold.  If
   all match, the node is one loose component and ends.  Else small nodes are compared exhaustively, and large ones,
   unless other links already connect all their classes, branch again.  The work is linear in the rows of a node, and no pairs within a large node are emitted.
4. Large loose components are told apart once more by trees over sketches of LONG tokens, whose margin is a third as wide.
5. Loose components are confirmed on full shingle sets, rebuilt from whole texts: small ones in one task each, large
   ones in blocks that share pivots; classes that pivots don't reach are compared with all blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, give_back, staged, table
from cutloom.llm.components import components

SHINGLE = 5
SIZE = 128
#: Target for a pair at the threshold to meet in some tree's node DEEP levels down, where most nodes have ended.
RECALL = 0.9999
#: Nodes up to this size are compared exhaustively when their smallest class doesn't match all.
LEAF, DEEP_LEAF, DEEP = 2048, 4096, 6
#: Standard deviations of the sketches' estimate below the threshold that still count as a loose match.
MARGIN = 4.7
#: Tokens of the sketches that tell large loose components apart once more.
LONG = 1024
#: Loose components with more shingles or classes are confirmed in blocks of about so many, which share so many pivots.
BLOCK_SHINGLES, BLOCK_CLASSES, PIVOTS = 500_000, 2048, 8

_U = np.uint64
_SPACE = np.ones(256, dtype=np.uint8)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = 0
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_PRIME = 0x9E3779B97F4A7C15
_A = None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _A
    if _A is None or len(_A[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _PRIME, dtype=np.uint64), np.full(size, pow(_PRIME, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _A = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _A


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of one text's bytes, in order."""
    inside = np.concatenate([[0], _SPACE[data], [0]]).astype(np.int8)
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words has one, one without words none."""
    data = text.encode() if isinstance(text, str) else text or b""
    w = word_hashes(np.frombuffer(data, np.uint8))
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, _U(k))
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j]
    return np.unique(_mix(h))


def sketch(s: np.ndarray, size: int = SIZE) -> np.ndarray:
    """size minwise tokens of 16 bits of a non-empty set."""
    a, low = _mix(np.arange(1, size + 1, dtype=np.uint64) * _U(_PRIME)) | _U(1), None
    step = 512 * SIZE // size
    for i in range(0, len(s), step):
        m = (s[i : i + step, None] * a).min(axis=0)
        low = m if low is None else np.minimum(low, m)
    return (_mix(low) >> _U(48)).astype(np.uint16)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sketches = [], [], []
            for some in cuts(batch.column("text")):
                for text in batch.column("text")[some].cast(pa.binary()).to_pylist():
                    s = shingles(text, size)
                    n.append(len(s))
                    digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    sketches.append(sketch(s).tobytes() if len(s) else None)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "digest", "sketch"])
        give_back()

    return run


def trees(threshold: float, recall: float = RECALL, depth: int = DEEP) -> int:
    """Trees that a pair at the threshold needs to share a node at so many levels in one of them with a chance of recall.

    A node has one child, and a second with a chance of 1 / threshold - 1; the pair shares each with a chance of threshold."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - (1 - threshold * meets) * (1 - (1 / threshold - 1) * threshold * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def _children(path: np.ndarray, sketches: np.ndarray, row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down: paths and rows of the children of nodes given by path, for the sketches in rows."""
    out_path, out_row = [], []
    second = _mix(path + _U(11)).astype(np.float64) / 2**64 < 1 / threshold - 1
    for salt, some in ((1, np.ones(len(path), dtype=bool)), (2, second)):
        p, r = path[some], row[some]
        at = _mix(p * _U(3) + _U(salt)) % _U(sketches.shape[1])
        token = sketches[r, at.astype(np.int64)].astype(np.uint64)
        out_path.append(_mix(p ^ _mix((at << _U(16)) + token + _U(salt << 40))))
        out_row.append(r)
    return np.concatenate(out_path), np.concatenate(out_row)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _first_paths(threshold: float, levels: int = 2):
    n_trees = trees(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            s, n = _matrix(batch["sketch"]), len(batch)
            path = np.repeat(_mix(np.arange(1, n_trees + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)), n)
            row = np.tile(np.arange(n), n_trees)
            for _ in range(levels):
                path, row = _children(path, s, row, threshold)
            both = pd.DataFrame({"path": path.view(np.int64), "rep": batch["rep"].to_numpy()[row]}).drop_duplicates()
            for i in range(0, len(both), 200_000):
                yield both.iloc[i : i + 200_000]

    return run


def _next_paths(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                path, row = _children(batch["path"].to_numpy().view(np.uint64), _matrix(batch["sketch"]), np.arange(len(batch)), threshold)
                yield pd.DataFrame({"path": path.view(np.int64), "rep": batch["rep"].to_numpy()[row]})

    return run


def loose(threshold: float, size: int = SIZE) -> int:
    """Equal tokens of two sketches that count as a loose match."""
    return int(size * threshold - MARGIN * (size * threshold * (1 - threshold)) ** 0.5)


def _matches(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                same = (_matrix(batch["s1"]) == _matrix(batch["s2"])).sum(axis=1)
                yield pd.DataFrame({"rep": batch["rep"], "pivot": batch["pivot"], "linked": same >= least})

    return run


class Parts:
    """Parts of 0..n-1; a part is named by its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = sorted((int(self.label[i]), int(self.label[j])))
        if a != b:
            self.label[self.label == b] = a

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.label[i] != self.label[j])

    def stars(self, names: np.ndarray) -> tuple[list[int], list[int]]:
        """Links of every member with the smallest of its part."""
        rest = np.flatnonzero(self.label != np.arange(len(self.label)))
        return names[rest].tolist(), names[self.label[rest]].tolist()


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys from batches that are sorted by them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(batch)]])
        for a, b in zip(cut[:-1], cut[1:]):
            part = batch.iloc[a:b]
            if held and (held[0][keys].iloc[0].to_numpy() != k[a]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _similar(s: np.ndarray, least: int, rows: range | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j with at least so many equal tokens, and how many: a stretch of rows at a time."""
    for i in range(len(s) - 1) if rows is None else rows:
        same = (s[i + 1 :] == s[i]).sum(axis=1)
        j = np.flatnonzero(same >= least)
        if len(j):
            yield np.full(len(j), i), j + i + 1, same[j]


def _linking(link, keys: list[str]):
    """Edges that link(group) finds in each group of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for group in _groups(batches, keys):
            more_u, more_v = link(group)
            u += more_u
            v += more_v
            if len(u) >= 100_000:
                yield pd.DataFrame({"u": u, "v": v})
                u, v = [], []
        yield pd.DataFrame({"u": pd.array(u, "int64"), "v": pd.array(v, "int64")})

    return run


def _exhaustive(least: int):
    """All classes of a node against each other, by sketches."""

    def link(group: pd.DataFrame):
        s, parts = _matrix(group["sketch"]), Parts(len(group))
        for i, j, _ in _similar(s, least):
            for k in j[parts.apart(i, j)].tolist():
                parts.join(int(i[0]), k)
        return parts.stars(group["rep"].to_numpy())

    return _linking(link, ["path"])


def _with_sketch(rows: DataFrame, reps: DataFrame, key: str, name: str) -> DataFrame:
    side = reps.select(F.col("rep").alias("_rep"), F.col("sketch").alias(name))
    return rows.join(side, F.col(key) == F.col("_rep")).drop("_rep")


def _sizes(rows: DataFrame, limit: int):
    return rows.agg(F.count_if(F.col("size") <= limit).alias("small"), F.count_if(F.col("size") > limit).alias("large")).first()


def loose_edges(reps: DataFrame, threshold: float, size: int = SIZE) -> DataFrame:
    """reps(rep, sketch of size tokens) -> edges(u, v) whose components hold all pairs at the threshold (with the trees'
    recall)."""
    least = loose(threshold, size)
    paths = staged(reps.select("rep", "sketch").mapInPandas(_first_paths(threshold), "path long, rep long"), "paths")
    found = None
    # Every level draws new coordinates, so unlike classes part sooner or later and the loop ends.
    for depth in itertools.count(2):
        # Nodes of two classes at least, with their size and smallest class; written, so that Spark may split hot paths.
        nodes = paths.groupBy("path").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).filter("size > 1")
        nodes = staged(nodes.select(F.col("path").alias("_path"), "size", "pivot"), "nodes")
        members = staged(paths.join(nodes, F.col("path") == F.col("_path")).drop("_path"), "members")
        pairs = members.filter("rep <> pivot").select("rep", "pivot").distinct()
        both = _with_sketch(_with_sketch(pairs, reps, "rep", "s1"), reps, "pivot", "s2")
        tested = staged(both.mapInPandas(_matches(least), "rep long, pivot long, linked boolean"), "tested")
        edges = tested.filter("linked").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
        found = edges if found is None else found.union(edges)
        if depth % 8 == 0:
            found = staged(found, "found")
        failed = tested.filter("not linked").select(F.col("rep").alias("_rep"), F.col("pivot").alias("_pivot"))
        open_paths = members.join(failed, (F.col("rep") == F.col("_rep")) & (F.col("pivot") == F.col("_pivot"))).select(F.col("path").alias("_path"))
        open_paths = staged(open_paths.distinct(), "open-paths")
        rest = staged(members.join(open_paths, F.col("path") == F.col("_path")).select("path", "rep", "size").filter("size > 2"), "open")
        # Far down, where little parts any more, larger and larger nodes are compared exhaustively.
        limit = LEAF if depth < DEEP else DEEP_LEAF << max(0, depth - 2 * DEEP) // 3
        counts = _sizes(rest, limit)
        if counts.large:  # large nodes whose classes other links already connect need no more work
            labels = components(found).withColumnRenamed("node", "_node")
            named = rest.join(labels, F.col("rep") == F.col("_node"), "left").withColumn("label", F.coalesce("component", "rep"))
            several = named.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
            rest = staged(rest.join(several.select(F.col("path").alias("_path")), F.col("path") == F.col("_path")).drop("_path"), "open")
            counts = _sizes(rest, limit)
        if counts.small:
            small = _with_sketch(rest.filter(F.col("size") <= limit), reps, "rep", "sketch").select("path", "rep", "sketch")
            dealt = small.repartition("path").sortWithinPartitions("path", "rep")
            found = found.union(staged(dealt.mapInPandas(_exhaustive(least), "u long, v long"), "leaf-edges"))
        if not counts.large:
            return found
        large = _with_sketch(rest.filter(F.col("size") > limit), reps, "rep", "sketch").select("path", "rep", "sketch")
        paths = staged(large.mapInPandas(_next_paths(threshold), "path long, rep long").distinct(), "paths")


def _linked(a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether share[1] * intersection >= share[0] * union, on sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if share[1] * len(a) < share[0] * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def _confirm(share: tuple[int, int], size: int):
    """Exact links in groups of (component, block, chunk): among all rows, or (chunk >= 0) between queries and others."""
    least = loose(share[0] / share[1])

    def link(group: pd.DataFrame):
        sets, parts = [shingles(t, size) for t in group["text"]], Parts(len(group))
        for same in group.groupby("label", sort=False).indices.values():
            for k in same[1:]:
                parts.join(int(same[0]), int(k))
        if len(sets) <= 8:
            i, j = np.triu_indices(len(sets), 1)
        else:  # the most similar first, so that few pairs are left to confirm
            found = list(_similar(np.stack([sketch(x) for x in sets]), least))
            i, j, same = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((3, 0), dtype=np.int64)
            order = np.argsort(-same, kind="stable")
            i, j = i[order], j[order]
        if group["chunk"].iloc[0] >= 0:
            asked = group["query"].to_numpy()
            i, j = i[asked[i] | asked[j]], j[asked[i] | asked[j]]
        for at in range(0, len(i), 512):
            x, y = i[at : at + 512], j[at : at + 512]
            for k in parts.apart(x, y).tolist():
                a, b = int(x[k]), int(y[k])
                if parts.label[a] != parts.label[b] and _linked(sets[a], sets[b], share):
                    parts.join(a, b)
        return parts.stars(group["rep"].to_numpy())

    return _linking(link, ["component", "block", "chunk"])


def _long_sketches(shingle: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in cuts(batch.column("text")):
                texts = batch.column("text")[some].cast(pa.binary()).to_pylist()
                sketches = pa.array([sketch(shingles(t, shingle), size).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep")[some], sketches], names=["rep", "sketch"])
        give_back()

    return run


def _blocks_of(labelled: DataFrame) -> DataFrame:
    """Adds blocks: in how many each component of labelled(rep, n, component) is confirmed."""
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int")
    weights = labelled.groupBy("component").agg(blocks.alias("blocks")).select(F.col("component").alias("_component"), "blocks")
    return labelled.join(weights, F.col("component") == F.col("_component")).drop("_component")


def _refined(docs: DataFrame, labelled: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """labelled(rep, n, component, blocks) with components of several blocks told apart anew, by trees over sketches of LONG
    tokens: what only likeness below the threshold has chained together parts there, without comparing all of it."""
    large = labelled.filter("blocks > 1")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    sub = large.join(texts, F.col("rep") == F.col("_doc")).select("rep", "text").mapInArrow(_long_sketches(shingle, LONG), "rep long, sketch binary")
    found = components(loose_edges(staged(sub, "long-sketches"), threshold, LONG))
    parts = large.select("rep", "n").join(found.select(F.col("node").alias("_node"), "component"), F.col("rep") == F.col("_node")).drop("_node")
    return labelled.filter("blocks = 1").unionByName(_blocks_of(parts))


def _dealt(rows: DataFrame) -> DataFrame:
    keys = ["component", "block", "chunk"]
    return rows.select(*keys, "rep", "label", "query", "text").repartition(*keys).sortWithinPartitions(*keys, "rep")


def exact_components(docs: DataFrame, reps: DataFrame, loose_labels: DataFrame, share: tuple[int, int], size: int) -> DataFrame:
    """node, component over links confirmed on full sets, within loose components(node, component)."""
    labelled = reps.select("rep", "n").join(loose_labels.withColumnRenamed("node", "_node"), F.col("rep") == F.col("_node")).drop("_node")
    labelled = staged(_blocks_of(labelled), "labelled")
    if not labelled.filter("blocks > 1").isEmpty():
        labelled = _refined(docs, labelled, share[0] / share[1], size)
    labelled = labelled.select("rep", "component", "blocks")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")
    rows = staged(labelled.join(texts, F.col("rep") == F.col("_doc")).drop("_doc").withColumn("key", F.xxhash64("rep")), "confirm")
    own = rows.withColumn("block", F.pmod("key", F.col("blocks")).cast("int"))
    # Pivots: in a large component a few classes, picked by hash, stand in all its blocks.
    share_of_keys = F.lit(PIVOTS * (1 << 30)) / F.col("blocks") / F.lit(BLOCK_CLASSES // 8)
    is_pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share_of_keys)
    pivots = rows.filter(is_pivot).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pivots = pivots.filter(F.col("block") != F.pmod("key", F.col("blocks")))
    plain = own.unionByName(pivots).select("*", F.lit(-1).alias("chunk"), F.col("rep").alias("label"), F.lit(False).alias("query"))
    edges = staged(_dealt(plain).mapInPandas(_confirm(share, size), "u long, v long"), "exact-edges")
    labels = staged(components(edges), "exact")
    large = own.filter("blocks > 1")
    if large.select("rep").isEmpty():
        return labels
    # In a large component all classes outside its largest part are compared with all of its blocks.
    named = large.join(labels.select(F.col("node").alias("_node"), F.col("component").alias("_label")), F.col("rep") == F.col("_node"), "left")
    named = named.withColumn("label", F.coalesce("_label", "rep")).drop("_node", "_label")
    parts = named.groupBy("component", "label").count()
    largest = parts.groupBy("component").agg(F.max(F.struct("count", "label")).alias("top"))
    largest = largest.select(F.col("component").alias("_component"), F.col("top.label").alias("main"))
    named = staged(named.join(largest, F.col("component") == F.col("_component")).drop("_component"), "named")
    left = named.filter(F.col("label") != F.col("main"))
    chunks = left.groupBy("component").agg(F.ceil(F.sum(F.octet_length("text")) / (6 * BLOCK_SHINGLES)).cast("int").alias("chunks"))
    chunks = chunks.select(F.col("component").alias("_component"), "chunks")
    if left.select("rep").isEmpty():
        return labels
    joined = named.join(chunks, F.col("component") == F.col("_component")).drop("_component")
    others = joined.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("query", F.lit(False))
    queries = joined.filter(F.col("label") != F.col("main")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    more = staged(_dealt(others.unionByName(queries)).mapInPandas(_confirm(share, size), "u long, v long"), "exact-edges")
    return staged(components(edges.union(more)), "exact")


def near_duplicates(docs: DataFrame, share: tuple[int, int] = (80, 100), size: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; links: share[1] * intersection >= share[0] * union.

    Null texts and texts without words link with nothing and are kept.  Rows with null ids get a null component and are
    kept.  Rows that share a doc_id count as one document for linking.  Other columns are dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = staged(docs.mapInArrow(_sketches(size), "doc_id long, n long, digest binary, sketch binary"), "sketches")
    known = seen.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "sketch", "n")).alias("r"), F.count("*").alias("copies"))
    reps = staged(classes.select("digest", "copies", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.sketch").alias("sketch")), "reps")
    threshold = share[0] / share[1]
    loose_labels = staged(components(loose_edges(reps, threshold)), "loose")
    exact = exact_components(docs, reps, loose_labels, share, size)
    # Only classes of several documents, or linked with another class, have a component other than their own document.
    named = reps.select("digest", "rep", "copies").join(exact, F.col("rep") == F.col("node"), "left")
    named = named.filter("copies > 1 or node is not null").select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("_component"))
    out = seen.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), (85, 100))
