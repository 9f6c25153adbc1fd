"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (MAX_TRAIN rows expected, picked by a hash of their ids
at every size alike), on features cut into at most BINS bins.  All trees are complete binary trees of one depth, kept as
flat arrays; scoring walks them for a whole batch at once in numpy.  Statistics are taken from whole texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import crc32_of_id, cuts, give_back, table

#: Expected labelled rows for fitting at most.
MAX_TRAIN = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 5, 90, 0.15, 1.0, 8.0
THRESHOLD = 0.3

# Frequent function words of the languages in view.
_FUNCTION_WORDS = frozenset(
    "the of and to in is that it for was on are with as at be this from have not by an or"
    " der die das und ist nicht ein eine zu den von mit auf für im dem sich des"
    " le la les de des et un une est que qui dans pour pas sur avec en du au"
    " el los las y que se por con una para del no es su lo".split()
)
_MARKS = "!?.,;:#$%&*|<>@{}()[]\"'-_/=+~^"


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text; null and empty texts have all zeros."""
    if not text:
        return [0.0] * N_FEATURES
    data = text.encode()
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(text), len(data)
    words = text.split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    n_words, lengths = max(1, len(words)), np.fromiter(map(len, words), np.int64, len(words))
    bare = text.lower().translate(_DROP).split()
    kinds = Counter(bare)
    top = [n for _, n in kinds.most_common(3)] + [0, 0, 0]
    p = byte[byte > 0] / size
    upper, lower = byte[65:91].sum(), byte[97:123].sum()
    packed = len(zlib.compress(data, 1)) / size
    ends = sum(x.rstrip()[-1] in ".!?\"" for x in full)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(full)),
        lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, float(lengths.max(initial=0)),
        len(kinds) / n_words, len(set(full)) / max(1, len(full)),
        sum(map(len, set(full))) / max(1, sum(map(len, full))), n / max(1, len(lines)), max(map(len, lines)),
        upper / size, lower / size, byte[48:58].sum() / size, byte[128:].sum() / size, byte[32] / size,
        upper / max(1, upper + lower), sum(map(str.isupper, words)) / n_words,
        sum(map(str.istitle, words)) / n_words,
        sum(map(kinds.get, _FUNCTION_WORDS & kinds.keys())) / n_words, len(_FUNCTION_WORDS & kinds.keys()),
        top[0] / n_words, top[1] / n_words, top[2] / n_words,
        -(p * np.log2(p)).sum(), packed, ends / max(1, len(full)), text.count("http") / n_words,
        (text.count("***") + text.count("$$$") + text.count("!!")) / n_words, text.count("<") / n_words,
        sum(x.lstrip()[0] in "-*•|" for x in full) / max(1, len(full)), text.count(" | ") / n_words,
        text.count("...") / n_words, text.count("�") / size,
        *(byte[ord(c)] / size for c in _MARKS),
    ]


_DROP = {ord(c): " " for c in _MARKS}
N_FEATURES = 34 + len(_MARKS)


def features(texts) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts], dtype=np.float32).reshape(-1, N_FEATURES)


@dataclass
class Trees:
    """feature and cut: one row per tree, inner nodes in level order; leaf: one row per tree; a row x goes right at a
    node if x[feature] > cut."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, feature[at]] > cut[at])
            total += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosts trees on log loss.  No rows give a score of 0.5 everywhere, one class its smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, n_f = 2**depth - 1, x.shape[1]
    feature = np.zeros((trees, inner), dtype=np.int64)
    cut = np.full((trees, inner), np.inf, dtype=np.float32)
    leaf = np.zeros((trees, inner + 1))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, depth, feature, cut, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(n_f)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(n_f) * bins
    f_now = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f_now))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            n_nodes, first = 2**level, 2**level - 1
            where = (flat + ((at - first) * n_f * bins)[:, None]).ravel()
            shape = (n_nodes, n_f, bins)
            hg = np.bincount(where, np.repeat(g, n_f), n_nodes * n_f * bins).reshape(shape).cumsum(axis=2)
            hh = np.bincount(where, np.repeat(h, n_f), n_nodes * n_f * bins).reshape(shape).cumsum(axis=2)
            ag, ah = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + L2) + (ag - hg) ** 2 / (ah - hh + L2) - ag**2 / (ah + L2)
            gain[(hh < LEAST / 4) | (ah - hh < LEAST / 4)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            best = gain.reshape(n_nodes, -1).argmax(axis=1)
            for node in range(n_nodes):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-6:
                    feature[t, first + node], cut[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t][at]] > cut[t][at])
        at -= inner
        sg, sh = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf[t] = -RATE * sg / (sh + L2)
        f_now += leaf[t][at]
    return Trees(base, depth, feature, cut, leaf)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text").to_pylist())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fits on labels(doc_id, quality 0/1) whose crc32(doc_id) mod 5 is not 0, about max_train of them at most.

    Null labels and ids are left out; a document labelled twice counts with its larger label, and of rows that share an id the
    one with the smallest hash of its text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (crc32_of_id(F.col("doc_id")) % 5 != 0))
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # Bounded by max_train, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("r"))
    got = one.select("doc_id", "y", "r.text").mapInArrow(_features_of, "doc_id long, y int, x array<float>").toPandas()
    got = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["doc_id", "key"])
    x = np.array(got["x"].tolist(), dtype=np.float32).reshape(-1, N_FEATURES)
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def classify(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted.  Rows with null ids are never held out."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # a few hundred KB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            score = [shared.value.score(features(texts[some].to_pylist())) for some in cuts(texts)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate([np.zeros(0), *score]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])
        give_back()

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    scored = picked.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = [shared.value.score(features(text[some].to_pylist())) for some in cuts(text)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0), *out]))

    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
