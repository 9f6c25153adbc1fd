"""Language ID: a linear-chain conditional random field labels every word of a text.

Emissions add learned weights of hashed affixes and character n-grams and learned scales of lexicon features (how often
training documents of each language hold the word); transitions are learned from chains that switch language.  Words
get their posterior by forward-backward; a text's language is the one with the largest share of its words' posteriors.
A text is one chain from its first word to its last.  Chains are cut in blocks of BLOCK words whose transfer matrices are
multiplied side by side in numpy; messages pass from block to block, then all blocks are filled in at once, which gives
the same posteriors as one pass over the chain.  A word's emission depends on the word alone, so a bounded cache in each
Python worker keeps it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import crc32_of_id, cuts, give_back, picked, staged, table

#: Expected training documents at most, different chains of TRAIN_CHAIN words taken from all of them together at most (picked
#: by a hash), and characters of such a chain at most (longer ones are cut).
MAX_TRAIN = 1_500
MAX_TRAIN_CHAINS = 20_000
TRAIN_CHAIN = 64
TRAIN_CHARS = 4_000
BLOCK = 64
#: Blocks of one chain or many that are filled in together.
GROUP = 4096
BUCKETS = 1 << 15
EPOCHS, BATCH, RATE = 3, 128, 0.3
CACHE = 150_000
UNKNOWN = "und"
#: Documents below this share of their language are rejected by the filter.
THRESHOLD = 0.4

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of letters."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Grams:
    """Features of words: word i has bucket[begin[i] : begin[i] + count[i]]."""

    bucket: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some words one after the other, and how many each has."""
        return picked(self.bucket, self.begin[words], self.count[words]), self.count[words]


def hashed(words: list[str]) -> Grams:
    """Buckets of each word's prefixes and suffixes (1 to 3 letters) and 2- and 3-grams with its ends marked, over all of its
    letters; words of like lengths are hashed together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = np.where(size <= 22, 24, 1 << np.ceil(np.log2(np.maximum(size, 1) + 2)).astype(np.int64))
    buckets, begin, count, at = [np.zeros(0, np.int64)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        step = max(1, 400_000 // int(w))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            b, n = _hashed([words[i] for i in some.tolist()], int(w))
            buckets.append(b)
            begin[some], count[some] = at + np.cumsum(n) - n, n
            at += len(b)
    return Grams(np.concatenate(buckets), begin, count)


def _hashed(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.array([f"<{w}>" for w in words], dtype=f"U{width}")
    code = wide.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    n = (code != 0).sum(axis=1)
    prime = np.uint64(0x9E3779B97F4A7C15)
    two = (code[:, :-1] * np.uint64(1000003) + code[:, 1:]) * prime
    three = (two[:, :-1] ^ (code[:, 2:] * np.uint64(2654435761))) * prime
    four = (three[:, :-1] ^ (code[:, 3:] * np.uint64(2246822519))) * prime
    at = np.arange(two.shape[1])
    parts = [(two, at[None] + 2 <= n[:, None], 1), (three, at[None, :-1] + 3 <= n[:, None], 2)]
    # Affixes: the 4-grams at both ends, under another salt (shorter ones are the n-grams that hold an end mark).
    row = np.arange(len(words))
    ends = np.stack([four[:, 0], four[row, np.maximum(n - 4, 0)] + np.uint64(7)], axis=1)
    parts.append((ends, np.repeat((n >= 4)[:, None], 2, axis=1), 3))
    bucket = [((h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40)) % np.uint64(BUCKETS) for h, _, salt in parts]
    there = np.concatenate([m for _, m, _ in parts], axis=1)
    return np.concatenate(bucket, axis=1)[there].astype(np.int64), there.sum(axis=1)


@dataclass
class Crf:
    languages: list[str]
    weight: np.ndarray  # BUCKETS x languages
    scale: np.ndarray  # languages: of the lexicon feature
    lexicon: dict[str, np.ndarray]  # centred log odds of known words
    transition: np.ndarray
    start: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": []}

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of each word, from its features."""
        out = np.zeros((len(words), len(self.languages)))
        none = np.zeros(len(self.languages))
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            out[i : i + 8192] = emitted(self.weight, *hashed(part).of(np.arange(len(part)))) + self.scale * np.array([self.lexicon.get(w, none) for w in part])
        return out

    def emissions(self, words: list[str]) -> np.ndarray:
        """Like scores, exponentiated for the chain, with a cache over words."""
        if len(self.cache) > CACHE:
            self.cache, self.rows = {}, []
        new = [w for w in words if w not in self.cache]
        if new:
            e = self.scores(new)
            self.rows.append(np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32))
            at = len(self.cache)
            self.cache.update((w, at + i) for i, w in enumerate(new))
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][[self.cache[w] for w in words]]


def emitted(weight: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each word's sum of its features' weights, over the root of how many they are."""
    return np.add.reduceat(weight[bucket], np.cumsum(count) - count, axis=0) / np.sqrt(count)[:, None] if len(count) else np.zeros((0, weight.shape[1]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def chain_shares(emission: np.ndarray, codes: np.ndarray, n: np.ndarray, a: np.ndarray, start: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Sums of the labels' posteriors for each chain; chain i has n[i] of the codes, which pick rows of emission.  label gets
    the likeliest label of each code.

    Exact for chains of any length: a block's words become one matrix, which carries the forward message from the block before
    and the backward message from the block after."""
    k = emission.shape[1]
    out = np.zeros((len(n), k))
    if not len(codes):
        return out
    blocks = -(-n // BLOCK)
    chain = np.repeat(np.arange(len(n)), blocks)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(n) - n, blocks) + place * BLOCK
    size = np.minimum(BLOCK, np.repeat(n, blocks) - place * BLOCK)
    first = place == 0
    into, back = np.ones((len(chain), k)), np.ones((len(chain), k))
    into[first] = start
    order = np.argsort(-size, kind="stable")  # blocks of like sizes together

    def words(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(int(size[some].max()))[None]
        there = at < size[some, None]
        e = np.ones((*there.shape, k))
        e[there] = emission[codes[(begin[some, None] + at)[there]]]
        return e, there

    if len(n) < len(chain):
        matrix = np.zeros((len(chain), k, k))
        several = order[blocks[chain[order]] > 1]
        for some in (several[i : i + GROUP] for i in range(0, len(several), GROUP)):
            e, there = words(some)
            m = np.where(first[some, None, None], np.eye(k), a) * e[:, 0, None]
            for t in range(1, e.shape[1]):
                m = np.where(there[:, t, None, None], _unit((m @ a) * e[:, t, None]), m)
            matrix[some] = _unit(m)
        top = np.cumsum(blocks)
        for j in range(1, int(blocks.max())):
            ahead = (top - blocks + j)[blocks > j]
            into[ahead] = _unit(np.einsum("bi,bij->bj", into[ahead - 1], matrix[ahead - 1]))
            behind = (top - j)[blocks > j]
            back[behind - 1] = _unit(np.einsum("bij,bj->bi", matrix[behind], back[behind]))
    for some in (order[i : i + GROUP] for i in range(0, len(order), GROUP)):
        e, there = words(some)
        post = _within(e, there, a, np.where(first[some, None], into[some], into[some] @ a), back[some])
        for c in range(k):
            out[:, c] += np.bincount(chain[some], post[:, :, c].sum(axis=1), len(n))
        if label is not None:
            label[(begin[some, None] + np.arange(there.shape[1]))[there]] = post[there].argmax(axis=1)
    return out


def _within(e: np.ndarray, there: np.ndarray, a: np.ndarray, into: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Posteriors in blocks that the message into reaches from the left and back from the right; 0 where no word is."""
    forward = np.zeros(e.shape)
    f = into * e[:, 0]
    forward[:, 0] = f = _unit(f)
    for t in range(1, e.shape[1]):
        f = (f @ a) * e[:, t]
        forward[:, t] = f = _unit(f)
    b = _unit(back)
    for t in range(e.shape[1] - 1, -1, -1):
        forward[:, t] *= b
        b = np.where(there[:, t, None], _unit((e[:, t] * b) @ a.T), b)
    forward /= forward.sum(axis=2, keepdims=True)
    forward[~there] = 0
    return forward


def forward_backward(e: np.ndarray, there: np.ndarray, a: np.ndarray, start: np.ndarray):
    """Posteriors of labels, the normalised forward and backward messages; chains are filled from position 0."""
    n, length, k = e.shape
    forward, back = np.zeros((n, length, k)), np.ones((n, length, k))
    f = start * e[:, 0]
    forward[:, 0] = f = f / f.sum(axis=1, keepdims=True)
    for t in range(1, length):
        f = (f @ a) * e[:, t]
        forward[:, t] = f = f / f.sum(axis=1, keepdims=True)
    b = np.ones((n, k))
    for t in range(length - 2, -1, -1):
        b = np.where(there[:, t + 1, None], (e[:, t + 1] * b) @ a.T, 1.0)
        back[:, t] = b = b / b.sum(axis=1, keepdims=True)
    post = forward * back
    return post / post.sum(axis=2, keepdims=True), forward, back


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Crf:
    """Learns from (text, language) pairs.  Without any word the model knows no language."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    k = len(languages)
    number = {lang: i for i, lang in enumerate(languages)}
    chains = [(w[i : i + TRAIN_CHAIN], number[lang]) for text, lang in texts for w in [words_of(text)] for i in range(0, len(w), TRAIN_CHAIN)]
    if len(chains) > MAX_TRAIN_CHAINS:
        chains = [chains[i] for i in sorted(rng.choice(len(chains), MAX_TRAIN_CHAINS, replace=False))]
    counts = [Counter() for _ in languages]
    for w, y in chains:
        counts[y].update(w)
    model = Crf(languages, np.zeros((BUCKETS, k)), np.ones(k) * 0.5, {}, np.zeros((k, k)), np.zeros(k))
    if k < 2 or not chains:
        return model
    totals = np.array([sum(c.values()) + 1.0 for c in counts])
    # The lexicon: smoothed and clipped log odds, so that it can't decide alone.
    for w in {w for c in counts for w, n in c.items() if n >= 3}:
        odds = np.log((np.array([c[w] for c in counts]) + 0.5) / totals)
        model.lexicon[w] = np.clip(odds - odds.mean(), -3, 3)
    vocabulary = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    names = list(vocabulary)
    grams = hashed(names)
    lexicon = np.array([model.lexicon.get(w, np.zeros(k)) for w in names])
    order, square = np.arange(len(chains)), np.full((BUCKETS, k), 1e-3)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in range(0, len(order), BATCH):
            # Code-switched chains: half of a batch get their tail from another chain.
            batch = [(chains[j][0], [chains[j][1]] * len(chains[j][0])) for j in order[i : i + BATCH]]
            for j in range(0, len(batch) - 1, 2):
                (w1, y1), (w2, y2) = batch[j], batch[j + 1]
                c1, c2 = int(rng.integers(len(w1) + 1)), int(rng.integers(len(w2) + 1))
                batch[j] = ((w1[:c1] + w2[c2:])[:TRAIN_CHAIN] or w1, (y1[:c1] + y2[c2:])[:TRAIN_CHAIN] or y1)
            there = np.zeros((len(batch), TRAIN_CHAIN), dtype=bool)
            word, y = np.zeros(there.shape, dtype=np.int64), np.zeros(there.shape, dtype=np.int64)
            for r, (w, labels) in enumerate(batch):
                there[r, : len(w)], word[r, : len(w)], y[r, : len(w)] = True, [vocabulary[x] for x in w], labels
            used, back_to = np.unique(word[there], return_inverse=True)
            bucket, count = grams.of(used)
            raw = emitted(model.weight, bucket, count) + model.scale * lexicon[used]
            e = np.ones((*there.shape, k))
            e[there] = np.exp(raw - raw.max(axis=1, keepdims=True))[back_to]
            a = np.exp(model.transition)
            post, forward, back = forward_backward(e, there, a, np.exp(model.start))
            truth = np.eye(k)[y]
            error = (post - truth)[there]
            both = there[:, 1:]
            pair = forward[:, :-1, :, None] * a * (e * back)[:, 1:, None, :]
            pair = (pair / pair.sum(axis=(2, 3), keepdims=True))[both].sum(axis=0)
            pair -= np.einsum("nti,ntj->ij", truth[:, :-1] * both[..., None], truth[:, 1:] * both[..., None])
            size = max(1, int(there.sum()))
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, back_to, error)
            scaled = np.repeat(by_word / np.sqrt(count)[:, None], count, axis=0)
            gradient = np.stack([np.bincount(bucket, scaled[:, c], BUCKETS) for c in range(k)], axis=1) / size
            square += gradient**2
            model.weight -= RATE * gradient / np.sqrt(square)
            model.scale -= 0.05 * (by_word * lexicon[used]).sum(axis=0) / size
            model.transition -= 0.5 * pair / size
            model.start -= 0.05 * (post[:, 0] - truth[:, 0]).mean(axis=0)
    return model


def _labelled_words(model: Crf, texts: list[str | None], label: bool = False):
    """For each text its words, how many of them have letters, and the labels' shares; with label, each such word's label."""
    found = [words_of(t) for t in texts]
    count = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array([w for x in found for w in x], pa.large_string()).dictionary_encode()
    values, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    letters = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in values], dtype=bool)
    emission = model.emissions(values) if values else np.zeros((0, len(model.languages)))
    owner = np.repeat(np.arange(len(texts)), count)
    keep = letters[codes] if len(codes) else np.zeros(0, dtype=bool)
    owner, codes = owner[keep], codes[keep]
    n = np.bincount(owner, minlength=len(texts))
    labels = np.zeros(len(codes), dtype=np.int64) if label else None
    share = chain_shares(emission, codes, n, np.exp(model.transition), np.exp(model.start), labels)
    return count, keep, n, share, labels


def label(model: Crf, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and share of each text."""
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, best
    _, _, n, share, _ = _labelled_words(model, texts)
    for i in np.flatnonzero(n):
        j = int(share[i].argmax())
        names[i], best[i] = model.languages[j], min(1.0, share[i, j] / n[i])
    return names, best


def label_spans(model: Crf, texts: list[str | None]) -> list[list[dict]]:
    """Runs of words of one language in each text: first and stop number words as words_of() gives them; words without a
    letter go with the word before them, at a text's beginning with the first that has one."""
    if not model.languages:
        return [[] for _ in texts]
    count, keep, n, _, labels = _labelled_words(model, texts, label=True)
    out, at, word = [], 0, 0
    for size, known in zip(count.tolist(), n.tolist()):
        own, place = labels[at : at + known], np.flatnonzero(keep[word : word + size])
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ends = [*place[first[1:]].tolist(), size]
        out.append([{"first": a, "stop": b, "lang": model.languages[j]} for a, b, j in zip([0, *ends], ends, own[first].tolist())] if known else [])
        at, word = at + known, word + size
    return out


def training_chains(words: list[str]) -> list[str]:
    """Chains of TRAIN_CHAIN words, in pieces of at most TRAIN_CHARS characters; longer words are cut too."""
    out = []
    for i in range(0, len(words), TRAIN_CHAIN):
        chain = " ".join(words[i : i + TRAIN_CHAIN])
        while len(chain) > TRAIN_CHARS:
            at = chain.rfind(" ", 1, TRAIN_CHARS + 1)
            at = at if at > 0 else TRAIN_CHARS
            out.append(chain[:at])
            chain = chain[at:].lstrip(" ")
        out.append(chain)
    return out


def train(docs: DataFrame, max_train: int = MAX_TRAIN, max_chains: int = MAX_TRAIN_CHAINS) -> Crf:
    """Fits on documents with a language whose crc32(doc_id) mod 4 is not 2: about max_train of them, and about max_chains of
    their different chains, picked by hashes, come to the driver.  Null ids, languages and texts are left out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_of_id(F.col("doc_id")) % 4 != 2))
    n = known.select("doc_id", "lang").count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                rows += [(lang, c) for c in training_chains(words_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else ([], []))], names=["lang", "words"])

    chains = staged(known.select("lang", "text").mapInArrow(run, "lang string, words string").distinct(), "chains")
    n = chains.count()
    if n > max_chains:
        chains = chains.filter(F.pmod(F.xxhash64("words", "lang"), F.lit(1 << 30)) < int((1 << 30) * max_chains / n))
    got = chains.toPandas().sort_values(["lang", "words"])
    return fit(list(zip(got["words"], got["lang"])))


def _labelled(shared, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    names, score = [], [np.zeros(0)]
    for some in cuts(texts, 1_000_000):
        more, s = label(shared.value, texts[some].to_pylist())
        names += more
        score.append(s)
    return names, np.concatenate(score)


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score.  Null texts and those without letters: und, 0; rows with null
    ids are never held out; other columns are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TRAIN_CHAINS and BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _labelled(shared, batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])
        give_back()

    some = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return some.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_spans(docs: DataFrame, model: Crf) -> DataFrame:
    """docs(doc_id, text) -> doc_id, spans: the languages of a code-switched text, word by word, as runs.  Null texts and those
    without letters have none; other columns are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column("text")
            found = [s for some in cuts(texts, 1_000_000) for s in label_spans(shared.value, texts[some].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])
        give_back()

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(run, "doc_id long, spans array<struct<first:int,stop:int,lang:string>>")


def keep_identified(docs: DataFrame, model: Crf, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text has a language with at least threshold of its words; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        names, score = _labelled(shared, text)
        give_back()
        return pa.array([n != UNKNOWN and bool(s >= threshold) for n, s in zip(names, score)], pa.bool_())

    return docs.filter(known(F.col("text").cast("string")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return identify(table(spark, sf_dir, "documents", "doc_id", "text"), train(table(spark, sf_dir, "documents", "doc_id", "lang", "text")))
