"""Exact token counts at every prefix of a text, for sentencepiece BPE models with byte fallback.

Dynamic programming over prefixes: the encoding of a prefix ends in one piece x, what stands before x is the encoding of
the shorter prefix, and x is the only piece that stays unmerged next to the last piece there.  So the count of a prefix
is the count of the shorter one plus that of x, and each prefix stores its last piece and its count.  No piece runs
from another character into a space sign, nor over a line end, so a text's table is put together from its words' tables;
a bounded cache in each Python worker keeps the counts of words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, table, tokenizer_path

LIMIT = 4096
CACHE = 600_000
SPACE = "▁"
_ODD = r"  |^ | \z| \n|\n |▁"


class PrefixCounts:
    """Counts for one model: it must be BPE, leave texts as they are but for spaces, and put a space before them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            shape = pb.ModelProto.FromString(f.read())
        norm, trained = shape.normalizer_spec, shape.trainer_spec
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only byte-pair models without text normalisation are supported")
        if any(p.type in (4, 5) for p in shape.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score = {p.piece: p.score for p in shape.pieces if p.type == 1}
        self.bytes = trained.byte_fallback
        inner = "".join(p for p in self.score if len(p) > 1)
        if "\n" in inner or any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces run over words")
        self.pair: dict[tuple[str, str], bool] = {}
        # Pieces that merging reaches, and the lengths of those that end in two characters, longest first.
        self.usable = {p for p in self.score if len(p) > 1 and self.merged(p) == [p]}
        by_end: dict[str, set[int]] = {}
        for p in self.usable:
            by_end.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {end: sorted(sizes, reverse=True) for end, sizes in by_end.items()}
        # Words of texts with single spaces, a line end at the head of the word behind it; how many tokens, and how often met.
        self.known, self.weight, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.odd: dict[str, int] = {}  # words of other texts

    def merged(self, text: str) -> list[str]:
        """Merges the best adjacent pair, the leftmost of equals, as long as one exists: for checks of short strings."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: self.score.get(parts[i] + parts[i + 1], -np.inf))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays(self, a: str, b: str) -> bool:
        known = self.pair.get((a, b))
        if known is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            known = self.pair[a, b] = self.merged(a + b) == [a, b]
        return known

    def _weight(self, x: str) -> int:
        return 1 if x in self.score or not self.bytes else len(x.encode())

    def table(self, word: str) -> list[int]:
        """Token counts of all prefixes of a word with its space sign, the empty one included."""
        usable, pair, lengths = self.usable, self.pair, self.lengths
        last, count = [""], [0]
        for j in range(1, len(word) + 1):
            for size in lengths.get(word[j - 2 : j], ()) if j > 1 else ():
                i = j - size
                if i < 0:
                    continue
                x = word[i:j]
                if x in usable:
                    stays = i == 0 or pair.get((last[i], x))
                    if stays is None:
                        stays = self._stays(last[i], x)
                    if stays:
                        last.append(x)
                        count.append(count[i] + 1)
                        break
            else:
                last.append(word[j - 1])
                count.append(count[j - 1] + self._weight(word[j - 1]))
        return count

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text as the model sees it, with their space signs; line ends stand alone."""
        return re.findall(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", SPACE + text.replace(" ", SPACE)) if text else []

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text by characters, the empty one included: 0, count(text[:1]), ..."""
        parts, base = [np.zeros(1, dtype=np.int64)], 0
        for k, word in enumerate(self.words(text)):
            t = np.array(self.table(word), dtype=np.int64)
            parts.append(base + t[(2 if k == 0 else 1) :])  # the first sign is not in the text
            base += int(t[-1])
        return np.concatenate(parts)

    def _forget(self) -> None:
        """Keeps the words met in two batches and more, half of the cache at most."""
        often = np.flatnonzero(self.met > 1)
        often = np.sort(often[np.argsort(-self.met[often], kind="stable")][: CACHE // 2])
        self.known, self.weight = self.known.take(pa.array(often)), self.weight[often]
        self.met, self.odd = np.zeros(len(often), np.int32), {}

    def _word_counts(self, words: pa.Array) -> np.ndarray:
        """Token counts of distinct words; those met for the first time get their tables."""
        at = pc.index_in(words, value_set=self.known)
        out = at.fill_null(0).to_numpy().astype(np.int64)
        if at.null_count:
            new = at.is_null()
            met = words.filter(new)
            out[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(at.null_count)
            bare = "\n" not in self.score and self.bytes  # a line end is a byte of its own, without a space sign
            weight = [
                self.table(SPACE + w)[-1] if w[:1] != "\n" else 1 + self.table(w[1:])[-1] if bare else self.table(w)[-1]
                for w in met.to_numpy(zero_copy_only=False)
            ]
            self.known = pa.concat_arrays([self.known, met])
            self.weight = np.concatenate([self.weight, np.array(weight, np.int64)])
            self.met = np.concatenate([self.met, np.zeros(len(met), np.int32)])
        self.met[out] += 1
        return self.weight[out]

    def counts(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """Token counts of whole texts; null counts as empty.  Texts with single spaces stay in Arrow arrays down to words that
        are met for the first time."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        out = np.zeros(len(texts), dtype=np.int64)
        if len(self.known) + len(self.odd) > CACHE:
            self._forget()
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            for w in self.words(texts[i].as_py()):
                n = self.odd.get(w)
                if n is None:
                    n = self.odd[w] = self.table(w)[-1]
                out[i] += n
        rows = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy() > 0))
        if len(rows):
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n"), " ")
            sizes = pc.list_value_length(lists).to_numpy()
            coded = lists.flatten().dictionary_encode()
            each = self._word_counts(coded.dictionary)[coded.indices.to_numpy()]
            out[rows] = np.add.reduceat(each, np.cumsum(sizes) - sizes)
        return out

    def truncation(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most budget tokens."""
        return int(np.flatnonzero(self.prefixes(text or "") <= budget)[-1]) if budget >= 0 else 0


@functools.lru_cache(maxsize=2)
def prefix_counts(path: str) -> PrefixCounts:
    """One table maker for each Python worker and model."""
    return PrefixCounts(path)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit.  Null texts are empty and have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(model).counts
        for batch in batches:
            texts = batch.column("text")
            n = [counts(texts[some]) for some in cuts(texts)]
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, model: str, budgets: list[int]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, prefix_tokens (counts at every prefix by characters) and cut_chars, for each of
    budgets the length of the longest prefix within it.  Null texts have the table [0]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, kind = prefix_counts(model).prefixes, pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column("text")
            for some in cuts(texts, 1_000_000):
                tables = [prefixes(t) for t in texts[some].to_pylist()]
                within = [[int(np.flatnonzero(t <= b)[-1]) if b >= 0 else 0 for b in budgets] for t in tables]
                columns = [batch.column("doc_id")[some], pa.array(tables, kind), pa.array(within, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "prefix_tokens", "cut_chars"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, prefix_tokens array<int>, cut_chars array<int>")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
