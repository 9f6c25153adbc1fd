"""Token ids with the tokenizers library, whole texts, exact.

The library splits a text into pre-tokens before it merges, and no pre-token of a byte-level BPE vocabulary
runs from a non-space into a following space.  A text may therefore be encoded piece by piece, cut before such
spaces, and equal pieces need to be encoded once only.  Every id comes from the library: pieces of plain Latin
letters, digits and signs go to its BPE model word by word, all others through its whole encode().  A bounded cache
in each Python worker keeps the ids of words met before; when it is full, those met once only leave it.  Texts, pieces
and words stay in Arrow arrays; only words met for the first time become Python strings.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cutloom.llm.common import picked

# A space after white space that no word follows belongs to a longer run, which must stay whole.
_WHITE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"
_RUN = rf"{_WHITE} (?:{_WHITE}|\z)"
_SAFE = re.compile(r"(?<=\S) ")
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
# No apostrophes (contractions) and no run of white space: in other pieces the pre-tokens are plain runs of one class.
_NOT_PLAIN = rf"^$|^\n|\n\n|[^{_LETTER}0-9{_SIGN}\n]"
# Classes of the bytes of plain pieces; a word is a run of one class with the space before it.
_SPACE, _END = 5, 6
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x0A, 0x20, 0x00]] = 4, _SPACE, _END
_LARGE = pa.large_string()


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _joined(values: pa.Array, separator: str) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(whole, pa.scalar(separator, _LARGE))[0].as_py()


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str, max_entries: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        self.plain = (
            shape.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.added = "|".join(re.escape(x["content"]) for x in shape.get("added_tokens", []))
        self.letters = _byte_letters()
        self.max_entries = max_entries
        self.known = pa.array(["\0"], _LARGE)  # words; known[i] has data[start[i] : start[i + 1]], and was met met[i] times
        self.start, self.data, self.met = np.zeros(2, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int32)
        self.other: dict[str, list[int]] = {}  # pieces for the whole encode()

    def _learn(self, new: pa.Array) -> None:
        shown = _joined(new, "\0").encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        tokenize, data, ends = self.model.tokenize, array("I"), array("q")
        for w in shown:
            data.extend([t.id for t in tokenize(w)])
            ends.append(len(data))
        self.known = pa.concat_arrays([self.known, new])
        self.start = np.concatenate([self.start, np.frombuffer(ends, np.int64) + self.start[-1]])
        self.data = np.concatenate([self.data, np.frombuffer(data, np.uint32)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones; new ones are learnt."""
        at = pc.index_in(words, value_set=self.known)
        out = at.fill_null(0).to_numpy().astype(np.int64)
        if at.null_count:
            new = at.is_null()
            out[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(at.null_count)
            self._learn(words.filter(new))
        self.met[out] += 1
        return out

    def _forget(self) -> None:
        """Keeps the words met in two batches and more, half of the cache at most."""
        often = np.flatnonzero(self.met[1:] > 1) + 1
        often = np.sort(often[np.argsort(-self.met[often], kind="stable")][: self.max_entries // 2])
        kept = np.concatenate([[0], often])
        size = self.start[kept + 1] - self.start[kept]
        self.data = picked(self.data, self.start[kept], size)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.known = self.known.take(pa.array(kept))
        self.met = np.zeros(len(kept), np.int32)

    def _plain_ids(self, spaced: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces with a space in front, then of heads without, and how many each has: runs of one class of
        bytes are words."""
        parts = [mark + _joined(values, mark) for values, mark in ((spaced, " "), (heads, "\0")) if len(values)]
        text = np.frombuffer("".join(parts).encode(), np.uint8)
        kind = _CLASS[text]
        first = np.ones(len(text), dtype=bool)
        first[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        offsets = np.append(np.flatnonzero(first), len(text))
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text))
        coded = words.dictionary_encode()
        slots = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        size = self.start[slots + 1] - self.start[slots]
        opens = np.flatnonzero(kind[offsets[:-1]] >= _SPACE)  # where a piece begins
        return picked(self.data, self.start[slots], size), np.add.reduceat(size, opens)

    def _piece_ids(self, values: pa.Array, n_heads: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has; all but the last n_heads follow a space."""
        odd, spaced = np.ones(len(values), dtype=bool), np.arange(len(values)) < len(values) - n_heads
        if self.plain:
            wrong = pc.match_substring_regex(values, _NOT_PLAIN)
            if self.added:
                wrong = pc.or_(wrong, pc.match_substring_regex(values, self.added))
            odd = wrong.to_numpy(zero_copy_only=False)
        count, ids = np.zeros(len(values), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        if not odd.all():
            ids, count[~odd] = self._plain_ids(values.filter(pa.array(~odd & spaced)), values.filter(pa.array(~odd & ~spaced)))
        if odd.any():
            texts = [" " * s + t for s, t in zip(spaced[odd].tolist(), values.filter(pa.array(odd)).to_pylist())]
            new = [t for t in dict.fromkeys(texts) if t not in self.other]
            found = {t: x.ids for t, x in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))}
            got = [found[t] if t in found else self.other[t] for t in texts]
            self.other = (self.other if len(self.other) < 100_000 else {}) | {t: x for t, x in found.items() if len(t) < 64}
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            count[odd] = sizes
            # Into the order of the pieces.
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(sizes.sum()))
            out = np.empty(int(count.sum()), dtype=np.uint32)
            from_odd = np.repeat(odd, count)
            out[from_odd], out[~from_odd] = flat, ids
            ids = out
        return ids, count

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; a null text counts as empty."""
        texts = texts.cast(_LARGE).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        runs = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        if runs.any():
            split = pa.array([_SAFE.split(t) for t in texts.filter(pa.array(runs)).to_pylist()], lists.type)
            order = np.empty(len(texts), dtype=np.int64)
            order[~runs], order[runs] = np.arange((~runs).sum()), (~runs).sum() + np.arange(runs.sum())
            lists = pa.concat_arrays([lists.filter(pa.array(~runs)), split]).take(pa.array(order))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        first = np.concatenate([[0], ends[:-1]])
        flat = lists.flatten()
        if len(self.known) > self.max_entries:
            self._forget()
        heads, coded = flat.take(pa.array(first)), flat.dictionary_encode()
        del flat, lists
        known, known_count = self._piece_ids(pa.concat_arrays([coded.dictionary, heads]), len(heads))
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[first] = len(coded.dictionary) + np.arange(len(heads))
        count = known_count[codes]
        return picked(known, (np.cumsum(known_count) - known_count)[codes], count), np.add.reduceat(count, first)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        ids, sizes = self.ids(pa.array(list(texts), _LARGE))
        data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(sizes)
        return [bytes(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id behind each text's."""
    ends = np.cumsum(sizes + 1)
    out = np.full(len(ids) + len(sizes), end_id, dtype=np.uint32)
    inside = np.ones(len(out), dtype=bool)
    inside[ends - 1] = False
    out[inside] = ids
    return out, sizes + 1


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary file."""
    return PieceEncoder(path)


def vocabulary_size(path: str) -> int:
    """Ids run below this, added tokens included."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return max(vocabulary.values(), default=-1) + 1
