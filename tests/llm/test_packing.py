"""Packing: every id once, capacities, gapless offsets, balance, and the query's digests from the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cutloom.llm.common import tokenizer_path
from cutloom.llm.packing import assign, op1_packing, pack
from cutloom.llm.tokens import PieceEncoder

PATH = tokenizer_path("byte_bpe_50k.json")


def placed_well(lengths, capacity):
    out = assign(lengths, capacity)
    parts, places = defaultdict(list), defaultdict(list)
    for p, a, n, s, o in out:
        assert n > 0
        parts[p].append((a, a + n))
        places[s].append((o, o + n))
    assert all(sorted(parts[p])[0][0] == 0 and sorted(parts[p])[-1][1] == n for p, n in enumerate(lengths))
    assert all(x[1] == y[0] for v in parts.values() for x, y in zip(sorted(v), sorted(v)[1:]))
    assert all(sorted(v)[0][0] == 0 and sorted(v)[-1][1] <= capacity for v in places.values())
    assert all(x[1] == y[0] for v in places.values() for x, y in zip(sorted(v), sorted(v)[1:]))
    assert len(places) == -(-sum(lengths) // capacity)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_assign_places_all(lengths):
    placed_well(lengths, 16)


def test_costs_are_balanced_and_cuts_are_bounded():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    out = placed_well(lengths, 1024)
    cost = defaultdict(float)
    for _, _, n, s, _ in out:
        cost[s] += n + n * n / 1024
    assert len(out) < 1.5 * len(lengths) and np.std(list(cost.values())) / np.mean(list(cost.values())) < 0.35


def plain_assign(lengths, capacity):
    """The rule as it is said: every sequence is looked at for every piece."""
    n = -(-sum(lengths) // capacity)
    room, cost, out = [capacity] * n, [0.0] * n, []
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, size = 0, lengths[p]
        while size:
            fitting = [(cost[s], s) for s in range(n) if room[s] >= size]
            s = min(fitting)[1] if fitting else min(((-room[s], cost[s], s) for s in range(n)))[2]
            part = min(size, room[s])
            out.append((p, start, part, s, capacity - room[s]))
            room[s] -= part
            cost[s] += part + part * part / 1024
            start, size = start + part, size - part
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 13), max_size=80))
def test_every_piece_goes_to_the_cheapest_sequence_with_room(lengths):
    assert assign(lengths, 13) == plain_assign(lengths, 13)


def test_no_piece_is_cut_while_a_sequence_has_room():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1023) for _ in range(1500)]
    assert assign(lengths, 1024) == plain_assign(lengths, 1024)


def hold(rows, out, capacity=1024):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    assert docs.keys() == want.keys()
    for d, texts in want.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(docs[d], key=lambda r: r.start):
                ids = texts[0][r.start : r.start + r.length]
                assert r.start == at and r.doc_tokens == len(texts[0]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += r.length
            assert at == len(texts[0])
        else:
            assert sum(r.length for r in docs[d]) == sum(map(len, texts))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = op1_packing(spark, "/root/testdata/sf0.001").collect()
    hold(rows, out)
    assert len({r.sequence_id for r in out}) <= sum(r.length for r in out) / 1024 + 8


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x " * 5000), (None, "no id"), (4, "twice"), (4, "twice"), (5, "<|endoftext|> in a text")]
    df = spark.createDataFrame([(a, b, 7, "s") for a, b in rows], "doc_id long, text string, start int, sequence_id string")
    out = pack(df, PATH, block_tokens=1000).collect()
    hold(rows, out)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    assert pack(df.limit(0), PATH).count() == 0


def test_piecewise_encoding_equals_the_library():
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\n", "a", "the", "b1", "'s", "é", "\t", ".", "\x1c", " ", "<|endoftext|>", "日本", "🙂", "\x00", "Wörter,", "don't", "12.5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(2500)] + [None]
    encoder, tokenizer = PieceEncoder(PATH, max_entries=40), Tokenizer.from_file(PATH)
    for i in range(0, len(texts), 500):
        for t, got in zip(texts[i : i + 500], encoder.encode(texts[i : i + 500])):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert encoder.encode([]) == []
