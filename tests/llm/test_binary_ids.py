"""Huffman files: exact round trips, optimal and canonical codes, and the query against the tokenizer."""

import heapq
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cutloom.llm import binary_ids as b
from cutloom.llm.common import scratch, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60))
def test_code_lengths_are_optimal(counts):
    counts = np.array(counts)
    lengths = b.code_lengths(counts)
    assert (lengths * counts).sum() == huffman_cost(counts.tolist()) if counts.any() else not lengths.any()
    if (counts > 0).sum() > 1:
        assert (0.5 ** lengths[lengths > 0].astype(float)).sum() == 1


def test_lengths_are_limited_and_codes_canonical():
    counts = np.array([2**i for i in range(40)])
    lengths = b.code_lengths(counts, 8)
    codes = b.canonical_codes(lengths)
    assert lengths.max() == 8
    text = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths)]
    assert not any(x != y and y.startswith(x) for x in text for y in text)
    order = np.lexsort((np.arange(40), lengths))
    assert (np.diff([int(t.ljust(8, "0"), 2) for t in np.array(text)[order]]) > 0).all()
    with pytest.raises(ValueError):
        b.code_lengths(np.ones(300), 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=1200), st.integers(0, 3))
def test_files_round_trip(ids, cut):
    ids = np.array(ids, dtype=np.uint32)
    lengths = b.code_lengths(np.bincount(ids, minlength=1))
    n = len(ids) * cut // 3
    data = b.file_bytes(ids, [5, None, -1], [n, 0, len(ids) - n], 3, 9, lengths, b.canonical_codes(lengths))
    header, docs, sizes, got = b.read_file(data)
    assert got.tolist() == ids.tolist() and docs == [5, None, -1] and sizes.tolist() == [n, 0, len(ids) - n] and header["part"] == 3


def hold(rows, out):
    tokenizer, at, want = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    hold([(r.doc_id, r.text) for r in docs], b.op5_binary_ids(spark, "/root/testdata/sf0.001").collect())


def test_edges_and_several_files(spark, monkeypatch):
    rows = [(9, None), (2, ""), (3, "x " * 5000), (None, "no id"), (4, "twice"), (4, "twice"), (-5, "é")]
    df = spark.createDataFrame([(a, t, 1) for a, t in rows], "doc_id long, text string, part int").repartition(3)
    manifest = b.write_ids(df, PATH, scratch(spark, "huffman"))
    out = b.read_ids(manifest).collect()
    hold(rows, out)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    assert b.read_ids(b.write_ids(df.limit(0), PATH, scratch(spark, "huffman"))).count() == 0


def test_a_range_is_cut_into_files(spark):
    rows = [(i, "some words " * (i % 7)) for i in range(200)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    manifest = b.write_ids(df, PATH, scratch(spark, "huffman"), file_ids=50)
    files = manifest.collect()
    assert len(files) > 20 and max(f.n_ids for f in files) < 50 + 20
    hold(rows, b.read_ids(manifest).collect())


def test_one_id_on_a_third_of_all_rows_spreads(spark):
    rows = [(5 if i % 3 == 0 else i, f"text {i} of many") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = b.write_ids(df, PATH, scratch(spark, "spread"))
        sizes = {r.part: r.n for r in manifest.groupBy("part").sum("n_ids").toDF("part", "n").collect()}
        assert len(sizes) == 4 and max(sizes.values()) < 0.4 * sum(sizes.values())
        got = b.read_ids(manifest, with_ids=False).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows) and all(x.start + x.n_tokens == y.start for x, y in zip(got, got[1:]))
