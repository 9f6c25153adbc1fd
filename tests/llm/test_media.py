"""TIFF: exact round trips of all layouts, faults, and the query against bytes taken from the texts."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cutloom.llm import media


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000))
def test_codecs_round_trip(data):
    assert media.unpack_bits(media.pack_bits(data), len(data) + 1) == data
    assert media.unpack_lzw(media.pack_lzw(data), len(data) + 1) == data


def test_lzw_over_table_resets():
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 256, 60_000, np.uint8).tobytes(), b"ab" * 30_000, rng.integers(0, 3, 50_000, np.uint8).tobytes()):
        assert media.unpack_lzw(media.pack_lzw(data), len(data)) == data


@pytest.mark.parametrize("kind", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(kind, predictor, tile, order):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 9, (300, 70)).astype(np.uint8), rng.integers(0, 60_000, (5, 33)).astype(np.uint16)]
    got = list(media.pages(media.write_pages(images, kind, predictor, tile, order)))
    assert [p.page for p in got] == [0, 1] and all(np.array_equal(p.pixels[:, :, 0], i) for p, i in zip(got, images))
    assert [p.tiled for p in got] == [tile > 0] * 2 and got[0].compression == kind


def test_faults_give_rows(spark):
    good = media.write_pages([np.ones((4, 4), np.uint8)])
    circle = bytearray(good)
    circle[-4:] = circle[4:8]
    short = bytearray(good)
    short[8:12] = b"\0\0\0\0"
    rows = [(1, None), (2, b""), (3, b"II*\0"), (4, good), (5, bytes(circle)), (6, bytes(short)), (7, good[:-20])]
    out = media.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    seen = sorted((r.doc_id, r.page, r.error is None) for r in out if r.page is not None) + sorted(r.doc_id for r in out if r.error)
    assert seen == [(4, 0, True), (5, 0, True), 2, 3, 5, 6, 7]
    with pytest.raises(ValueError):
        media.tiff_pages(spark.createDataFrame([(b"",)], "media binary").selectExpr("media", "1 AS page"))
    assert media.tiff_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def check(rows, out):
    want = {}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.setdefault(d, []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got, by_text = {}, {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items()}
    assert all(len(v) == 1 for v in by_text.values())


def test_query_and_edges(spark):
    out = media.op10_media(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check([(r.doc_id, r.text) for r in docs], out)
    assert {c for r in out for c in [r.feature.split(":")[0]]} == {"c5", "c8", "c32773"}
    rows = [(1, None), (2, ""), (None, "x"), (3, "é" * 32), (3, "é" * 32), (4, "long " * 200_000)]
    df = spark.createDataFrame([(a, b, 1, "m") for a, b in rows], "doc_id long, text string, page int, media string")
    stored = media.store_texts(df).selectExpr("*", "octet_length(media) media_bytes", "sha2(media, 256) media_sha256")
    pages = media.tiff_pages(stored)
    assert sorted((r.doc_id or 0, len(r.pixels)) for r in pages.collect()) == [(0, 64), (1, 64), (2, 64), (3, 64), (3, 64), (4, 1_000_000)]


def test_later_pages_outlive_a_broken_one(spark):
    images = [np.full((4, 4), i, np.uint8) for i in range(3)]
    data = bytearray(media.write_pages(images, media.NONE))
    at = int.from_bytes(data[4:8], "little")
    for _ in range(1):  # the second directory
        at = int.from_bytes(data[at + 2 + 12 * int.from_bytes(data[at : at + 2], "little") :][:4], "little")
    entries = [at + 2 + 12 * i for i in range(int.from_bytes(data[at : at + 2], "little"))]
    where = next(e for e in entries if int.from_bytes(data[e : e + 2], "little") == 258)
    data[where + 8 : where + 10] = b"\x01\0"  # one bit a sample
    found = list(media.walk(bytes(data)))
    assert [getattr(p, "page", None) for p in found] == [0, None, 2] and isinstance(found[1], media.TiffError)
    df = spark.createDataFrame([(1, 48, bytes(data)), (2, 48, b"no TIFF")], "doc_id long, n_bytes long, media binary").coalesce(1)
    out = {r.doc_id: r for r in media.features(media.tiff_pages(media.described(df))).collect()}
    assert out[1].payload_bytes == 32 and out[1].feature.endswith(":f1") and out[2].payload_bytes is None and out[2].feature == "f1"


def test_long_texts_run_over_pages_in_any_layout(spark):
    rows = [(i, f"text {i} " * 40_000) for i in range(12)] + [(12, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = media.features(media.tiff_pages(media.described(media.store_texts(df, 1024)))).collect()
    check(rows, out)
    kinds = {r.feature.split(":")[0] for r in out}
    assert kinds == {"c5", "c8", "c32773"} and all(":p6:" in r.feature or ":p5:" in r.feature for r in out if r.doc_id < 12)


def test_a_table_that_is_never_cleared(spark):
    # 9-bit codes while the table holds fewer than 511 entries, then wider ones, without a clear code at the limit.
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 9000, np.uint8).tobytes()
    codes, table, held = [256], {bytes([i]): i for i in range(256)}, b""
    following = 258
    for b in data:
        if held + bytes([b]) in table:
            held += bytes([b])
            continue
        codes.append(table[held])
        if following < 4096:
            table[held + bytes([b])] = following
            following += 1
        held = bytes([b])
    codes += [table[held], 257]
    bits = "".join(f"{c:0{w}b}" for c, w in zip(codes, [9, *media._lzw_widths(len(codes) - 1).tolist()]))
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert media.unpack_lzw(packed, len(data)) == data
