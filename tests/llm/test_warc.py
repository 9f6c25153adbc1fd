"""WARC: round trips, salvage after faults, and the query against its own rules."""

import hashlib
import random

import pytest

from cutloom.llm import warc
from cutloom.llm.common import filesystem, scratch


def records(n=12):
    return [warc.record(i, f"http://h/{i}", (f"<p>{i}</p>" * (i + 1)).encode(), "response") for i in range(n)]


@pytest.mark.parametrize("gzip", [True, False])
def test_all_records_and_no_gap(gzip):
    data = b"".join(warc.member(r) if gzip else r for r in records())
    found = list(warc.salvage(data))
    assert [f.headers["warc-record-id"] for f in found] == [f"<urn:page:{i}>" for i in range(12)]
    assert all(f.gap is None for f in found) and found[3].payload == b"<p>3</p>" * 4
    assert list(warc.salvage(b"")) == []


@pytest.mark.parametrize("gzip", [True, False])
@pytest.mark.parametrize("fault", ["flip", "cut", "insert", "tail", "head"])
def test_later_records_survive(gzip, fault):
    parts = [warc.member(r) if gzip else r for r in records()]
    hurt = bytearray(parts[4])
    if fault == "flip":
        hurt[len(hurt) // 2] ^= 0x55
    if fault == "cut":
        del hurt[len(hurt) // 3 :]
    if fault == "insert":
        hurt += b"WARC/1.1\r\njunk \x1f\x8b\x08 junk"
    if fault == "tail":
        parts[11] = parts[11][:-9]
    if fault == "head":
        parts[0] = b"\x00garbage" + parts[0]
    parts[4] = bytes(hurt)
    data = b"".join(parts)
    found = list(warc.salvage(data))
    ids = {f.headers["warc-record-id"] for f in found if f.gap is None}
    lost = {"flip": {4}, "cut": {4}, "insert": set(), "tail": {11}, "head": set()}[fault]
    assert ids == {f"<urn:page:{i}>" for i in range(12) if i not in lost}
    assert found[0].begin == 0 and found[-1].end == len(data) and all(x.end == y.begin for x, y in zip(found, found[1:]))
    assert any(f.gap for f in found)


def test_any_damage_covers_the_file_once():
    rng, data = random.Random(5), b"".join(map(warc.member, records(6)))
    for _ in range(150):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(bad))
            if rng.random() < 0.3:
                del bad[at : at + rng.randint(1, 60)]
            else:
                bad[at] = rng.randrange(256)
        found = list(warc.salvage(bytes(bad)))
        assert found[0].begin == 0 and found[-1].end == len(bad) and all(x.end == y.begin for x, y in zip(found, found[1:]))


def test_edges(spark):
    long = "é" * 600
    rows = [(1, "u\r\nX: y", None), (2, None, ""), (3, "a", long), (7, "b", long), (7, "c", long), (5, "d", "x" * 999), (6, "e", "x" * 999), (None, "f", long), (8, "g", "y" * 1_500_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    manifest = warc.write_warc(df, scratch(spark, "warc"))
    out = warc.read_warc(manifest).collect()
    assert len(out) == len(rows) and all(r.gap is None for r in out)
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in out)
    want = [("1", "response", None), ("2", "response", None), ("3", "revisit", 7), ("7", "response", None), ("7", "response", None), ("5", "response", None), ("6", "response", None), ("null", "revisit", 7), ("8", "response", None)]
    assert kinds == sorted((f"<urn:page:{a}>", b, c and f"<urn:page:{c}>") for a, b, c in want)
    assert all(r.payload_digest == hashlib.sha1(long.encode()).hexdigest() and r.payload_bytes == 1200 for r in out if r.record_type == "revisit")
    assert warc.read_warc(warc.write_warc(df.limit(0), scratch(spark, "warc"))).count() == 0


def test_damaged_file_in_a_table(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(df, scratch(spark, "warc"))
    path = manifest.first().path
    fs, local = filesystem(path)
    with fs.open_input_stream(local, compression=None) as f:
        data = bytearray(f.read())
    middle = list(warc.salvage(bytes(data)))[20]
    data[(middle.begin + middle.end) // 2] ^= 0xFF
    with fs.open_output_stream(local, compression=None) as f:
        f.write(bytes(data))
    out = warc.read_warc(manifest, with_payload=False).collect()
    assert sum(r.gap is None for r in out) == 39 and sum(r.gap is not None for r in out) == 1
    gap = next(r for r in out if r.gap)
    folder = scratch(spark, "quarantine")
    for _ in range(2):  # a log that is written again is replaced
        log = warc.log_gaps(warc.read_warc(manifest, with_payload=False), folder).collect()
        assert [tuple(r) for r in log] == [(path, gap.begin, gap.end, gap.gap, gap.end - gap.begin)]
    assert warc.log_gaps(warc.read_warc(manifest.limit(0)), folder).count() == 0


def test_query(spark):
    out = {r.page_id: tuple(r)[1:] for r in warc.op2_warc(spark, "/root/testdata/sf0.001").collect()}
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    top: dict = {}
    for p, x in pages.items():
        top[x] = max(p, top.get(x, p))
    want = {p: (len(x), hashlib.sha1(x).hexdigest(), *(("revisit", top[x]) if len(x) >= 1000 and top[x] != p else ("response", None))) for p, x in pages.items()}
    assert out == want


def plain(*lines, block=b"x"):
    return ("\r\n".join(["WARC/1.1", "WARC-Type: response", "WARC-Record-ID: <urn:page:1>", *lines, "", ""])).encode() + block + b"\r\n\r\n"


def test_records_of_one_member_are_read_one_by_one():
    parts = [warc.record(i, "u", b"p" * i, "response") for i in range(4)]
    data = warc.member(parts[0] + parts[1]) + warc.member(parts[2] + b"junk" + parts[3]) + warc.member(b"")
    found = list(warc.salvage(data))
    assert [f.headers["warc-record-id"] for f in found if f.gap is None] == [f"<urn:page:{i}>" for i in range(4)]
    assert sum(f.gap is not None for f in found) == 2 and found[0].begin == 0 and found[-1].end == len(data)
    assert all(x.end == y.begin for x, y in zip(found, found[1:]))


@pytest.mark.parametrize("name, value, good", [
    ("md5", hashlib.md5(b"x").hexdigest(), True), ("md5", hashlib.md5(b"y").hexdigest(), False), ("SHA-256", hashlib.sha256(b"x").hexdigest().upper(), True),
    ("sha1", hashlib.sha1(b"x").hexdigest(), True), ("blake9", "zz", True), ("sha1", "not base32!", False),
])
def test_digests_are_checked_by_their_algorithm(name, value, good):
    for header in ("WARC-Block-Digest", "WARC-Payload-Digest"):
        found = list(warc.salvage(plain("Content-Length: 1", f"{header}: {name}:{value}")))
        assert [f.gap is None for f in found] == [good]


@pytest.mark.parametrize("length", ["9" * 5000, "-1", "1e3", "", "\u0661", "999999999"])
def test_odd_lengths_are_gaps(length):
    found = list(warc.salvage(plain(f"Content-Length: {length}") + plain("Content-Length: 1")))
    assert [f.gap is None for f in found] == [False, True]


def test_odd_revisits_and_a_small_window(spark, monkeypatch, tmp_path):
    parts = [plain("Content-Length: 1", f"WARC-Payload-Digest: {d}").replace(b"response", b"revisit") for d in ("sha1:?", "md5:00", "sha1:" + "A" * 32)]
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(parts) + b"".join(map(warc.member, records())) + b"tail")
    out = warc.read_warc(spark.createDataFrame([(f"file://{path}",), (None,)], "path string")).collect()
    assert [r.payload_digest for r in out[:3]] == ["sha1:?", "md5:00", "0" * 40] and len(out) == 16 and out[-1].gap
    monkeypatch.setattr(warc, "WINDOW", 7)
    assert [(f.begin, f.end, f.payload) for f in warc.salvage_file(str(path))] == [(f.begin, f.end, f.payload) for f in warc.salvage(path.read_bytes())]
