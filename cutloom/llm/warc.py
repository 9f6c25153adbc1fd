"""WARC archives: written with revisit records for repeated payloads, read back by a reader that salvages.

Writer: a record per page.  Of pages with equal payloads of at least MIN_REVISIT bytes the one with the largest page_id
is a response and the others revisit it.  Digests meet in one aggregation with map-side combine; only pages of that size
move to be joined with digests that occur twice, and Spark can split a digest that holds many pages.

Reader: walks a file record by record (gzip members, which may hold several records, or plain records) through a window
of the file.  A record counts if its member unpacks with a right checksum, its header parses, its length fits and its
digests hold, as far as their algorithm is known.  After a failed check the reader searches for the next place where a
valid member, or a version line with a valid record, begins, goes on there, and logs the bytes between as a quarantined
gap.  A file is read by one task, which holds one record and WINDOW bytes at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, filesystem, give_back, scratch, staged, table

MIN_REVISIT = 1000
FILE_BYTES = 64_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
_DIGESTS = {"md5", "sha1", "sha224", "sha256", "sha384", "sha512"}
#: Bytes that the reader asks a file for at a time; a header longer than HEADER_MOST is a failed check.
WINDOW = 4_000_000
HEADER_MOST = 1 << 24

_ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length"}


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None = None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x1f]+", " ", url or ""),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {_base32(payload)}",
        f"WARC-Block-Digest: {_base32(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp: equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Found(NamedTuple):
    """A record (gap: None) or a quarantined gap (gap: why) at bytes begin..end of the file.  Of several records in one
    member the first stands for the member's bytes and the others at its end; so do gaps inside a member, which say where."""

    begin: int
    end: int
    gap: str | None
    headers: dict[str, str]
    payload: bytes | None


class _Bad(Exception):
    pass


class _Window:
    """Bytes of a file by place, read in stretches of at least WINDOW bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.base, self.held = read_at, size, 0, b""

    def get(self, at: int, n: int) -> memoryview:
        """The n bytes from at on, fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if at < self.base or at + n > self.base + len(self.held):
            self.base, self.held = at, self.read_at(at, min(max(n, WINDOW), self.size - at))
        return memoryview(self.held)[at - self.base : at - self.base + n]


def _digest_holds(text: str, data: bytes) -> bool:
    """Whether a digest header (algorithm:value, in hex or base32) is that of data; other algorithms can't be checked."""
    name, _, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in _DIGESTS:
        return True
    found = hashlib.new(name, data).digest()
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _plain_sha1(text: str) -> str:
    """A SHA-1 header's value as bare lower-case hex; the text of other headers as it is."""
    name, _, value = text.partition(":")
    value = value.strip()
    if name.strip().lower().replace("-", "") == "sha1":
        if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
            return value.lower()
        if re.fullmatch(r"[A-Za-z2-7]{32}", value):
            return base64.b32decode(value.upper()).hex()
    return text


def _parse(window: _Window, at: int) -> tuple[dict[str, str], bytes | None, int]:
    """The record that begins at a place: its headers, payload and end."""
    version = _VERSION.match(window.get(at, 16))
    if not version:
        raise _Bad("no version line")
    most = 1 << 16
    while True:
        head = bytes(window.get(at, most))
        stop = head.find(b"\r\n\r\n")
        if stop >= 0:
            break
        if len(head) < most:
            raise _Bad("no end of header")
        if most >= HEADER_MOST:
            raise _Bad("header is too long")
        most *= 16
    headers: dict[str, str] = {}
    for line in head[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without colon")
        key = name.decode("latin-1").strip().lower()
        if key in headers and key in _ONCE:  # two records ran into one
            raise _Bad("repeated header")
        headers[key] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise _Bad("no content length")
    begin, end = at + stop + 4, at + stop + 4 + int(length)
    if end + 4 > window.size or window.get(end, 4) != b"\r\n\r\n":
        raise _Bad("length does not fit")
    block = bytes(window.get(begin, end - begin))
    if "warc-block-digest" in headers and not _digest_holds(headers["warc-block-digest"], block):
        raise _Bad("block digest differs")
    payload = None
    if headers.get("warc-type") == "response":
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else block
        if "warc-payload-digest" in headers and not _digest_holds(headers["warc-payload-digest"], payload):
            raise _Bad("payload digest differs")
    elif headers.get("warc-type") == "revisit":
        if found := re.search(rb"(?i)\r\nContent-Length: *([0-9]{1,18})\r\n", block):
            headers["http-content-length"] = found[1].decode()
    return headers, payload, end + 4


def _member(window: _Window, at: int) -> tuple[bytes, int]:
    """What the gzip member at a place holds, and its end."""
    packer, parts, place = zlib.decompressobj(31), [], at
    try:
        while not packer.eof:
            data = window.get(place, 1 << 18)
            if not len(data):
                raise _Bad("member: cut short")
            parts.append(packer.decompress(data))
            place += len(data)
    except zlib.error as e:
        raise _Bad(f"member: {e}") from None
    return b"".join(parts), place - len(packer.unused_data)


def _search(window: _Window, at: int) -> int:
    """The next place where a member or a record may begin, else the file's end."""
    while at < window.size:
        data = window.get(at, 1 << 18)
        if found := _START.search(data):
            return at + found.start()
        at += max(1, len(data) - 12) if at + len(data) < window.size else len(data)  # a version line may lie across
    return window.size


def _walk(window: _Window, members: bool = True) -> Iterator[Found]:
    at, gap, why = 0, None, ""
    while at < window.size:
        inner: list[Found] = []
        try:
            if members and window.get(at, 3) == _GZIP:
                plain, end = _member(window, at)
                inner = list(_walk(_Window(lambda a, n, plain=plain: plain[a : a + n], len(plain)), members=False))
                whole = [x for x in inner if x.gap is None]
                if not whole:
                    raise _Bad(inner[0].gap if inner else "empty member")
                bad = [Found(end, end, f"in a member, bytes {x.begin} to {x.end}: {x.gap}", {}, None) for x in inner if x.gap]
                inner = [x._replace(begin=at if x is whole[0] else end, end=end) for x in whole] + bad
            else:
                headers, payload, end = _parse(window, at)
                inner = [Found(at, end, None, headers, payload)]
        except _Bad as e:
            if gap is None:
                gap, why = at, str(e)
            at = _search(window, at + 1)
            continue
        if gap is not None:
            yield Found(gap, at, why, {}, None)
            gap = None
        yield from inner
        at = end
    if gap is not None:
        yield Found(gap, window.size, why, {}, None)


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records of a file and the gaps between; together they cover its bytes once.  Empty data gives none."""
    return _walk(_Window(lambda at, n: data[at : at + n], len(data)))


def salvage_file(path: str) -> Iterator[Found]:
    """salvage() of a file that is read piece by piece."""
    fs, local = filesystem(path)
    with fs.open_input_file(local) as f:
        yield from _walk(_Window(lambda at, n: f.read_at(n, at), f.size()))


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, n))
                out = None

        for batch in batches:
            for some in cuts(batch.column("html")):
                part = batch[some]
                for page_id, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    if out is None:  # the name is the attempt's own: a repeated task never touches another's file
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = record(page_id, url, html.encode(), "response" if refers is None else "revisit", refers)
                    size, n = size + out.write(member(data, level)), n + 1
                    if size >= FILE_BYTES:
                        close()
        close()
        columns = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "n_bytes", "n_records"])
        give_back()

    return run


def write_warc(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, level: int = 6) -> DataFrame:
    """pages(page_id, url, html) -> archives in folder; the manifest: path, n_bytes, n_records.

    Null html is an empty payload, null url an empty one, a null page_id is written as such and never revisited.
    Repeated rows: all rows with the largest page_id of a payload are responses.  Other columns are left out.
    """
    some = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    small = some.filter(F.octet_length("html") < min_revisit).withColumn("refers_to", F.lit(None).cast("long"))
    large = some.filter(F.octet_length("html") >= min_revisit).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = (
        large.groupBy(F.col("digest").alias("first_digest"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first").isNotNull())
        .select("first_digest", "first")
    )
    joined = large.join(firsts, F.col("digest") == F.col("first_digest"), "left")
    rows = joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))
    return staged(rows.unionByName(small).mapInArrow(_write(folder, level), "path string, n_bytes long, n_records long"), "warc-manifest")


#: Files are dealt to so many tasks for each core.
FILES_A_CORE = 16

READ_SCHEMA = (
    "path string, begin long, end long, gap string, record_id string, record_type string, target_uri string,"
    " refers_to string, payload_digest string, payload_bytes long, payload binary"
)
_READ_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """manifest(path) -> a row per record (gap null) and per quarantined gap (gap: the reason; begin..end the bytes).

    payload_digest is the header's: SHA-1 as lower-case hex, other algorithms as they stand; payload_bytes is the payload's
    length; a revisit has both from its header and no payload.  Missing headers are null.  A null path gives nothing.
    """
    fields = [c.split() for c in READ_SCHEMA.split(",")]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, _READ_TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").drop_null().to_pylist():
                rows, held = [], 0
                for x in salvage_file(path):
                    h = x.headers
                    size = len(x.payload) if x.payload is not None else h.get("http-content-length")
                    digest = _plain_sha1(h["warc-payload-digest"]) if "warc-payload-digest" in h else None
                    rows.append((path, x.begin, x.end, x.gap, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, None if size is None else int(size), x.payload if with_payload else None))
                    held += len(x.payload or b"") * with_payload
                    if len(rows) >= 5_000 or held >= 32_000_000:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)
        give_back()

    # As many tasks as files, up to some for each core; names are random, so that ranges of them are of about one size.
    n = max(1, min(manifest.count(), FILES_A_CORE * manifest.sparkSession.sparkContext.defaultParallelism))
    out = manifest.select("path").repartitionByRange(n, "path").mapInArrow(run, READ_SCHEMA)
    return out if with_payload else out.drop("payload")


def _page_of(record_id: str):
    found = F.regexp_extract(F.col(record_id), r"^<urn:page:(-?\d+)>$", 1)
    return F.when(found != "", found).cast("long")


def records(read: DataFrame) -> DataFrame:
    """read_warc(write_warc(...)) -> page_id, payload_bytes, payload_digest, record_type, refers_to of its records."""
    got = read.filter(F.col("gap").isNull())
    return got.select(_page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_of("refers_to").alias("refers_to"))


def log_gaps(read: DataFrame, path: str) -> DataFrame:
    """Writes the quarantined byte ranges of read_warc() as Parquet: path, begin, end, reason, bytes.  The log, read again; it
    is there without rows where nothing was quarantined."""
    log = read.filter(F.col("gap").isNotNull()).select("path", "begin", "end", F.col("gap").alias("reason"), (F.col("end") - F.col("begin")).alias("bytes"))
    log.write.mode("overwrite").parquet(path)
    return read.sparkSession.read.schema(log.schema).parquet(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; the log of quarantined gaps stands in the archives' folder."""
    folder = scratch(spark, "warc")
    read = staged(read_warc(write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder), with_payload=False), "warc-records")
    log_gaps(read, f"{folder}/quarantine")
    return records(read)


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
