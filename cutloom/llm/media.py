"""Media columns: TIFF images in binary columns, one row per page.

The reader walks the image file directories of either byte order, decodes PackBits, LZW and deflate strips and tiles,
undoes horizontal differencing, and gives one row per page.  The writer stores bytes as 8-bit grey pages.  A page that
can't be read gives a row with the reason, and the walk goes on at the next directory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm.common import cuts, give_back, table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH = 64
ROWS_PER_STRIP = 256
#: Rows of a page of a stored text; longer ones run over several pages.
PAGE_ROWS = 1024
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}  # bytes of a field type


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, most: int) -> bytes:
    """PackBits: a count byte, then that many bytes as they are, or one byte repeated."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < most:
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        else:
            if count > 128:
                out += data[at + 1 : at + 2] * (257 - count)
            at += 2 if count > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes and more are repeated, the rest stays as it is, in stretches of at most 128."""
    out = bytearray()
    values = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, int)
    sizes = np.diff(edges)
    literal = 0

    def plain(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(i + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3).tolist():
        start, stop = int(edges[k]), int(edges[k + 1])
        plain(literal, start)
        for i in range(start, stop, 128):
            run = min(128, stop - i)
            out += bytes([(257 - run) % 256 if run > 1 else 0, data[i]])
        literal = stop
    plain(literal, len(data))
    return bytes(out)


def _lzw_widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code (widened one code early): they follow from the place alone."""
    k = np.arange(n)
    return 9 + (k >= 254) + (k >= 766) + (k >= 1790)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, widened one code early: the codes up to each clear code are cut out
    of the bits at once, then looked up one by one."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    ahead = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]  # the 24 bits from each byte on
    out: list[bytes] = []
    at, size, bits = 0, 0, 8 * len(data)
    while at < bits and size < most:
        widths = _lzw_widths(min(4096, (bits - at) // 9 + 1))
        while True:  # a table that is never cleared goes on with the widest codes
            places = at + np.cumsum(widths) - widths
            inside = places + widths <= bits
            places, some = places[inside], widths[inside]
            codes = ahead[places >> 3] >> (24 - some - (places & 7)).astype(np.uint32) & ((1 << some) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == 256) | (codes == 257))
            if len(stops) or not inside.all():
                break
            widths = _lzw_widths(2 * len(widths))
        known, before = list(base), b""
        for code in codes[: stops[0] if len(stops) else None].tolist():
            if code < len(known):
                now = known[code]
            elif before and code == len(known):
                now = before + before[:1]
            else:
                raise TiffError("LZW code ahead of its table")
            out.append(now)
            size += len(now)
            if size >= most:
                break
            if before and len(known) < 4096:
                known.append(before + now[:1])
            before = now
        if not len(stops) or codes[stops[0]] == 257:
            break
        at = int(places[stops[0]] + some[stops[0]])
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, places = [256], [0]  # places: of each code since the last clear one
    known: dict[int, int] = {}  # code before and byte -> code of both
    following, held = 258, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        longer = known.get(key)
        if longer is not None:
            held = longer
            continue
        codes.append(held)
        places.append(following - 258)
        known[key] = following
        following += 1
        held = byte
        if following == 4094:
            codes.append(256)
            places.append(following - 258)
            known, following = {}, 258
    if held >= 0:
        codes.append(held)
        places.append(following - 258)
        following += 1
    codes.append(257)
    places.append(following - 258)
    widths = _lzw_widths(4096)[places]
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - widths[:, None]]).tobytes()


def _unpack(data: bytes, kind: int, most: int) -> bytes:
    if kind == NONE:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    if kind == PACKBITS:
        return unpack_bits(data, most)
    if kind == LZW:
        return unpack_lzw(data, most)
    raise TiffError(f"compression {kind} is not supported")


def _pack(data: bytes, kind: int) -> bytes:
    return {NONE: lambda x: x, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits, LZW: pack_lzw}[kind](data)


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    try:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = _SIZES.get(kind, 1) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, where))
        return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error:
        raise TiffError("directory runs over the file's end") from None


def _page(data: bytes, tags: dict[int, list], order: str, number: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        if not tags.get(tag):
            if default is None:
                raise TiffError(f"tag {tag} is missing")
            return default
        return tags[tag][0]

    width, height, samples = one(256), one(257), one(277, 1)
    bits, kind, predictor = one(258, 1), one(259, 1), one(317, 1)
    if bits not in (8, 16) or len(set(tags[258])) > 1 or one(284, 1) != 1 or one(266, 1) != 1 or predictor not in (1, 2):
        raise TiffError("only whole samples of 8 or 16 bits, pixel by pixel, are supported")
    tiled = 324 in tags
    cell_w, cell_h = (one(322), one(323)) if tiled else (width, min(height, one(278, height)))
    offsets, counts = (tags.get(324, []), tags.get(325, [])) if tiled else (tags.get(273, []), tags.get(279, []))
    across, down = -(-width // max(1, cell_w)), -(-height // max(1, cell_h))
    if not width or not height or len(offsets) != across * down or len(counts) != len(offsets):
        raise TiffError("strips or tiles don't cover the image")
    sample = np.dtype(f"{order}u{bits // 8}")
    out = np.zeros((height, width, samples), dtype=sample.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        y, x = k // across * cell_h, k % across * cell_w
        rows = cell_h if tiled else min(cell_h, height - y)
        need = rows * cell_w * samples * sample.itemsize
        if offset + count > len(data):
            raise TiffError("strip or tile runs over the file's end")
        raw = _unpack(data[offset : offset + count], kind, need)
        if len(raw) < need:
            raise TiffError("strip or tile is too short")
        cell = np.frombuffer(raw, sample, rows * cell_w * samples).reshape(rows, cell_w, samples)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=out.dtype)
        out[y : y + rows, x : x + cell_w] = cell[: height - y, : width - x]
    return Page(number, width, height, samples, bits, kind, predictor, tiled, out)


def walk(data: bytes) -> Iterator[Page | TiffError]:
    """All pages of a file in the order of its directories; in place of a page that can't be read the fault, after which
    the walk goes on at the next directory.  A broken header or directory, or a circle of them, ends it."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        yield TiffError("no TIFF header")
        return
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        if at in seen:
            yield TiffError("directories run in a circle")
            return
        seen.add(at)
        try:
            tags, following = _directory(data, at, order)
        except TiffError as e:
            yield e
            return
        try:
            yield _page(data, tags, order, number)
        except (TiffError, MemoryError, ValueError) as e:
            yield e if isinstance(e, TiffError) else TiffError(f"page {number}: {e}")
        at, number = following, number + 1


def pages(data: bytes) -> Iterator[Page]:
    """All pages of a file in the order of its directories; TiffError at the first that can't be read."""
    for found in walk(data):
        if isinstance(found, TiffError):
            raise found
        yield found


def write_pages(images: list[np.ndarray], kind: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<") -> bytes:
    """Grey images (height x width, 8 or 16 bits) as one file: strips of ROWS_PER_STRIP rows, or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width = image.shape
        cells = []
        step_y, step_x = (tile, tile) if tile else (ROWS_PER_STRIP, width)
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                cell = image[y : y + step_y, x : x + step_x]
                if tile:
                    cell = np.pad(cell, ((0, tile - cell.shape[0]), (0, tile - cell.shape[1])))
                if predictor == 2:
                    cell = np.diff(cell, axis=1, prepend=np.zeros((len(cell), 1), cell.dtype))
                cells.append(_pack(cell.astype(cell.dtype.newbyteorder(order)).tobytes(), kind))
        offsets = []
        for c in cells:
            offsets.append(len(out))
            out += c + b"\0" * (len(c) % 2)
        counts = [len(c) for c in cells]
        fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [image.itemsize * 8]), (259, 3, [kind]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        if tile:
            fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)]
        else:
            fields += [(273, 4, offsets), (278, 4, [ROWS_PER_STRIP]), (279, 4, counts)]
        entries = b""
        for tag, letter, values in sorted(fields):
            value = struct.pack(f"{order}{len(values)}{'H' if letter == 3 else 'I'}", *values)
            if len(value) > 4:
                place = len(out)
                out += value
                value = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, letter, len(values)) + value.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def encode_payload(payload: bytes, page_rows: int = 0) -> bytes:
    """Bytes (a multiple of WIDTH) as grey pages of page_rows rows (0: one page); the layout follows from the bytes, so
    equal ones are stored alike."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    images = [image[i : i + page_rows] for i in range(0, len(image), page_rows)] if page_rows else [image]
    layout = zlib.crc32(payload) % 4
    if layout == 0:
        return write_pages(images, DEFLATE, 2)
    if layout == 1:
        return write_pages(images, DEFLATE, 1, tile=64)
    return write_pages(images, PACKBITS if layout == 2 else LZW)


def store_texts(docs: DataFrame, page_rows: int = 0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: the text's UTF-8 with zero bytes up to a positive multiple of WIDTH
    as a TIFF file, in pages of page_rows rows (0: one page).  Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in cuts(batch.column(1)):
                raw = batch.column(1)[some].cast(pa.large_binary()).to_pylist()
                media = [encode_payload(b + b"\0" * (-len(b) % WIDTH or (0 if b else WIDTH)), page_rows) for b in raw]
                columns = [batch.column(0)[some], pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
_PAGE_TYPES = [*[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
#: Bytes of pixels that wait for their rows in one task.
HELD_BYTES = 16_000_000


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """A row per page of each TIFF in the binary column media, which it takes the place of; the other columns repeat.

    pixels: the samples row by row, little-endian.  A null file gives no row; for a page, directory or header that can't be
    read there is a row with error set and nulls.  Other columns must not be named as those of pages.
    """
    names = [c.split()[0] for c in PAGE_FIELDS.split(", ")]
    kept = [c for c in df.columns if c != media]
    if clash := set(kept) & set(names):
        raise ValueError(f"columns {sorted(clash)} stand for pages; rename them first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(kept)
            rows, index, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _PAGE_TYPES)] if rows else [pa.nulls(0, t) for t in _PAGE_TYPES]
                repeated = own.take(pa.array(index, pa.int64())).columns if kept else []
                return pa.RecordBatch.from_arrays([*repeated, *columns], names=[*kept, *names])

            for i, data in enumerate(batch.column(media)):
                for p in walk(data.as_py()) if data.is_valid else ():
                    if isinstance(p, TiffError):
                        rows.append((*[None] * 9, str(p)))
                    else:
                        rows.append((*p[:8], p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), None))
                        held += p.pixels.nbytes
                    index.append(i)
                    if held >= HELD_BYTES:
                        yield flush()
                        rows, index, held = [], [], 0
            yield flush()
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != media)
    return df.mapInArrow(run, f"{fields}, {PAGE_FIELDS}" if fields else PAGE_FIELDS)


def described(stored: DataFrame) -> DataFrame:
    """Adds media_bytes, media_sha256 and file, a number of the row's own."""
    return stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256), "file": F.monotonically_increasing_id()})


class _Payload:
    """What is known of a file's samples while its pages pass."""

    def __init__(self):
        self.sha, self.size, self.tail, self.counts, self.edges, self.pages, self.faults = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, 0, 0
        self.kinds: dict[int, None] = {}

    def add(self, pixels: bytes | None, kind: int | None) -> None:
        if pixels is None:
            self.faults += 1
            return
        x = np.frombuffer(self.tail[-1:] + pixels, np.uint8)
        self.edges += int(np.count_nonzero(x[1:] != x[:-1]))
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        self.sha.update(pixels)
        self.size, self.pages, self.tail = self.size + len(pixels), self.pages + 1, (self.tail + pixels[-64:])[-64:]
        self.kinds[kind] = None

    def row(self) -> tuple:
        if not self.pages:
            return None, None, None, f"f{self.faults}"
        value, n = np.arange(256), max(1, self.size)
        mean = float((self.counts * value).sum()) / n
        spread = (max(0.0, float((self.counts * value**2).sum()) / n - mean**2)) ** 0.5
        feature = f"c{'+'.join(map(str, self.kinds))}:p{self.pages}:m{mean:.3f}:s{spread:.3f}:e{self.edges}:h" + "-".join(map(str, self.counts.reshape(8, 32).sum(axis=1)))
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), feature + f":f{self.faults}" * (self.faults > 0)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(pages: DataFrame) -> DataFrame:
    """tiff_pages(described(...)) -> a row per file: its samples' size, digest, tail and features, over all of its pages.

    Pages of a file follow each other in a task, so no rows move and one page is held at a time.  Pages that can't be read
    are left out and counted in feature (f1, ...); a file without a readable page has nulls there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, about, payload = None, (), _Payload()

        def frame() -> pa.RecordBatch:
            rows = [(d, n, size, sha, tail, m, digest, feature) for (d, n, m, digest), (size, sha, tail, feature) in done]
            fields = [f.split() for f in _FEATURES.split(", ")]
            columns = list(zip(*rows)) or [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

        for batch in batches:
            columns = [batch.column(c) for c in ("file", "doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels", "compression")]
            for row in zip(*columns):
                file = row[0].as_py()
                if file != now:
                    if now is not None:
                        done.append((about, payload.row()))
                    now, about, payload = file, tuple(x.as_py() for x in row[1:5]), _Payload()
                payload.add(row[5].as_py(), row[6].as_py())
            if len(done) >= 5_000:
                yield frame()
                done = []
        if now is not None:
            done.append((about, payload.row()))
        yield frame()

    return pages.select("file", "doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels", "compression").mapInArrow(run, _FEATURES)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as TIFF files in a column, read back as pages, with features of their samples."""
    return features(tiff_pages(described(store_texts(table(spark, sf_dir, "documents", "doc_id", "text"), PAGE_ROWS))))
