"""Media columns, TIFF: a writer for byte payloads and a reader that walks image directories, one row for each page.

The reader takes either byte order, strips or tiles, chunky samples of 8 or 16 bits, and uncompressed, PackBits, LZW or
deflate data with or without horizontal differencing. Files are not trusted: no size a file names is believed beyond
what its compressed bytes could hold, what a file names twice is read once, work on a file is bounded by its bytes, and
whatever can't be read ends in a row with the reason.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, nullable, without

# Fixed values of the file format: tags, field types' sizes and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
READ = {WIDTH, HEIGHT, BITS, COMPRESSION, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS}
TYPE_SIZE = {1: 1, 3: 2, 4: 4, 13: 4}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 13: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
SINGLE = {bytes((i,)): i for i in range(256)}
#: Bytes that one compressed byte can stand for at most, and the most bytes of a page that the reader makes.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}
MOST_PAGE = 1 << 28
#: Directories, tags and parts of sound files lie apart, so together they name the file's bytes at most once; files may name them so many times.
REUSE = 2
#: Bytes after which a task hands on what it has read or written.
FLUSH = 4 << 20
RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            out.append(min(128, end - i) - 1)
            out.extend(data[i : min(i + 128, end)])

    for run in RUN.finditer(data):
        literal(run.start())
        at = run.end()
        out.extend((257 - (at - run.start()), data[at - 1]))
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes, most: int = MOST_PAGE) -> bytes:
    """At least `most` bytes, if there are so many: what comes after isn't read."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 - (k == 128)
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one code early, as the format asks."""
    # A string in the table is its prefix's code and its last byte, as one number.
    table, free, code, codes, resets = {}, 258, -1, [CLEAR], [0]
    find, emit = table.get, codes.append
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        longer = find(key)
        if longer is not None:
            code = longer
            continue
        emit(code)
        table[key] = free
        free += 1
        code = b
        if free == 4094:
            emit(CLEAR)
            table.clear()
            resets.append(len(codes) - 1)
            free = 258
    if code >= 0:
        emit(code)
    emit(END)
    return _packed(np.array(codes, np.uint64), np.array(resets))


def _packed(codes: np.ndarray, resets: np.ndarray) -> bytes:
    """The codes' bits. A code's width follows from how many codes came since the last reset."""
    since = np.arange(len(codes)) - resets[np.searchsorted(resets, np.arange(len(codes)), "right") - 1]
    # The first code after a reset adds no entry; a reset itself still has the width of the codes before it.
    at_reset = np.isin(np.arange(len(codes)), resets[1:])
    since[at_reset] = (np.arange(len(codes)) - resets[np.maximum(0, np.searchsorted(resets, np.arange(len(codes)), "left") - 1)])[at_reset]
    entries = 257 + np.maximum(0, since - 1) + 1
    width = np.where(entries >= 2048, 12, np.where(entries >= 1024, 11, np.where(entries >= 512, 10, 9)))
    width[0] = 9
    ends = np.cumsum(width)
    out = np.zeros((int(ends[-1]) + 7) // 8 + 3, np.uint32)
    first, shift = (ends - width) // 8, 24 - width - (ends - width) % 8
    bits = codes.astype(np.uint32) << shift.astype(np.uint32)
    for k in range(3):
        np.add.at(out, first + k, bits >> np.uint32(16 - 8 * k) & np.uint32(255))
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


#: Width of the code that follows so many codes since a reset: the table has 258 entries and one more for each code but the first.
WIDTH_AFTER = np.select([np.arange(4096) < 254, np.arange(4096) < 766, np.arange(4096) < 1790], [9, 10, 11], 12)


def _codes(raw: np.ndarray, at: int, since: int) -> tuple[list[int], np.ndarray]:
    """Up to 4096 codes from bit `at` on, as if no reset came, and the bit after each; raw has three bytes 0 at its end."""
    ends = at + np.cumsum(WIDTH_AFTER[np.minimum(since + np.arange(4096), 4095)])
    ends = ends[: np.searchsorted(ends, (len(raw) - 3) * 8, "right")]
    starts = np.concatenate([[at], ends[:-1]])
    first, width = starts >> 3, ends - starts
    word = raw[first] << np.uint32(16) | raw[first + 1] << np.uint32(8) | raw[first + 2]
    return (word >> (24 - width - (starts & 7)).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)).tolist(), ends


def lzw_decode(data: bytes, most: int = MOST_PAGE) -> bytes:
    """At least `most` bytes, if there are so many: what comes after isn't read."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    base = [*SINGLE, b"", b""]
    table, free, out, made, at, since, last = list(base), 258, [], 0, 0, 0, b""
    while made < most:
        codes, ends = _codes(raw, at, since)
        if not codes:
            break
        for i, code in enumerate(codes):
            if code == CLEAR or code == END:
                break
            if last:
                if code < free:
                    entry = table[code]
                elif code == free:
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code out of order")
                if free < 4096:
                    table.append(last + entry[:1])
                    free += 1
                last = entry
            elif code < 256:
                last = table[code]
            else:
                raise ValueError("LZW code out of order")
            out.append(last)
            made += len(last)
            if made >= most:
                break
        at = int(ends[i])
        if code == END:
            break
        if code == CLEAR:
            table, free, since, last = list(base), 258, 0, b""
        else:
            since += i + 1
    return b"".join(out)


def inflate(data: bytes, most: int = MOST_PAGE) -> bytes:
    return zlib.decompressobj().decompress(data, max(1, most))


ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda data: zlib.compress(data, 1)}
DECODE = {NONE: lambda data, most: data, PACKBITS: packbits_decode, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}


def difference(rows: np.ndarray) -> np.ndarray:
    """Horizontal differencing of (rows, columns, samples)."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def undifference(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=1, dtype=rows.dtype)


def write_pages(pages: list[dict]) -> bytes:
    """A little-endian file. A page: pixels (rows, columns) uint8, compression, predictor (1 or 2), and either rows (of a strip) or tile (a multiple of 16)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        pixels, code, predictor, tile = page["pixels"], page["compression"], page.get("predictor", 1), page.get("tile")
        height, width = pixels.shape
        if tile:
            padded = np.pad(pixels, ((0, -height % tile), (0, -width % tile)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [pixels[y : y + page["rows"]] for y in range(0, height, page["rows"])]
        offsets, counts = [], []
        for part in parts:
            data = ENCODE[code]((difference(part[..., None]) if predictor == 2 else part).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        place = (TILE_WIDTH, [tile]), (TILE_LENGTH, [tile]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)
        if not tile:
            place = (STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [page["rows"]]), (STRIP_COUNTS, counts)
        fields = sorted([(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [code]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *place])
        entries = bytearray()
        for tag, values in fields:
            if len(values) == 1:
                at = values[0]
            else:
                at = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            entries += struct.pack("<HHII", tag, 4, len(values), at)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


class Allowance:
    """Bytes that may still be taken: overlapping directories, tags and parts would otherwise be read over and over."""

    def __init__(self, most: int):
        self.left = most

    def take(self, n: int, what: str) -> None:
        self.left -= n
        if self.left < 0:
            raise ValueError(f"TIFF with {what} beyond what its bytes allow")


def iter_pages(data: bytes) -> Iterator[dict]:
    """The pages of a file in the order of its directories: width, height, bits, samples, compression, predictor, pixels (bytes, rows top down)."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    named, made = Allowance(REUSE * len(data)), Allowance(REUSE * len(data) + MOST_PAGE)
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        named.take(2 + 12 * n, "directories")
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag in READ and kind in TYPE_CODE:
                where = at + 10 + 12 * k
                if TYPE_SIZE[kind] * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                    named.take(TYPE_SIZE[kind] * count, "tags")
                tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where)
        yield _page(data, tags, order, named, made)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict, order: str, named: Allowance, made: Allowance) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, code, predictor = tags.get(BITS, (8,)), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    kind = {8: np.dtype("u1"), 16: np.dtype(order + "u2")}.get(bits[0]) if len(set(bits)) == 1 else None
    if kind is None or code not in DECODE or predictor not in (1, 2):
        raise ValueError(f"TIFF with {bits[0]} bits, compression {code}, predictor {predictor}")
    if one(FILL_ORDER, 1) != 1 or (samples > 1 and one(PLANAR, 1) != 1):
        raise ValueError(f"TIFF with fill order {one(FILL_ORDER, 1)}, planar configuration {one(PLANAR, 1)}")
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if not width or not height or not samples:
        raise ValueError(f"TIFF page of {width} x {height} x {samples}")
    w, h = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if not w or not h:
        raise ValueError(f"TIFF parts of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    if not len(offsets) == len(counts) == across * down:
        raise ValueError(f"{len(offsets)} offsets and {len(counts)} counts for {across * down} parts")
    there = sum(max(0, min(count, len(data) - offset)) for offset, count in zip(offsets, counts, strict=True))
    needed = (across * w * down * h if tiled else width * height) * samples * kind.itemsize
    if needed > min(MOST_PAGE, there * EXPANSION[code]):
        raise ValueError(f"TIFF page of {needed} bytes from {there}")
    # Parts may share their bytes, as blank tiles often do: these are named once and decoded once.
    distinct = set(zip(offsets, counts, strict=True))
    named.take(sum(max(0, min(count, len(data) - offset)) for offset, count in distinct), "parts")
    made.take(needed // EXPANSION[code], "pixels")
    pixels, decoded = np.zeros((height, width, samples), kind), {}
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i // across * h, i % across * w
        rows = h if tiled else min(h, height - y)
        n = rows * w * samples
        part = decoded.get((offset, count, rows))
        if part is None:
            part = np.frombuffer(DECODE[code](data[offset : offset + count], n * kind.itemsize), kind, n).reshape(rows, w, samples)
            if predictor == 2:
                part = undifference(part)
            if len(distinct) < len(offsets):
                decoded[offset, count, rows] = part
        pixels[y : y + rows, x : x + w] = part[: height - y, : width - x]
    return {"width": width, "height": height, "bits": bits[0], "samples": samples, "compression": code, "predictor": predictor, "pixels": pixels.tobytes()}


PAGE_SCHEMA = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of the files in a binary column, in order, with the other columns beside it.

    Adds page (from 0), width, height, bits, samples, compression, predictor, pixels and error. A null, empty or
    unreadable file gives one row with page null and the reason in error (null for null). Where a later page can't be read,
    those before it stay, and its row has no pixels but the reason. A page of more than MOST_PAGE bytes is such a fault, as are planes apart, bits in
    reverse, sizes that the file's bytes can't hold, and directories, tags and parts that overlap so that
    they name more than REUSE times the file (equal parts of a page count once). Repeated rows are read each by itself, null ids pass as any other,
    and an empty table gives an empty one. Columns of df named as an added one or with a leading underscore are dropped first.
    """
    parts = PAGE_SCHEMA.split(", ")
    df = without(df, *[part.split()[0] for part in parts])
    names = [c for c in df.columns if c != column]
    types = [*[pa.int32()] * 7, pa.binary(), pa.string()]

    def read(batches):
        for batch in batches:
            kept, at, rows, size = batch.select(names), [], [], 0

            def flush():
                values = zip(*rows, strict=True)
                return arrow_batch(kept.take(pa.array(at, pa.int64())), len(rows), types, **{part.split()[0]: v for part, v in zip(parts, values, strict=True)})

            for i, media in enumerate(batch.column(column)):
                media, error, n = media.as_py(), None, 0
                try:
                    for page in iter_pages(media) if media is not None else ():
                        rows.append((n, *page.values(), None))
                        at.append(i)
                        n, size = n + 1, size + len(page["pixels"])
                        if size > FLUSH:
                            yield flush()
                            at, rows, size = [], [], 0
                except KeyError as e:
                    error = f"TIFF without tag {e}"
                except (ValueError, IndexError, OverflowError, struct.error, zlib.error) as e:
                    error = str(e)[:200] or type(e).__name__
                if error is not None or not n:
                    rows.append((n or None, *[None] * 7, error))
                    at.append(i)
            if rows:
                yield flush()

    return df.select(*names, column).mapInArrow(read, nullable(df, names, PAGE_SCHEMA))


#: How op9 lays a payload out: rows of 64 bytes in pages of PAGE_ROWS, dealt to these forms in turn: compression, predictor, and strips of so many rows or square tiles.
ROW, PAGE_ROWS = 64, 256
FORMS = (
    {"compression": LZW, "rows": 128}, {"compression": PACKBITS, "tile": ROW}, {"compression": DEFLATE, "predictor": 2, "rows": 100},
    {"compression": LZW, "predictor": 2, "tile": 32}, {"compression": PACKBITS, "rows": 64}, {"compression": DEFLATE, "tile": 32},
)


def payload_file(payload: bytes) -> bytes:
    """A file whose pages, read in order, are the payload (a positive multiple of 64 bytes). The first page's form follows from the payload, so short texts too take all forms."""
    rows, first = np.frombuffer(payload, np.uint8).reshape(-1, ROW), zlib.crc32(payload)
    return write_pages([{"pixels": rows[y : y + PAGE_ROWS], **FORMS[(first + y // PAGE_ROWS) % len(FORMS)]} for y in range(0, len(rows), PAGE_ROWS)])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row: its UTF-8 text, padded with bytes 0 to a positive multiple of 64, as a TIFF.

    Null is empty. Whole texts are stored, however long, one file a row. Repeated rows are stored each, null ids pass as any
    other, an empty table gives an empty one, and other columns are not read.
    """

    def store(batches):
        for batch in batches:
            at, sizes, media, held = 0, [], [], 0
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(payload_file(raw + bytes(-len(raw) % ROW if raw else ROW)))
                held += len(media[-1])
                if held > FLUSH or i == batch.num_rows - 1:
                    yield arrow_batch(batch.select(["doc_id"]).slice(at, len(sizes)), len(sizes), [pa.int64(), pa.binary()], n_bytes=sizes, media=media)
                    at, sizes, media, held = i + 1, [], [], 0

    return docs.select("doc_id", "text").mapInArrow(store, nullable(docs, ["doc_id"], "n_bytes long, media binary"))


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def page_digests(pages: DataFrame) -> DataFrame:
    """Folds the pages of each file, which follow each other within a partition, to payload digests and features.

    Takes what tiff_pages() gives; its columns but the page's own stay. An unreadable page adds nothing; without any
    readable page the digests are those of no bytes and the feature is 'pages=0'.
    Files may repeat, ids may be null, and no pages give no rows.
    """
    page_columns = {part.split()[0] for part in PAGE_SCHEMA.split(", ")}
    names = [c for c in pages.columns if c not in page_columns]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def fold(batches):
        state, head, done = None, None, []

        def rows():
            heads, values = zip(*done, strict=True)
            kept = pa.Table.from_batches([pa.RecordBatch.from_arrays(h.columns, names=names) for h in heads]).combine_chunks().to_batches()[0]
            return arrow_batch(kept, len(done), types, **dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "feature"), zip(*values, strict=True), strict=True)))

        for batch in batches:
            kept = batch.select(names)
            for i, (page, pixels) in enumerate(zip(batch.column("page"), batch.column("pixels"), strict=True)):
                if not page.as_py():
                    if state is not None:
                        done.append((head, state.row()))
                    state, head = _Fold(), kept.slice(i, 1)
                if pixels.is_valid:
                    state.add(pixels.as_py())
            if done:
                yield rows()
                done = []
        if state is not None:
            done.append((head, state.row()))
            yield rows()

    return pages.mapInArrow(fold, nullable(pages, names, DIGESTS))


class _Fold:
    def __init__(self):
        self.sha, self.n, self.tail, self.pages, self.counts = hashlib.sha256(), 0, b"", 0, np.zeros(256, np.int64)

    def add(self, pixels: bytes) -> None:
        self.sha.update(pixels)
        self.n += len(pixels)
        self.tail = (self.tail + pixels[-64:])[-64:]
        self.pages += 1
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)

    def row(self) -> tuple:
        feature = "pages=0"
        if self.n:
            mean = int((self.counts * np.arange(256)).sum()) / self.n
            share = self.counts[self.counts > 0] / self.n
            feature = f"pages={self.pages};mean={mean:.3f};entropy={-(share * np.log2(share)).sum() + 0.0:.3f};values={len(share)}"
        return self.n, self.sha.hexdigest(), zlib.crc32(self.tail), feature


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_texts(docs).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return page_digests(tiff_pages(stored))


SQL = None
