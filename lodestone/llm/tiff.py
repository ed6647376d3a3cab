"""TIFF: image directories walked, strips and tiles decoded, one row per page.

Reads classic TIFF in either byte order, 8- and 16-bit unsigned samples, chunky or planar,
strips or tiles, no compression, PackBits (32773), LZW (5) or deflate (8, 32946), with
horizontal differencing (predictor 2). ``encode`` writes the same range, for stored
payloads and for round trips.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that a compressed byte can stand for at most.
EXPANDS = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
#: Bytes of samples of a page that is read; a larger one gives an error.
MOST_PAGE = 1 << 30
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

# Tags of TIFF 6.0: fixed values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
#: Bytes of each field type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class TiffError(ValueError):
    """The bytes are no TIFF that can be read."""


# ---------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
    raw, out, i, n = np.frombuffer(data, np.uint8), bytearray(), 0, len(data)
    if not n:
        return b""
    edge = np.flatnonzero(np.concatenate(([True], raw[1:] != raw[:-1], [True])))
    literal_from = 0
    lengths = np.diff(edge)

    def literal(a: int, b: int) -> None:
        for x in range(a, b, 128):
            y = min(b, x + 128)
            out.append(y - x - 1)
            out.extend(data[x:y])

    for r in np.flatnonzero(lengths >= 3).tolist():
        i, m = int(edge[r]), int(lengths[r])
        literal(literal_from, i)
        while m > 0:
            k = min(m, 128)
            out += bytes((257 - k if k > 1 else 0, data[i]))
            m -= k
        literal_from = int(edge[r + 1])
    literal(literal_from, n)
    return bytes(out)


def packbits_decode(data: bytes, limit: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < limit:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + c + 2]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:limit])


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; the code width grows one entry early, as TIFF writers do."""
    codes, widths = [256], [9]
    table: dict[int, int] = {}  # (code of a prefix, next byte) -> code
    width, nxt, code = 9, 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        found = table.get(key)
        if found is not None:
            code = found
            continue
        codes.append(code)
        widths.append(width)
        table[key] = nxt
        nxt += 1
        if nxt == 4095:
            codes.append(256)
            widths.append(width)
            table, width, nxt = {}, 9, 258
        elif nxt > (1 << width) - 1:
            width += 1
        code = byte
    if code >= 0:
        codes.append(code)
        widths.append(width)
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    codes.append(257)
    widths.append(width)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - np.array(widths)[:, None]]).tobytes()


def lzw_decode(data: bytes, limit: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, size = list(first), [], 0
    acc = bits = 0
    width, old = 9, b""
    for byte in data:
        acc, bits = (acc << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, old = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and old:
            entry = old + old[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(entry)
        size += len(entry)
        if size >= limit:
            break
        if old:
            table.append(old + entry[:1])
        old = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)[:limit]


def _compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == PACKBITS:
        return packbits_encode(data)
    if how == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def _decompress(data: bytes, how: int, size: int) -> bytes:
    try:
        if how == NONE:
            out = data[:size]
        elif how == PACKBITS:
            out = packbits_decode(data, size)
        elif how == LZW:
            out = lzw_decode(data, size)
        elif how in (DEFLATE, OLD_DEFLATE):
            out = zlib.decompressobj().decompress(data, size)
        else:
            raise TiffError(f"compression {how} is not supported")
    except zlib.error as e:
        raise TiffError(str(e)) from e
    if len(out) < size:
        raise TiffError("a strip or tile is short")
    return out


# ---------------------------------------------------------------- pages


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray = field(repr=False)


@dataclass(frozen=True)
class Layout:
    """How a page is stored. tile: rows and columns of a tile; without it the page is cut into strips."""

    compression: int = DEFLATE
    predictor: int = 1
    rows_per_strip: int = 1024
    tile: tuple[int, int] | None = None


def _parts(px: np.ndarray, layout: Layout) -> list[np.ndarray]:
    h, w, s = px.shape
    if not layout.tile:
        return [px[y : y + layout.rows_per_strip] for y in range(0, h, layout.rows_per_strip)]
    th, tw = layout.tile
    grid = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), px.dtype)
    grid[:h, :w] = px
    return [grid[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]


def encode(pages: list[np.ndarray], layouts: Layout | list[Layout] = Layout(), order: str = "<") -> bytes:
    """pages: arrays of uint8 or uint16, (height, width) or (height, width, samples); one directory each. layouts: one for all, or one a page."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page, layout in zip(pages, [layouts] * len(pages) if isinstance(layouts, Layout) else layouts, strict=True):
        px = page if page.ndim == 3 else page[:, :, None]
        h, w, s = px.shape
        size, tile = px.dtype.itemsize, layout.tile
        offsets, counts = [], []
        for part in _parts(px, layout):
            if layout.predictor == 2:
                d = part.copy()
                d[:, 1:] -= part[:, :-1]
                part = d
            blob = _compress(part.astype(part.dtype.newbyteorder(order)).tobytes(), layout.compression)
            offsets.append(len(out))
            counts.append(len(blob))
            out += blob
        if len(out) % 2:
            out.append(0)
        tags: dict[int, tuple[int, list[int]]] = {
            WIDTH: (4, [w]), LENGTH: (4, [h]), BITS: (3, [8 * size] * s), COMPRESSION: (3, [layout.compression]), PHOTOMETRIC: (3, [2 if s == 3 else 1]), SAMPLES: (3, [s]), PLANAR: (3, [1]), PREDICTOR: (3, [layout.predictor]),
        }
        tags |= {TILE_WIDTH: (4, [tile[1]]), TILE_LENGTH: (4, [tile[0]]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [layout.rows_per_strip]), STRIP_COUNTS: (4, counts)}
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise TiffError("a directory lies past the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("a directory is cut off")
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        size = TYPE_SIZE[kind] * count
        where = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * i + 8)[0]
        if where + size > len(data):
            raise TiffError("a field lies past the end")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{' B HI'[kind]}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, tags: dict[int, list[int]], order: str, number: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    w, h, s, how, predictor = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    bits = one(BITS, 1)
    if not w or not h or bits not in (8, 16) or len(set(tags.get(BITS, [bits]))) > 1 or predictor not in (1, 2):
        raise TiffError("not whole pages of 8- or 16-bit samples")
    kind = np.dtype(f"{order}u{bits // 8}")
    planes, chunk_s = (s, 1) if one(PLANAR, 1) == 2 and s > 1 else (1, s)
    tiled = TILE_OFFSETS in tags
    ch, cw = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS)
    across, down = -(-w // cw) if cw else 0, -(-h // ch) if ch else 0
    if not offsets or not counts or not across or not down or len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise TiffError("strips or tiles are missing")
    if h * w * s * kind.itemsize > min(MOST_PAGE, EXPANDS.get(how, 1) * sum(counts[: len(offsets)])):
        raise TiffError("a page is larger than its strips or tiles can hold, or than is read")
    px = np.zeros((h, w, s), kind.newbyteorder("="))
    for i in range(across * down * planes):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * ch, rest % across * cw
        rows = ch if tiled else min(ch, h - y)
        raw = _decompress(data[offsets[i] : offsets[i] + counts[i]], how, rows * cw * chunk_s * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(rows, cw, chunk_s).astype(px.dtype, copy=False)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=px.dtype)
        to_y, to_x = min(h, y + rows), min(w, x + cw)
        px[y:to_y, x:to_x, plane : plane + chunk_s] = part[: to_y - y, : to_x - x]
    return Page(number, w, h, s, bits, how, predictor, tiled, px)


def decode(data: bytes) -> list[Page]:
    """Every page, in the order of the chain of directories. TiffError if the bytes can't be read."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    pages, seen = [], set()
    try:
        while at:
            if at in seen:
                raise TiffError("the directories run in a circle")
            seen.add(at)
            tags, nxt = _directory(data, at, order)
            pages.append(_page(data, tags, order, len(pages)))
            at = nxt
    except struct.error as e:
        raise TiffError(str(e)) from e
    return pages


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, mean double, error string"


def tiff_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of each TIFF in the binary column `media`: key, PAGE_SCHEMA.

    Bytes that are null, empty or no readable TIFF give one row with only `error` set, so do files
    with a page of over MOST_PAGE bytes. Pixels are little-endian, row by row. Rows are independent
    (repeated ones give their pages again); nothing is shuffled; an empty table gives no rows.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{media}`").cast("binary").alias("media"))
    schema = f"key {src.schema['key'].dataType.simpleString()}, {PAGE_SCHEMA}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pages = decode(m.as_py() or b"")
                    rows = [{"key": k, "page": p.number, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": NAMES[p.compression], "predictor": p.predictor, "tiled": p.tiled, "pixels": p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), "mean": float(p.pixels.mean()), "error": None} for p in pages]
                except TiffError as e:
                    rows = [{"key": k, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return src.mapInArrow(run, schema).withColumnRenamed("key", key)


# ---------------------------------------------------------------- texts as stored media

ROW = 64
#: A text's rows are cut into as many equal pages, stored so: every decoder meets its share of the input, whatever the length.
LAYOUTS = (Layout(LZW, 1, 128), Layout(PACKBITS, 1, 128), Layout(DEFLATE, 2, 1024), Layout(DEFLATE, 1, 1024, (16, 32)))


def stored(payload: bytes) -> bytes:
    """The payload as grey pages, 64 samples a row: rows in order, cut into pages as LAYOUTS says; a text of fewer rows has a page for each."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [x for x in np.array_split(px, len(LAYOUTS)) if len(x)]
    return encode(parts, list(LAYOUTS[: len(parts)]))


def media_digest(docs: DataFrame) -> DataFrame:
    """The contract's row per document: text stored as TIFF, read back, features of the samples.

    A null text counts as empty; it and an empty text give 64 zero samples. Equal texts, and so
    repeated rows, give equal values. Texts are stored whole whatever their length; an empty table
    gives no rows; other columns are not read.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column("text"):
                text = value.as_py() or b""
                payload = text + bytes(-len(text) % ROW if text else ROW)
                media = stored(payload)
                pages = decode(media)
                back = b"".join(page.pixels.tobytes() for page in pages)
                n = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
                p = n[n > 0] / len(back)
                low = np.arange(256) @ n
                feature = f"{pages[0].width}x{sum(page.height for page in pages)};pages={len(pages)};sum={low};max={int(np.flatnonzero(n)[-1])};distinct={len(p)};entropy={abs(float(-(p * np.log2(p)).sum())):.6f}"
                for c, v in zip(cols, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return src.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_tiff_media(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents as stored and read TIFF."""
    return media_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
