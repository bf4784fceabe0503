"""Reading and writing frames as files, without an imaging library.

Baseline TIFF (8 and 16 bits, gray, RGB or RGBA, uncompressed or deflate) and
PNG (8 and 16 bits) are decoded and encoded with numpy and zlib; samples keep
their depth and come in B, G, R order.  JPEG is written with numpy and read by
Spark's image source, which is limited to 8 bits; its orientation is applied.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators._frames import per_frame, starts_of

#: Field types of a TIFF directory and their sizes in bytes (fixed values).
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
#: TIFF tags used here (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS = 270, 273, 277, 278, 279
X_RES, Y_RES, PLANAR, UNIT, SOFTWARE, PREDICTOR, ICC = 282, 283, 284, 296, 305, 317, 34675
ORIENTATION, COMMENT = 274, 40092
DEFLATE = (8, 32946)


def _tiff_tags(data: bytes, directory: bytes | None = None) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags; with the ``directory`` cut out, ``data`` may end before it, and long values are left out."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    table, at = (data, at) if directory is None else (directory, 0)
    tags = {}
    for i in range(struct.unpack_from(order + "H", table, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", table, at + 2 + 12 * i)
        size = TIFF_SIZES.get(kind, 1) * n
        spot, held = at + 10 + 12 * i, table
        if size > 4:
            spot, held = struct.unpack_from(order + "I", table, spot)[0], data
            if spot + size > len(held):
                continue
        if kind in (3, 4):
            tags[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", held, spot)
        elif kind == 5:
            tags[tag] = struct.unpack_from(f"{order}{2 * n}I", held, spot)
        else:
            tags[tag] = (held[spot : spot + size],)
    return order, tags


def read_tiff(data: bytes) -> np.ndarray:
    order, tags = _tiff_tags(data)
    w, h, n = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, packed = tags.get(BITS, (1,))[0], tags.get(COMPRESSION, (1,))[0]
    if bits not in (8, 16) or packed not in (1, *DEFLATE) or tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError("unsupported TIFF")
    strips = [data[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True)]
    raw = b"".join(zlib.decompress(s) if packed in DEFLATE else s for s in strips)
    a = np.frombuffer(raw, np.uint8 if bits == 8 else np.dtype(np.uint16).newbyteorder(order), h * w * n)
    a = a.reshape(h, w, n).astype(np.uint8 if bits == 8 else np.uint16)
    if tags.get(PREDICTOR, (1,))[0] == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return bgr(a)


def read_png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    w, h, bits, colour, _, _, laced = head
    if bits not in (8, 16) or laced:
        raise ValueError("unsupported PNG")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = n * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w, step), dtype=np.uint8)
    for y in range(h):
        out[y + 1] = _unfiltered(lines[y, 0], lines[y, 1:].reshape(w, step), out[y])
    a = out[1:]
    a = a.reshape(h, w, n) if bits == 8 else np.ascontiguousarray(a).view(">u2").reshape(h, w, n).astype(np.uint16)
    if palette is not None and colour == 3:
        a = palette[a[..., 0]]
    return bgr(a[..., :1] if n == 2 else a)


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + up
    left, corner = np.zeros(line.shape[1], int), np.zeros(line.shape[1], int)
    out = np.empty_like(line)
    for x in range(len(line)):
        b = up[x].astype(int)
        if kind == 3:
            guess = (left + b) // 2
        else:
            p = left + b - corner
            pa, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, corner))
        left = (line[x] + guess) & 255
        corner, out[x] = b, left
    return out


def bgr(a: np.ndarray) -> np.ndarray:
    """Three channels, B first: gray is repeated, alpha is dropped."""
    if a.ndim == 2:
        a = a[..., None]
    return np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., 2::-1]


def write_tiff(image: np.ndarray, bits: int | None = None, icc: bytes | None = None, dpi: tuple[int, int] | None = None, about: str | None = None) -> bytes:
    """A deflate TIFF; ``bits`` 16 widens 8-bit samples (255 to 65535), 8 keeps the high byte."""
    a = np.asarray(image)
    if bits == 16 and a.dtype == np.uint8:
        a = a.astype(np.uint16) * 257
    elif bits == 8 and a.dtype == np.uint16:
        a = (a >> 8).astype(np.uint8)
    a = a[..., None] if a.ndim == 2 else a[..., 2::-1] if a.shape[2] == 3 else np.concatenate([a[..., 2::-1], a[..., 3:]], axis=2)
    h, w, n = a.shape
    raw = zlib.compress(np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes())
    entries: list[tuple[int, int, int, bytes]] = []

    def short(tag: int, *v: int) -> None:
        entries.append((tag, 3, len(v), struct.pack(f"<{len(v)}H", *v)))

    def long(tag: int, v: int) -> None:
        entries.append((tag, 4, 1, struct.pack("<I", v)))

    long(WIDTH, w)
    long(HEIGHT, h)
    short(BITS, *[a.dtype.itemsize * 8] * n)
    short(COMPRESSION, 8)
    short(PHOTOMETRIC, 2 if n >= 3 else 1)
    entries += _about(about)
    long(OFFSETS, 8)
    short(SAMPLES, n)
    long(ROWS, h)
    long(COUNTS, len(raw))
    if dpi:
        for tag, v in ((X_RES, dpi[0]), (Y_RES, dpi[1])):
            entries.append((tag, 5, 1, struct.pack("<2I", v, 1)))
        short(UNIT, 2)
    if icc:
        entries.append((ICC, 7, len(icc), icc))
    start = 8 + len(raw) + len(raw) % 2
    return b"II*\0" + struct.pack("<I", start) + raw + b"\0" * (len(raw) % 2) + _directory(entries, start)


def _about(about: str | None, orientation: int | None = None) -> list[tuple[int, int, int, bytes]]:
    """Directory entries that say where a file comes from, in the three places that viewers show."""
    if not about and not orientation:
        return []
    entries = []
    if about:
        text, wide = about.encode() + b"\0", about.encode("utf-16-le") + b"\0\0"
        entries = [(DESCRIPTION, 2, len(text), text), (SOFTWARE, 2, len(text), text), (COMMENT, 1, len(wide), wide)]
    if orientation:
        entries.append((ORIENTATION, 3, 1, struct.pack("<H", orientation)))
    return entries


def _directory(entries: list[tuple[int, int, int, bytes]], start: int) -> bytes:
    """A directory at ``start`` of its file, and behind it the values that don't fit into its entries."""
    spare = start + 2 + 12 * len(entries) + 4
    directory, tail = struct.pack("<H", len(entries)), b""
    for tag, kind, count, value in sorted(entries):
        if len(value) <= 4:
            spot = value.ljust(4, b"\0")
        else:
            spot, tail = struct.pack("<I", spare + len(tail)), tail + value + b"\0" * (len(value) % 2)
        directory += struct.pack("<HHI", tag, kind, count) + spot
    return directory + b"\0" * 4 + tail


#: Quantisation of luminance and colour at quality 50, row by row (fixed values of the JPEG standard, annex K).
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)  # the first quarter; all else is 99
#: Code symbols: sizes of first coefficients, and runs with sizes of the others.  All codes of a table have one
#: length, so tables need no statistics.
FIRSTS, OTHERS = list(range(12)), [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]


def _zigzag() -> np.ndarray:
    y, x = np.divmod(np.arange(64), 8)
    d = y + x
    return np.lexsort((np.where(d % 2, y, x), d))


def _tables(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    chroma = np.full((8, 8), 99)
    chroma[:4, :4] = np.array(CHROMA).reshape(4, 4)
    return [np.clip((np.array(t).reshape(8, 8) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMA, chroma)]


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of coefficients in bits, and the bits that tell them."""
    size = np.ceil(np.log2(np.abs(values) + 1)).astype(int)
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def write_jpeg(image: np.ndarray, quality: int = 95, about: str | None = None, icc: bytes | None = None, dpi: tuple[int, int] | None = None, orientation: int | None = None) -> bytes:
    """A baseline JPEG without colour subsampling; 16-bit samples keep their high byte."""
    a = np.asarray(image)
    a = np.repeat(a.reshape(*a.shape[:2], -1)[..., :1], 3, axis=2) if a.ndim == 2 or a.shape[2] < 3 else a[..., :3]
    a = (a >> 8 if a.dtype == np.uint16 else a).astype(float)
    h, w = a.shape[:2]
    a = np.pad(a, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    b, g, r = (a[..., c] for c in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    blocks = planes.reshape(3, a.shape[0] // 8, 8, a.shape[1] // 8, 8).transpose(1, 3, 0, 2, 4)
    blocks = basis @ blocks @ basis.T  # block row, block column, component
    tables = _tables(quality)
    steps = np.stack([tables[0], tables[1], tables[1]])
    rows = np.rint(blocks / steps).astype(int).reshape(-1, 64)[:, _zigzag()]
    first = rows[:, 0].reshape(-1, 3)
    diff = np.diff(first, axis=0, prepend=0).ravel()
    size, bits = _codes(diff)
    block, at = np.nonzero(rows[:, 1:])
    value = rows[block, at + 1]
    run = at - np.where(np.append(True, block[1:] != block[:-1]), -1, np.append(-1, at[:-1])) - 1
    own, extra = _codes(value)
    rank = {s: i for i, s in enumerate(OTHERS)}
    code = np.array([rank.get(s, 0) for s in range(256)])
    skips = run >> 4  # runs of 16 zeros come before
    skip = np.repeat(np.arange(len(block)), skips)
    last = np.full(len(rows), -1)
    last[block] = at  # in order, so the last one stays
    end = np.nonzero(last < 62)[0]
    parts = [  # block, place in it, order there; code and its length
        (np.arange(len(rows)), np.full(len(rows), -1), 0, (size << size) | bits, 4 + size),
        (block[skip], at[skip], 0, np.full(len(skip), code[0xF0]), np.full(len(skip), 8)),
        (block, at, 1, (code[(run & 15) << 4 | own] << own) | extra, 8 + own),
        (end, np.full(len(end), 64), 0, np.full(len(end), code[0]), np.full(len(end), 8)),
    ]
    order = np.lexsort([np.concatenate([np.broadcast_to(p[i], len(p[0])) for p in parts]) for i in (2, 1, 0)])
    codes, sizes = (np.concatenate([p[i] for p in parts])[order] for i in (3, 4))
    ends = np.cumsum(sizes)
    spot = np.repeat(ends, sizes) - np.arange(int(ends[-1])) - 1
    stream = (np.repeat(codes, sizes) >> spot & 1).astype(np.uint8)
    packed = np.packbits(np.append(stream, np.ones(-len(stream) % 8, np.uint8))).tobytes().replace(b"\xff", b"\xff\0")

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 255, mark, len(body) + 2) + body

    def table(kind: int, symbols: list[int], length: int) -> bytes:
        counts = bytes(len(symbols) if i == length else 0 for i in range(1, 17))
        return bytes([kind]) + counts + bytes(symbols)

    x_dpi, y_dpi = dpi or (1, 1)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1" + struct.pack(">BHHBB", 1 if dpi else 0, x_dpi, y_dpi, 0, 0))
    entries = _about(about, orientation)
    if entries:
        out += segment(0xE1, b"Exif\0\0II*\0" + struct.pack("<I", 8) + _directory(entries, 8))
    pieces = [icc[i : i + 65_000] for i in range(0, len(icc), 65_000)] if icc else []
    for i, part in enumerate(pieces, 1):
        out += segment(0xE2, b"ICC_PROFILE\0" + bytes([i, len(pieces)]) + part)
    for i, t in enumerate(tables):
        out += segment(0xDB, bytes([i]) + bytes(t.ravel()[_zigzag()].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    out += segment(0xC4, table(0, FIRSTS, 4) + table(0x10, OTHERS, 8))
    out += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return out + packed + b"\xff\xd9"


def write_png(image: np.ndarray) -> bytes:
    a = np.asarray(image)
    a = a[..., None] if a.ndim == 2 else a[..., 2::-1] if a.shape[2] == 3 else np.concatenate([a[..., 2::-1], a[..., 3:]], axis=2)
    h, w, n = a.shape
    rows = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    raw = zlib.compress(np.column_stack([np.zeros(h, np.uint8), rows]).tobytes())

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, a.dtype.itemsize * 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", raw) + chunk(b"IEND", b"")


def header(data: bytes, directory: bytes | None = None) -> tuple[int, int] | None:
    """Width and height from the first bytes of a PNG, TIFF or JPEG; None if unreadable.

    The ``directory`` of a TIFF may be given apart, as it can stand anywhere.
    """
    try:
        if data[:4] == b"\x89PNG":
            return struct.unpack_from(">II", data, 16)
        if data[:2] in (b"II", b"MM"):
            _, tags = _tiff_tags(data, directory or None)
            return tags[WIDTH][0], tags[HEIGHT][0]
        for mark, at, _ in _segments(data):
            if 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):
                h, w = struct.unpack_from(">HH", data, at + 1)
                return w, h
    except (struct.error, KeyError, ValueError, IndexError):
        pass
    return None


def _segments(data: bytes):
    """(mark, start, end) of a JPEG's segments before its samples."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data):
        mark, n = struct.unpack_from(">HH", data, at)
        if not 0xFFC0 <= mark <= 0xFFFE or mark == 0xFFDA:
            return
        yield mark, at + 4, at + 2 + n
        at += 2 + n


def orientation_of(data: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 if it has none."""
    try:
        for mark, at, end in _segments(data):
            if mark == 0xFFE1 and data[at : at + 6] == b"Exif\0\0":
                return _tiff_tags(data[at + 6 : end])[1].get(ORIENTATION, (1,))[0]
    except (struct.error, KeyError, ValueError, IndexError):
        pass
    return 1


#: Readers in the order they are tried.
READERS: tuple[tuple[str, Callable[[bytes], np.ndarray]], ...] = (("png", read_png), ("tiff", read_tiff))


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """Apply an EXIF orientation of 1 to 8."""
    if orientation in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return a


IMAGE = "struct<width:int,height:int,channels:int,bit_depth:int,data:binary>"
ATTEMPTS = "array<struct<reader:string,why:string>>"


def decode(content: Column) -> Column:
    """``struct(image, attempts)``: the first reader that succeeds, and why others failed."""

    @F.pandas_udf(f"struct<image:{IMAGE},attempts:{ATTEMPTS}>")
    def run(data: pd.Series) -> pd.DataFrame:
        images, attempts = [], []
        for raw in data:
            tried, found = [], None
            for name, reader in READERS:
                try:
                    a = reader(bytes(raw))
                    h, w, n = a.shape
                    found = {"width": w, "height": h, "channels": n, "bit_depth": a.dtype.itemsize * 8, "data": np.ascontiguousarray(a).tobytes()}
                    break
                except Exception as e:  # noqa: BLE001  a reader's reason is the result here
                    tried.append({"reader": name, "why": f"{type(e).__name__}: {e}"[:200]})
            images.append(found)
            attempts.append(tried)
        return pd.DataFrame({"image": images, "attempts": attempts})

    return run(content)


#: Bytes of a file that hold its header, and of a TIFF its directory.
HEAD, DIRECTORY = 1 << 16, 1 << 12


def _tiff_directory(content: Column) -> Column:
    """The bytes at the offset that a TIFF's header names; nothing for other files."""
    raw = F.hex(F.substring(content, 5, 4))
    swapped = F.concat(*[F.substring(raw, i, 2) for i in (7, 5, 3, 1)])
    kind = F.hex(F.substring(content, 1, 2))
    at = F.conv(F.when(kind == "4949", swapped).when(kind == "4D4D", raw), 16, 10).cast("bigint")
    return F.when(at < 2**31 - 1, content.substr(at.cast("int") + 1, F.lit(DIRECTORY)))


def header_size(content: Column) -> Column:
    """``struct(width, height)`` of a file's bytes, of which only the header goes to Python; null if unreadable."""

    @F.pandas_udf("struct<width:int,height:int>")
    def run(head: pd.Series, directory: pd.Series) -> pd.DataFrame:
        found = [header(bytes(h), d and bytes(d)) or (None, None) for h, d in zip(head, directory, strict=True)]
        return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")

    return run(F.substring(content, 1, HEAD), _tiff_directory(content))


def _turned(image: Column, head: Column) -> Column:
    """The image turned as the EXIF orientation of its JPEG says."""

    @F.pandas_udf(IMAGE)
    def run(rows: pd.DataFrame, heads: pd.Series) -> pd.DataFrame:
        out = []
        for r, head_ in zip(rows.itertuples(index=False), heads, strict=True):
            a = _array(r)
            a = np.ascontiguousarray(oriented(a, orientation_of(bytes(head_))))
            out.append((a.shape[1], a.shape[0], a.shape[2], r.bit_depth, a.tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "channels", "bit_depth", "data"])

    return run(image, head)


def _array(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8 if r.bit_depth == 8 else np.uint16).reshape(int(r.height), int(r.width), int(r.channels))


def frames(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """``(path, stem, ext, length, image, attempts)`` of the image files under ``path``.

    PNG and TIFF are read here, what these readers can't read and is called
    JPEG by Spark's image source, and turned as its EXIF orientation says.
    Unreadable files have a null image and the list of attempts; failing reads
    are retried by Spark's task retry.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    files = files.withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", "")).withColumn("ext", ext).where(ext.isin(*suffixes))
    files = files.withColumn("_key", F.col("_metadata.file_path"))
    jpeg = ext.isin("jpg", "jpeg")
    cols = ["path", "stem", "ext", "length"]
    plain = files.where(~jpeg).withColumn("_d", decode(F.col("content"))).select(*cols, "_d.image", "_d.attempts")
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(path)
    found = found.select(F.col("_metadata.file_path").alias("_key"), "image.width", "image.height", "image.nChannels", F.col("image.data").alias("_bytes"))
    gray = F.col("nChannels") == 1
    good = (F.col("width") > 0) & F.col("nChannels").isin(1, 3, 4)
    image = F.struct("width", "height", F.col("nChannels").alias("channels"), F.lit(8).alias("bit_depth"), F.col("_bytes").alias("data"))
    why = F.array(F.struct(F.lit("jvm").alias("reader"), F.lit("no image").alias("why")))
    joined = files.where(jpeg).join(found.where(good | gray), "_key", "left")
    head = F.substring("content", 1, HEAD)
    read = joined.where(good).withColumn("image", _turned(image, head)).select(*cols, "image", F.array().cast(ATTEMPTS).alias("attempts"))
    unread = joined.where(~F.coalesce(good, F.lit(False))).select(*cols, F.lit(None).cast(IMAGE).alias("image"), why.cast(ATTEMPTS).alias("attempts"))
    return plain.unionByName(read).unionByName(unread)


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, width, height)`` from the headers; null where unreadable.  Only headers go to Python."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("_s", header_size(F.col("content"))).select("path", "_s.width", "_s.height")


def read_mask(spark: SparkSession, path: str, above: int = 127) -> DataFrame:
    """``(y, x)``: the pixels of a mask image above a level; an error if there is no such image."""
    found = frames(spark, path)
    if found.where(F.col("image").isNotNull()).isEmpty():
        raise FileNotFoundError(f"no readable mask at {path}")
    px = samples(found.withColumn("frame_idx", F.lit(0)))
    return px.where(F.greatest("b", "g", "r") > above).select("y", "x")


def assembled(px: DataFrame, bits: int = 8) -> DataFrame:
    """``(f, image)``: tall samples ``(f, y, x, b, g, r)`` as images, a frame to a row; missing pixels are 0."""

    def kernel(t: pa.Table) -> pa.Table:
        f, y, x, *v = (t.column(c).to_numpy() for c in ("f", "y", "x", "b", "g", "r"))
        at = starts_of(f)
        rows = []
        for lo, hi in zip(at, np.append(at[1:], len(f)), strict=True):
            s = slice(lo, hi)
            a = np.zeros((int(y[s].max()) + 1, int(x[s].max()) + 1, 3), np.uint8 if bits == 8 else np.uint16)
            a[y[s], x[s]] = np.stack([c[s] for c in v], axis=1)
            rows.append((f[lo], a.shape[1], a.shape[0], 3, bits, a.tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (t.schema.field("f").type, *[pa.int32()] * 4, pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["f", "width", "height", "channels", "bit_depth", "data"])

    kind = px.schema["f"].dataType.simpleString()
    shape = f"f {kind}, width int, height int, channels int, bit_depth int, data binary"
    rows = per_frame(px.select("f", "y", "x", "b", "g", "r"), ["f"], kernel, shape)
    return rows.select("f", F.struct("width", "height", "channels", "bit_depth", "data").alias("image"))


def samples(found: DataFrame, index: str = "frame_idx") -> DataFrame:
    """Decoded images as tall samples ``(f, y, x, b, g, r)``."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for f, im in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                kind = np.uint8 if im["bit_depth"] == 8 else np.uint16
                a = np.frombuffer(im["data"], kind).reshape(im["height"], im["width"], 3).astype(np.int32)
                y, x = np.divmod(np.arange(im["height"] * im["width"], dtype=np.int32), np.int32(im["width"]))
                cols = [pa.array(np.full(len(y), f)), pa.array(y), pa.array(x), *(pa.array(a[..., c].ravel()) for c in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["f", "y", "x", "b", "g", "r"])

    rows = found.where(F.col("image").isNotNull()).select(F.col(index).cast("bigint").alias("f"), "image")
    return rows.mapInArrow(run, "f bigint, y int, x int, b int, g int, r int")


#: File suffixes of the kinds of output.
SUFFIX = {"jpeg": "jpg", "png": "png", "tif8": "tif", "tif16": "tif"}


def encoded(a: np.ndarray, kind: str, quality: int = 95, icc: bytes | None = None, dpi: tuple[int, int] | None = None, about: str | None = None) -> bytes:
    """File bytes of an array; 16-bit TIFFs get no description, PNGs no metadata."""
    if kind == "png":
        return write_png(a)
    if kind == "jpeg":
        return write_jpeg(a, quality, about, icc, dpi)
    return write_tiff(a, 16 if kind == "tif16" else 8, icc, dpi, about if kind == "tif8" else None)


def encode(image: Column, kind: str = "tif16", **options) -> Column:
    """File bytes of an image struct: ``tif16``, ``tif8``, ``png`` or ``jpeg`` (see ``encoded``)."""

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([encoded(_array(r), kind, **options) for r in rows.itertuples(index=False)], dtype=object)

    return run(image)


def write_frames(found: DataFrame, folder: str, kind: str = "tif16", **options) -> None:
    """Write ``(stem, file)`` rows as parquet: the canonical output of a run."""
    found.select("stem", encode(F.col("image"), kind, **options).alias("file")).write.mode("overwrite").parquet(folder)


def write_files(found: DataFrame, folder: str, kind: str = "tif16", **options) -> DataFrame:
    """Write each image of ``(stem, image)`` as a file ``stem.suffix`` and say what was written: ``(stem, path, n_bytes)``.

    ``folder`` is a path or address that all executors can write.  A file is
    written aside and then renamed, so a task that runs again leaves whole files.
    """

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for stem, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{stem}.{SUFFIX[kind]}"
                aside = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, path)
                rows.append((stem, path, len(data)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], ["stem", "path", "n_bytes"])

    files = found.where(F.col("image").isNotNull()).select("stem", encode(F.col("image"), kind, **options).alias("file"))
    written = files.mapInArrow(run, "stem string, path string, n_bytes bigint")
    return found.sparkSession.createDataFrame(written.collect(), written.schema)  # names and sizes of the files of a run
