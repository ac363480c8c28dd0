"""GIF media columns: code streams, palettes, disposal and transparency, timed frames and colour histograms.

Reading follows the GIF89a format: `layout` finds the blocks, `decoded` decodes an image's LZW code stream, and
`compose` applies palettes and draws the frames on the canvas under their disposal and transparency rules.
`encode` writes 8-bit samples as an animated GIF without loss. `gif_frames` and `payload_media` are the
DataFrame operators.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import texts

#: Row width of stored payloads, and rows in a frame.
WIDTH, ROWS = 64, 4096
TABLE = 4096
#: First rows and row steps of the four passes of an interlaced image (fixed by the format).
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
#: Pixels of a canvas or an image, at most: a header may claim 2^32 of them, and a code may stand for thousands.
MOST_PIXELS = 1 << 24


class GifError(ValueError):
    """The bytes are not a whole GIF."""


@dataclass
class Image:
    """One image of a GIF as it is stored."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None
    size: int
    code: bytes


@dataclass
class Frame:
    """An image with its palette indices, before it is composed."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


@cache
def _widths(size: int, codes: int) -> np.ndarray:
    """Bits of the codes after a clear code: with code k, 2^size + 1 + k entries exist."""
    entries = np.minimum((1 << size) + 1 + np.arange(codes), TABLE - 1)
    return np.maximum(size + 1, np.floor(np.log2(entries)).astype(np.int64) + 1)


@cache
def _offsets(size: int, codes: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(_widths(size, codes))])


def lzw_decode(data: bytes, size: int, pixels: int) -> bytes:
    """The samples of a code stream with `size` initial bits; stops at the end code or after `pixels`.

    The width of a code depends only on how many codes follow the last clear code, so the codes up to
    the next clear are cut out of the bit stream at once, and resolved together.
    """
    clear, end = 1 << size, (1 << size) + 1
    bits = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, made = 8 * len(data), 0, 0
    out: list[bytes] = []
    while made < pixels:
        window = TABLE
        while True:
            widths, offsets = _widths(size, window), _offsets(size, window)
            fits = int(np.searchsorted(offsets[1:], total - at, side="right"))
            where = at + offsets[:fits]
            byte = where >> 3
            codes = ((bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (where & 7)) & ((1 << widths[:fits]) - 1)
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or fits < window:
                break
            window *= 2  # the clear code is deferred
        n = int(stops[0]) if len(stops) else fits
        if n:
            out.append(_resolve(codes[:n], clear))
            made += len(out[-1])
        if not len(stops) or codes[n] == end:
            break
        at += int(offsets[n + 1])
    return b"".join(out)[:pixels]


def _resolve(codes: np.ndarray, clear: int) -> bytes:
    """The samples of the codes between two clear codes.

    The entry that code k adds is the string of code k and one sample more, which is contiguous in the
    output. So every sample of a later code is a copy from a known place, and following all copies
    at once (pointer jumping) ends at samples that are codes of their own.
    """
    n = len(codes)
    if (codes < clear).all():
        return codes.astype(np.uint8).tobytes()
    later = codes > clear
    parent = np.where(later, codes - clear - 2, np.arange(n))
    if (parent[later] >= np.flatnonzero(later)).any():
        raise GifError("a code without an entry")
    steps, up = later.astype(np.int64), parent
    while (more := steps[up]).any():
        steps, up = steps + more, up[up]
    lengths = steps + 1
    ends = np.cumsum(lengths)
    start = ends - lengths
    source = np.arange(int(ends[-1])) - np.repeat(start - start[parent], lengths)
    while not np.array_equal(further := source[source], source):
        source = further
    own = np.zeros(int(ends[-1]), dtype=np.uint8)
    own[start[~later]] = codes[~later]
    return own[source].tobytes()


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """A code stream of the samples; the table is cleared when it is full."""
    clear = 1 << size
    codes: list[int] = [clear]
    emit = codes.append
    entries: dict[int, int] = {}
    get = entries.get
    new = clear + 2
    prefix = -1
    for b in samples:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        entries[key] = new
        new += 1
        prefix = b
        if new == TABLE:
            emit(prefix)
            emit(clear)
            entries.clear()
            new, prefix = clear + 2, -1
    if prefix >= 0:
        emit(prefix)
    emit(clear + 1)
    return _bit_stream(np.array(codes, dtype=np.int64), size)


def _bit_stream(codes: np.ndarray, size: int) -> bytes:
    """Codes as bits, least significant first, at the widths that the decoder will expect."""
    starts = np.flatnonzero(codes == 1 << size)
    runs = np.diff(np.concatenate([starts, [len(codes)]]))
    known = _widths(size, TABLE)
    widths = known[np.maximum(np.arange(len(codes)) - np.repeat(starts, runs) - 1, 0)]
    widths[starts] = np.concatenate([[size + 1], known[runs[:-1] - 1]])  # a clear code has the width of the code before which it stands
    ends = np.cumsum(widths)
    at = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, dtype=np.int64)
    value, byte = codes << (at & 7), at >> 3
    for k in range(3):  # neighbouring codes share bytes, but no bits
        out += np.bincount(byte + k, weights=(value >> (8 * k)) & 255, minlength=len(out)).astype(np.int64)
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of at most 255 bytes, with the terminator."""
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(samples: bytes, *, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100) -> bytes:
    """8-bit samples (a positive multiple of width) as a GIF of grey frames of at most `rows` rows, each
    opaque and left in place, so that the frames' samples in order are the payload."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    grey = bytes(v for k in range(256) for v in (k, k, k))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey]
    for at in range(0, len(samples), width * rows):
        part = samples[at : at + width * rows]
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_ms // 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(parts) + b"\x3b"


def layout(data: bytes, most_pixels: int = MOST_PIXELS) -> tuple[int, int, list[Image]]:
    """Canvas width and height, and the images, none of which is decoded yet. Raises GifError on blocks that aren't
    whole, and on canvases and images of more than most_pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise GifError("the canvas is too large")
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise GifError("a palette is cut off")
        colours = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
        at += 3 * n
        return colours

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while True:
            if at >= len(data):
                raise GifError("a block is cut off")
            n = data[at]
            at += 1
            if not n:
                return b"".join(parts)
            if at + n > len(data):
                raise GifError("a block is cut off")
            parts.append(data[at : at + n])
            at += n

    shared, images = palette(flags), []
    delay, disposal, transparent = 0, 0, None
    while True:
        if at >= len(data):
            raise GifError("no trailer")
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return width, height, images
        if kind == 0x21:
            label, at = data[at] if at < len(data) else -1, at + 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                control, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = 10 * hundredths, control >> 2 & 7, index if control & 1 else None
        elif kind == 0x2C:
            if at + 9 > len(data):
                raise GifError("an image is cut off")
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = palette(local)
            if at >= len(data) or not 1 <= data[at] <= 8:
                raise GifError("no code size")
            size, at = data[at], at + 1
            if w * h > most_pixels:
                raise GifError("an image is too large")
            chosen = colours if colours is not None else shared
            if chosen is None:
                raise GifError("no palette")
            images.append(Image(left, top, w, h, bool(local & 0x40), chosen, delay, disposal, transparent, size, sub_blocks()))
            delay, disposal, transparent = 0, 0, None
        else:
            raise GifError("an unknown block")


def decoded(image: Image) -> Frame:
    """The image's frame. Raises GifError where its code stream isn't whole."""
    w, h = image.width, image.height
    samples = lzw_decode(image.code, image.size, w * h)
    if len(samples) < w * h:
        raise GifError("an image has too few samples")
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
    if image.interlaced:
        order = np.concatenate([np.arange(first, h, step) for first, step in PASSES])
        plain = np.empty_like(rows)
        plain[order] = rows
        rows = plain
    return Frame(image.left, image.top, rows, image.palette, image.delay_ms, image.disposal, image.transparent)


def parse(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and all frames. Raises GifError on anything that isn't whole."""
    width, height, images = layout(data)
    return width, height, [decoded(x) for x in images]


def compose(width: int, height: int, frames: Iterable[Frame]) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA) as shown at each frame; the frames are taken one by one.

    Disposal 2 clears the frame's place to transparent and 3 restores what was there before; 0, 1 and
    reserved values leave it. Parts of a frame beyond the canvas are not drawn; indices beyond the
    palette are black.
    """
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        here = canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1]]
        samples = f.samples[: here.shape[0], : here.shape[1]]
        before = here.copy() if f.disposal == 3 else None
        colours = np.zeros((256, 3), dtype=np.uint8)
        colours[: len(f.palette)] = f.palette
        drawn = np.dstack([colours[samples], np.full(samples.shape, 255, dtype=np.uint8)])
        shown = samples != f.transparent if f.transparent is not None else np.ones(samples.shape, dtype=bool)
        here[shown] = drawn[shown]
        yield canvas.copy()
        if f.disposal == 2:
            here[:] = 0
        elif before is not None:
            here[:] = before


def histogram(rgba: np.ndarray, bins: int = 8) -> list[int]:
    """Counts of the visible pixels by red, green and blue, `bins` each in this order."""
    seen = rgba[rgba[..., 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c].astype(np.int64) * bins // 256, minlength=bins)]


FRAMES = "media_id string, frame int, start_ms long, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string"


def gif_frames(media: DataFrame, *, id_column: str = "media_id", content_column: str = "content", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row (FRAMES) for every composed frame of every GIF in a binary column.

    Bytes that are null, empty or no GIF with whole blocks, GIFs without images, and those with a canvas or an
    image of more than most_pixels give one row with a null frame and the reason in error. Where a code stream
    turns out broken, the frames before it are followed by such a row. Rows are independent; frames are decoded
    and leave one by one, so memory holds the stored file, one image and one canvas with its copy; repeated rows
    give equal frames; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.string()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
        for batch in batches:
            for k in range(len(batch)):
                media_id, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                empty = dict.fromkeys(schema.names) | {"media_id": media_id}
                start = 0
                try:
                    width, height, images = layout(data or b"", most_pixels)
                    if not images:
                        raise GifError("no image")
                    for n, (x, canvas) in enumerate(zip(images, compose(width, height, map(decoded, images)), strict=True)):
                        yield pa.RecordBatch.from_pylist([{"media_id": media_id, "frame": n, "start_ms": start, "delay_ms": x.delay_ms, "width": width, "height": height, "rgba": canvas.tobytes(), "histogram": histogram(canvas), "error": None}], schema)
                        start += x.delay_ms
                except GifError as e:
                    yield pa.RecordBatch.from_pylist([empty | {"error": str(e)}], schema)

    return media.select(F.col(id_column).cast("string").alias("media_id"), F.col(content_column).alias("content")).mapInArrow(run, FRAMES)


def payload(text: str, unit: int = WIDTH) -> tuple[bytes, int]:
    """UTF-8 bytes of the text with zeros up to a positive multiple of unit, and their count without zeros."""
    data = text.encode()
    return data + bytes(-len(data) % unit if data else unit), len(data)


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, duration_ms long, feature string"


def describe(text: str) -> tuple:
    """The MEDIA columns but doc_id: the text's payload is stored as a GIF, which is decoded again."""
    data, n = payload(text)
    stored = encode(data)
    width, height, images = layout(stored)
    back, counts = [], np.zeros(24, dtype=np.int64)

    def read() -> Iterator[Frame]:
        for x in images:
            frame = decoded(x)
            back.append(frame.samples.tobytes())
            yield frame

    for canvas in compose(width, height, read()):  # the code path of gif_frames
        counts += histogram(canvas)
    whole = b"".join(back)
    feature = f"{width}x{height};" + ",".join(map(str, counts.tolist()))
    return n, len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), len(images), sum(x.delay_ms for x in images), feature


def payload_media(docs: DataFrame) -> DataFrame:
    """MEDIA columns for every row of (doc_id, text): each whole text stored as a GIF and read back.

    A null text is an empty one, whose payload is 64 zeros. Rows are independent, so equal texts have
    equal values; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEDIA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in MEDIA.split(", ")]
        for batch in batches:
            at = 0
            for some in texts(batch.column(1), 256):
                columns = zip(*map(describe, some), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)
                at += len(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)
