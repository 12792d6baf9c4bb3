"""Media columns: texts as greyscale PNG images in binary columns, read back and hashed.

The writer puts bytes into rows of 8-bit samples and zlib chunks; the reader tests signature, chunk
order, lengths and checksums, inflates and undoes the five row filters with numpy.  The feature is a
perceptual hash: signs of the lowest frequencies of a cosine transform of the image.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, texts_of

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"

WIDTH = 64
_SIDE, _LOW = 32, 8
_LARGEST = (1 << 31) - 1  # bytes of one image, about as many as a row of a table can hold
_TOGETHER = 1 << 20  # samples, with those that fill up shorter images, that are unfiltered at once


class BadImage(ValueError):
    """What was stored isn't an image that this reader can vouch for."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(rows: np.ndarray, kind: int, first: np.ndarray | None = None) -> np.ndarray:
    """Rows of one-byte samples under PNG filter ``kind``, for the writer.

    ``first`` are numbers of rows with nothing above them (the first alone, if not given), so that
    several images can be filtered together.
    """
    if not kind:
        return rows
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up[1:] = rows[:-1]
    up[[0] if first is None else first] = 0
    if kind < 3:
        return rows - (left, up)[kind - 1]
    if kind == 3:
        return rows - ((left & up) + ((left ^ up) >> 1))  # half their sum, without a carry
    corner = np.zeros_like(rows)
    corner[:, 1:] = up[:, :-1]
    # Distances of left + up - corner from the three; the least wins, left before up before corner.
    high, low = np.maximum(left, up), np.minimum(left, up)
    to_left, to_up = np.maximum(up, corner) - np.minimum(up, corner), np.maximum(left, corner) - np.minimum(left, corner)
    outside = (corner >= high) | (corner <= low)  # then left or up is nearest, the corner being on the far side
    nearer = np.where(to_left <= to_up, left, up)
    to_corner = np.abs(to_left.astype(np.int16) - to_up)  # the distances have different signs within
    guess = np.where(outside | (np.minimum(to_left, to_up) <= to_corner), nearer, corner)
    return rows - guess


def unfilter_many(images: list[np.ndarray]) -> list[np.ndarray]:
    """Undo the filters of several images of one width; each has a filter byte before each row's samples.

    A sample needs those to its left, above, and above to the left, so all samples of one anti-diagonal
    of all images are undone at once.
    """
    if any(raw[:, 0].max(initial=0) > 4 for raw in images):
        raise BadImage("unknown filter")
    if not any(raw[:, 0].any() for raw in images):
        return [raw[:, 1:] for raw in images]
    width, height = images[0].shape[1] - 1, max(len(raw) for raw in images)
    steps, count = height + width - 1, len(images)
    x = np.arange(width)
    stored = np.zeros((steps + 2, count, width + 1), np.int16)  # two steps and a column of zeros before all others
    kinds = np.zeros((steps, count, width), np.uint8)
    for i, raw in enumerate(images):
        at = np.arange(len(raw))[:, None] + x
        stored[at + 2, i, x + 1] = raw[:, 1:]
        kinds[at, i, x] = raw[:, :1]
    for t in range(steps):
        here, kind = stored[t + 2, :, 1:], kinds[t]
        left, up, corner = stored[t + 1, :, :-1], stored[t + 1, :, 1:], stored[t, :, :-1]
        total = left + up
        p = total - corner
        to_left, to_up, to_corner = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        here += np.where(kind < 3, np.where(kind == 1, left, np.where(kind == 2, up, 0)), np.where(kind == 3, total >> 1, paeth))
        here &= 255
    return [stored[np.arange(len(raw))[:, None] + x + 2, i, x + 1].astype(np.uint8) for i, raw in enumerate(images)]


def unfilter(raw: np.ndarray) -> np.ndarray:
    """The same for one image."""
    return unfilter_many([raw])[0]


def write_pngs(payloads: list[bytes], width: int = WIDTH, filters: int | None = None, level: int = 6) -> list[bytes]:
    """A greyscale image of each of ``payloads``, whose lengths are positive multiples of ``width``.

    ``filters`` is a PNG filter for all rows; None picks for each row the one with the smallest sum of
    absolute differences, the first of equal ones.
    """
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    heights = [len(p) // width for p in payloads]
    ends = np.cumsum(heights)
    first = ends - heights
    if filters is None:
        kinds, least, best = np.zeros(len(rows), np.uint8), None, rows
        for kind in range(5):
            option = filter_rows(rows, kind, first)
            cost = np.abs(option.view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int32)  # -128 stays 128
            if least is None:
                least = cost
            else:
                better = cost < least
                kinds[better], least = kind, np.minimum(least, cost)
                best = np.where(better[:, None], option, best)
        rows = best
    else:
        kinds, rows = np.full(len(rows), filters, np.uint8), filter_rows(rows, filters, first)
    raw = np.concatenate([kinds[:, None], rows], axis=1)
    images = []
    for at, end in zip(first.tolist(), ends.tolist(), strict=True):
        header = struct.pack(">IIBBBBB", width, end - at, 8, 0, 0, 0, 0)
        images.append(
            SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw[at:end].data, level)) + _chunk(b"IEND", b"")
        )
    return images


def write_png(payload: bytes, width: int = WIDTH, filters: int | None = None, level: int = 6) -> bytes:
    """The same for one payload."""
    return write_pngs([payload], width, filters, level)[0]


def inflated(data: bytes) -> np.ndarray:
    """The rows of an 8-bit greyscale image, still filtered; ``BadImage`` if any part of it fails a test.

    No more is inflated than the header announces, and of that no more than ``_LARGEST`` bytes.
    """
    if data[:8] != SIGNATURE:
        raise BadImage("no signature")
    at, header, body, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise BadImage("data after the end, or a chunk cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + size]
        if len(content) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(content, zlib.crc32(kind))):
            raise BadImage(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (header is None):
            raise BadImage("a header is missing or repeated")
        if kind == b"IHDR":
            if size != 13:
                raise BadImage("a header of the wrong length")
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise BadImage(f"critical chunk {kind!r}")
        at += 12 + size
    if not ended or header is None or header[2:] != (8, 0, 0, 0, 0):
        raise BadImage("no end, or not 8-bit greyscale without interlace")
    width, height = header[:2]
    expected = height * (width + 1)
    if not width or not height or expected > _LARGEST:
        raise BadImage("empty, or larger than this reader takes")
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(b"".join(body), expected + 1)
        if len(raw) == expected and not stream.eof:
            raw += stream.decompress(stream.unconsumed_tail, 1)  # nothing but the Adler-32 sum is left
    except zlib.error as error:
        raise BadImage(str(error)) from error
    if len(raw) != expected or not stream.eof or stream.unused_data:
        raise BadImage("wrong size")
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale image; ``BadImage`` if any part of it fails a test."""
    return unfilter(inflated(data))


@functools.lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(_LOW)[:, None], np.arange(_SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * _SIDE))


def _shrink(image: np.ndarray) -> np.ndarray:
    """32 rows and 32 columns of means over (nearly) equal shares; fewer rows are repeated."""
    height, width = image.shape
    columns = image.reshape(height, _SIDE, width // _SIDE).sum(axis=2, dtype=np.int64)
    if height < _SIDE:
        return columns[np.arange(_SIDE) * height // _SIDE] / (width // _SIDE)
    cuts = np.arange(_SIDE) * height // _SIDE
    sums = np.add.reduceat(columns, cuts, axis=0)
    return sums / (np.diff([*cuts, height])[:, None] * (width // _SIDE))


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies lie above the median of all but the mean."""
    cosines = _cosines()
    low = np.round((cosines @ _shrink(image) @ cosines.T).ravel(), 6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def padded(text: bytes, width: int = WIDTH) -> bytes:
    """The bytes and as many zeros as make a positive multiple of ``width``."""
    return text + bytes(-len(text) % width if text else width)


def _groups(column: pa.Array) -> Iterator[list[int]]:
    """Numbers of the images that aren't null, of one width and about one height together."""
    shapes: dict[int, tuple[int, int]] = {}
    for i, value in enumerate(column):
        if value.is_valid:  # width and height of a well-formed header; all others are one group
            head = value.as_buffer()[16:24]
            shapes[i] = struct.unpack(">II", head) if len(head) == 8 else (0, 0)
    group: list[int] = []
    for i in sorted(shapes, key=lambda k: (*shapes[k], k)):
        width, height = shapes[i]
        if group and (width != shapes[group[0]][0] or (len(group) + 1) * (height + width) * width > _TOGETHER):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


SCHEMA = "doc_id long, n_bytes long, media binary"
_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filters: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text (null: empty) as an image in a binary column.

    One row for each input row, repeated ones too; null ids stay null; an empty table gives no rows;
    further columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, images, waiting, size = [], [], [], 0
        for text in texts_of(batch):
            data = text.encode()
            sizes.append(len(data))
            waiting.append(padded(data))
            size += len(waiting[-1])
            if size >= _TOGETHER:
                images += write_pngs(waiting, filters=filters)
                waiting, size = [], 0
        if waiting:
            images += write_pngs(waiting, filters=filters)
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"]
        )

    return map_batches(id_and_text(docs, id_col, text_col), run, SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of what is read back from the ``media`` column.

    A damaged image raises ``BadImage``; a null one gives null features.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("media")
        rows: list[tuple] = [(None,) * 6] * len(column)
        for numbers in _groups(column):
            images = unfilter_many([inflated(column[i].as_py()) for i in numbers])
            for i, image in zip(numbers, images, strict=True):
                payload, data = image.tobytes(), column[i].as_py()
                rows[i] = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data),
                    hashlib.sha256(data).hexdigest(), cosine_hash(image),
                )
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [f.split()[0] for f in _FEATURES.split(", ")]
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    return map_batches(media, run, _FEATURES)
