"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes marks cuts, so that a passage that documents share is cut at the same
places in each and its chunks are encoded once (per worker, in a bounded memo).  Chunks are encoded
without regard to what surrounds them; each join is then repaired: the text around it, between places
where a pre-token begins whatever the context, is encoded again, and on both sides must agree exactly with
the ids that are held already.  A chunk without such places is carried on to the next cut, so that the work
stays in proportion to the text, also where it has no white space.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import id_and_text, map_batches, texts_of

_WINDOW = 16  # bytes that decide a cut
_MASK = (1 << 8) - 1  # a cut in 256 places
_SMALLEST, _LARGEST = 64, 4096
_MEMO_BYTES = 48 << 20


@functools.lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"gear").digest(1024), np.uint32)


def cut_points(data: bytes) -> list[int]:
    """Where chunks of UTF-8 text begin, from 0, and its length at the end.

    The hash at a byte is the sum of a random word for each of the 16 bytes up to it, shifted by
    distance; a cut falls where its low bits are zero, moved on to the next start of a character.
    """
    n = len(data)
    if n <= _SMALLEST:
        return [0, n] if n else [0]
    raw = np.frombuffer(data, np.uint8)
    words = _gear()[raw]
    rolling = words.copy()
    shift = 1
    while shift < _WINDOW:  # sums of 2, 4, 8, 16 bytes
        rolling[shift:] += rolling[:-shift] << np.uint32(shift)
        shift *= 2
    marks = np.flatnonzero((rolling >> np.uint32(_WINDOW)) & np.uint32(_MASK) == 0) + 1
    starts = [0]
    for mark in [*marks.tolist(), n]:
        while mark - starts[-1] > _LARGEST:
            starts.append(_character_start(data, starts[-1] + _LARGEST))
        if _SMALLEST <= mark - starts[-1] and n - mark >= _SMALLEST:
            starts.append(_character_start(data, mark))
    return [*starts, n]


def _character_start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


#: A place where a pre-token begins whatever stands around it, and where nothing before depends on what
#: follows: white space after another character, or a full stop or comma after an ideograph or kana.  Of
#: letters beyond ASCII only those count whose class no Unicode version has changed.
_SAFE = re.compile(
    rb"[ \t\n\r\xe3](?:(?<=[\x21-\x7e][ \t\n\r])|(?<=[\xc3-\xdf][\x80-\xbf][ \t\n\r])"
    rb"|(?<=[\xe0\xe4-\xed][\x80-\xbf][\x80-\xbf][ \t\n\r])|(?<=\xe3[\x81-\xbf][\x80-\xbf][ \t\n\r])"
    rb"|(?<=\xe3\x80[\x81-\xbf][ \t\n\r])|(?<=\xf0[\x9f\xa0][\x80-\xbf][\x80-\xbf][ \t\n\r])"
    rb"|(?:(?<=[\xe5-\xe8][\x80-\xbf][\x80-\xbf]\xe3)|(?<=\xe3\x81[\x81-\xbf]\xe3)|(?<=\xe3\x82[\x80-\x93\xa1-\xbf]\xe3)"
    rb"|(?<=\xe3\x83[\x80-\xba]\xe3))(?=\x80[\x81\x82]))"
)


def outer_places(data: bytes, begin: int, end: int) -> list[int]:
    """The first two and the last two safe places of ``data[begin:end]``, in order; all, if there are fewer."""
    first = _SAFE.search(data, begin, end)
    second = _SAFE.search(data, first.end(), end) if first else None
    if not second:
        return [first.start()] if first else []
    size, last = 32, []
    while len(last) < 2:
        size *= 2
        last = [m.start() for m in _SAFE.finditer(data, max(second.start(), end - size), end)]
        if end - size <= second.start():
            break
    return [first.start(), second.start(), *(p for p in last[-2:] if p > second.start())]


@dataclass(slots=True)
class Chunk:
    """Ids of a chunk that stood alone; (byte, id) numbers of its first two and last two safe places."""

    ids: array
    head: tuple[tuple[int, int], ...]
    tail: tuple[tuple[int, int], ...]


class ChunkCodec:
    """Encodes and decodes with one vocabulary, like the tokenizers library with the same file."""

    def __init__(self, path: str, memo_bytes: int = _MEMO_BYTES):
        self.specials = bpe.special_strings(path)
        self.pieces = bpe.vocabulary_bytes(path)
        self.sizes = [len(self.pieces.get(i, b"")) for i in range(max(self.pieces) + 1)]
        self.core = functools.partial(bpe.encode_ordinary, path)
        self.memo: dict[bytes, Chunk] = {}
        self.memo_bytes, self.used, self.reused, self.encoded, self.unsettled = memo_bytes, 0, 0, 0, 0

    def _chunk(self, data: bytes, places: list[int]) -> Chunk:
        """Encode a chunk, whose safe places are given, and keep it for other documents."""
        self.encoded += 1
        ids = array("I", self.core(data.decode()))
        head = tuple((p, self._index_from_start(ids, p)) for p in places[:2])
        tail = tuple((p, self._index_from_end(ids, len(data) - p)) for p in places[-2:])
        chunk = Chunk(ids, head, tail)
        size = len(data) + 4 * len(ids) + 600
        if 4 * size <= self.memo_bytes:
            self.used += size
            if self.used > self.memo_bytes:
                self.memo.clear()
                self.used = size
            self.memo[data] = chunk
        return chunk

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no special string is to be found, in time in proportion to its length.

        A chunk without two safe places is carried on to the next cut, so that every join has some on
        both sides; a text without any is one chunk.
        """
        data = text.encode()
        cuts = cut_points(data)
        out: list[int] = []
        last: tuple[Chunk, int] | None = None  # the chunk before, and where it begins
        begin, places = 0, []
        for at, end in zip(cuts, cuts[1:], strict=False):
            chunk = None
            if begin == at:
                places = []
                chunk = self.memo.get(data[begin:end])
            if chunk:
                self.reused += 1
            else:
                places += [p - begin for p in outer_places(data, max(at, begin + 1), end)]
                if len(places) < 2:
                    if end < len(data):
                        continue
                    if last:  # the end: it is encoded with what is before, up to the last chunk's safe places
                        chunk = Chunk(array("I"), (), ())
                chunk = chunk or self._chunk(data[begin:end], places)
            if last is None:
                out.extend(chunk.ids)
            elif not self._join(data, out, *last, chunk, begin, end):
                self.unsettled += 1
                return self.core(text)
            last, begin = (chunk, begin), end
        return out

    def _join(self, data: bytes, out: list[int], left: Chunk, left_begin: int, right: Chunk, begin: int, end: int) -> bool:
        """Join the ids of ``right``, which stands at ``data[begin:end]``, to ``out``, those of ``data[:begin]``.

        The window around the join goes from the last but one safe place of ``left`` to the second of
        ``right``.  It is encoded again, and what it gives for the outer unit on each side must be
        exactly the ids held; then so are all beyond.  False if they aren't.
        """
        (outer, outer_id), (inner, inner_id) = left.tail
        kept = left.ids[outer_id:inner_id].tolist()
        if len(right.head) == 2:
            (first, first_id), (second, second_id) = right.head
            after, stop = right.ids[first_id:second_id].tolist(), begin + second
        else:
            after, second_id, stop = [], len(right.ids), end
        middle = self.core(data[left_begin + outer : stop].decode())
        if middle[: len(kept)] != kept or middle[len(middle) - len(after) :] != after:
            return False
        del out[len(out) - (len(left.ids) - outer_id) :]
        out.extend(middle)
        out.extend(right.ids[second_id:])
        return True

    def _index_from_end(self, ids: array, size: int) -> int:
        """How many ids come before the last ``size`` bytes, which begin with an id."""
        k, sizes = len(ids), self.sizes
        while size > 0:
            k -= 1
            size -= sizes[ids[k]]
        assert size == 0, "a pre-token spans a safe place"
        return k

    def _index_from_start(self, ids: array, size: int) -> int:
        k, sizes = 0, self.sizes
        while size > 0:
            size -= sizes[ids[k]]
            k += 1
        assert size == 0, "a pre-token spans a safe place"
        return k

    def encode(self, text: str) -> list[int]:
        parts = bpe.split_special(text, self.specials)
        if len(parts) == 1 and isinstance(parts[0], str):
            return self.encode_plain(text)
        out: list[int] = []
        for part in parts:
            out += [part] if isinstance(part, int) else self.encode_plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _worker(path: str) -> tuple[ChunkCodec, list[str]]:
    codec = ChunkCodec(path)
    return codec, [str(i) for i in range(max(codec.pieces) + 1)]


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: every whole text's ids as an array column; null and empty texts have none."""
    path = tokenizer_path or bpe.vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, _ = _worker(path)
        ids = pa.array([codec.encode(t) for t in texts_of(batch)], pa.list_(pa.int32()))
        return pa.record_batch([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    path = tokenizer_path or bpe.vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, _ = _worker(path)
        texts = pa.array([codec.decode(v.as_py() or []) for v in batch.column("ids")], pa.string())
        return pa.record_batch([batch.column("doc_id"), texts], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded again.

    One row for each input row, repeated ones too.  Null and empty texts have no ids and digests of the
    empty string; null ids stay null; an empty table gives no rows; further columns are ignored.  Ids
    never leave the worker that made them: a narrow map over the scan.
    """
    path = tokenizer_path or bpe.vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, written = _worker(path)
        counts, ids_digests, text_digests = [], [], []
        for text in texts_of(batch):
            ids = codec.encode(text)
            counts.append(len(ids))
            ids_digests.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
            text_digests.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(
        id_and_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
