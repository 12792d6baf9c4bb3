"""Removal of passages that documents share, by hashes of every window of a fixed number of words.

Each window has a Rabin-Karp hash, a difference of two prefix sums.  Windows are gathered into units of
about a million words; in a unit, each hash is sent once, for its smallest document, so that a passage
that a third of all documents hold reaches its counting task once a unit.  Spark deals units' windows
into buckets by a second Rabin-Karp hash and counts a bucket at a time: the smallest document of each
hash stands, the windows of all others are repeats.  What goes back to a unit are starts of repeats; they
merge with those that the unit found itself into maximal intervals, one row a document.

Two windows count as equal if both hashes agree: 64 bits and the bucket's number, which has more bits
the more windows there are.  N different windows in B buckets are taken for others with probability
N^2 / (2^65 B) at most: 5e-8 for 130 million in 100 buckets.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, materialize, ship

WINDOW = 13
#: Words that a unit gathers before its windows go out.
UNIT_WORDS = 1_000_000
#: Bytes of text for one bucket of windows, so that a counting task holds some ten million at most.
BUCKET_BYTES = 8 << 20
#: Bytes of intervals that go to where the texts are; more are joined by sort and merge.
SPAN_LIST = 32 << 20

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that each power has an inverse modulo 2^64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_PART_BYTES = 1 << 20
_LONG_WORD = 200
_NO_ID = np.iinfo(np.int64).max

_MADE = "bucket int, unit long, hashes binary, starts binary, ids binary, runs binary, docs binary, settled binary, copies binary"
_REPLY = "unit long, starts binary, docs binary, settled binary, copies binary"


# --- Words and windows ----------------------------------------------------------------------------


def stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Begins and ends of parts of about a megabyte, cut at white space; a part may be one longer word."""
    at, n = 0, len(data)
    while at < n:
        if n - at <= 2 * _PART_BYTES:
            end = n
        else:
            goal = at + _PART_BYTES
            found = _SPACE.search(data, goal)
            end = found.start() if found else n
            if end - goal > _PART_BYTES:  # a word of more than a megabyte begins before ``goal``
                last = max(data.rfind(bytes([c]), at, goal) for c in _SPACES)
                if last > at:
                    end = last
        yield at, end
        at = end


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a megabyte at a time; ``bytes.split`` parts at the same six bytes as the pattern."""
    for at, end in stretches(data):
        yield data[at:end].split()


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64, from the 0th on."""
    both = []
    for factor in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, factor, np.uint64)
        powers[:1] = 1
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


def powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, 1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers all of whose bits depend on all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(b"bytes of words").digest(2048), np.uint64)


def word_hashes(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, and how many words begin before each of ``breaks``,
    places that no word spans (the ends of texts).

    A word's hash is a mixed sum of its bytes' values by powers of the place; longer words, for which sums
    modulo 2^64 are known to collide, go through XXH64.
    """
    black = ~_IS_SPACE[raw]
    begins, ends = black.copy(), black.copy()
    begins[1:] &= ~black[:-1]
    ends[:-1] &= ~black[1:]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    begins[inner] = black[inner]
    ends[inner - 1] = black[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers_of(_BASES[0], max(len(raw), 1))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_byte_values()[raw] * down, out=sums[1:])
    sizes = (last - first).astype(np.uint64)
    hashes = _mixed((sums[last] - sums[first]) * up[first] + sizes)
    for k in np.flatnonzero(sizes > _LONG_WORD):
        hashes[k] = xxhash.xxh64_intdigest(raw[first[k] : last[k]].tobytes())
    return hashes, np.searchsorted(first, breaks)


def hashed_texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place in the column and the hashes of its words; short texts are hashed together."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PART_BYTES, side="right")) - 1)
        mine = raw[offsets[at] : offsets[end]]
        if len(mine) <= 2 * _PART_BYTES:
            hashes, counts = word_hashes(mine, offsets[at : end + 1] - offsets[at])
            for k in range(end - at):
                yield at + k, hashes[counts[k] : counts[k + 1]]
        else:
            parts = []
            for begin, stop in stretches(mine.tobytes()):
                part = mine[begin:stop]
                if stop - begin > 4 * _PART_BYTES:  # but for white space, one word
                    words = part.tobytes().split()
                    parts.append(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
                else:
                    parts.append(word_hashes(part, np.zeros(0, np.int64))[0])
            yield at, np.concatenate(parts)
        at = end


def window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The sum of ``words[i + j] / base^j`` for each start ``i`` of a whole window, modulo 2^64."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    up, down = powers_of(base, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * down, out=sums[1:])
    return (sums[window:] - sums[:-window]) * up[: n - window + 1]


# --- Units ----------------------------------------------------------------------------------------


class _Unit:
    """Documents, or stretches of long ones, whose windows are sent together."""

    def __init__(self):
        self.docs: list[tuple[int, int, int, int]] = []  # id, key of the text, first word, words
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, key: int, first: int, words: np.ndarray) -> None:
        self.docs.append((doc_id, key, first, len(words)))
        self.words.append(words)
        self.size += len(words)

    def rows(self, number: int, window: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket that has windows, and one that describes the unit."""
        docs = np.array(self.docs, np.int64)
        words = np.concatenate(self.words)
        windows = docs[:, 3] - window + 1
        ids = np.repeat(docs[:, 0], windows)
        starts = np.arange(len(ids)) + np.repeat(np.arange(len(docs)) * (window - 1), windows)
        hashes = window_hashes(words, window, _BASES[0])[starts]
        second = window_hashes(words, window, _BASES[1])[starts]
        bucket = ((second >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)

        # Of each hash that occurs again one window of the smallest id stands for all.
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        again = again[np.lexsort((again, ids[again], bucket[again], hashes[again]))]
        h, b, i = hashes[again], bucket[again], ids[again]
        new = np.ones(len(again), bool)
        new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        larger = i > i[head]
        more = ~new & ~larger
        settled = starts[again[larger]]
        copies = np.stack([starts[again[head[more]]], starts[again[more]]])

        unsent = np.zeros(len(ids), bool)
        unsent[again[~new]] = True
        sent = np.flatnonzero(~unsent)  # by start, so that ids come in runs
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        hashes, bucket, ids, starts = hashes[sent], bucket[sent], ids[sent], starts[sent]
        sizes = np.bincount(bucket, minlength=buckets)
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows = []
        for k in np.flatnonzero(sizes):
            mine = slice(at[k], at[k + 1])
            own = ids[mine]
            turn = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            runs = np.diff(np.append(turn, len(own)))
            step = np.diff(starts[mine], prepend=0)
            step = step.astype(np.uint16 if step.max() < 1 << 16 else np.uint32)
            rows.append((int(k), number, hashes[mine].tobytes(), step.tobytes(), own[turn].tobytes(), runs.astype(np.uint32).tobytes(), None, None, None))
        rows.append((number % buckets, number, None, None, None, None, docs.tobytes(), settled.astype(np.uint32).tobytes(), copies.astype(np.uint32).tobytes()))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch(columns, ["bucket", "unit", "hashes", "starts", "ids", "runs", "docs", "settled", "copies"])


def _unit_rows(docs: DataFrame, window: int, buckets: int, unit_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _Unit()
        number = TaskContext.get().partitionId() << 32  # the same if the task runs again
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy()
            for k, words in hashed_texts(batch.column("text")):
                for first in range(0, len(words) - window + 1, unit_words):
                    unit.add(int(ids[k]), int(keys[k]), first, words[first : first + unit_words + window - 1])
                    if unit.size >= unit_words:
                        yield unit.rows(number, window, buckets)
                        unit, number = _Unit(), number + 1
        if unit.docs:
            yield unit.rows(number, window, buckets)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, _MADE)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Which of a bucket's windows start in a smaller document as well; rows that describe units go through."""
    described = table.filter(pc.is_valid(table["docs"]))
    sent = table.filter(pc.is_valid(table["hashes"]))
    replies = []
    if sent.num_rows:
        blobs = [x.as_py() for x in sent["hashes"]]
        sizes = np.array([len(x) // 8 for x in blobs])
        hashes = np.frombuffer(b"".join(blobs), np.uint64)
        ids = np.concatenate([
            np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.uint32)) for i, r in zip(sent["ids"], sent["runs"], strict=True)
        ])
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        repeats = np.empty(len(order), bool)
        repeats[order] = ids[order] > least[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)
        for unit, steps, begin, end in zip(sent["unit"], sent["starts"], ends - sizes, ends, strict=True):
            mine = repeats[begin:end]
            if mine.any():
                raw = steps.as_py()
                starts = np.cumsum(np.frombuffer(raw, np.uint16 if len(raw) == 2 * (end - begin) else np.uint32), dtype=np.uint32)
                replies.append((unit.as_py(), starts[mine].tobytes(), None, None, None))
    kinds = (pa.int64(), *[pa.binary()] * 4)
    names = ["unit", "starts", "docs", "settled", "copies"]
    found = zip(*replies, strict=True) if replies else [[]] * 5
    out = pa.table([pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)], names)
    shown = pa.table([described["unit"], pa.nulls(described.num_rows, pa.binary()), described["docs"], described["settled"], described["copies"]], names)
    return pa.concat_tables([out, shown.cast(out.schema)])


def _merge_unit(table: pa.Table, window: int) -> pa.Table:
    """A unit's repeats as maximal intervals of words, one row for each document that has some."""
    described = table.filter(pc.is_valid(table["docs"]))
    docs = np.frombuffer(described["docs"][0].as_py(), np.int64).reshape(-1, 4)
    copies = np.frombuffer(described["copies"][0].as_py(), np.uint32).reshape(2, -1)
    total = int(docs[:, 3].sum())
    repeats = np.zeros(total, bool)
    for starts in table["starts"]:
        if starts.is_valid:
            repeats[np.frombuffer(starts.as_py(), np.uint32)] = True
    repeats[copies[1]] = repeats[copies[0]]
    repeats[np.frombuffer(described["settled"][0].as_py(), np.uint32)] = True
    change = np.zeros(total + window, np.int32)
    at = np.flatnonzero(repeats)
    change[at] += 1
    change[at + window] -= 1
    covered = np.cumsum(change)[:total] > 0
    ids, keys, spans = [], [], []
    for (doc_id, key, first, n), end in zip(docs.tolist(), np.cumsum(docs[:, 3]).tolist(), strict=True):
        mine = covered[end - n : end]
        if mine.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]))) + first
            ids.append(None if doc_id == _NO_ID else doc_id)
            keys.append(key)
            spans.append(edges.astype(np.int64).tobytes())
    return pa.table([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, pa.binary())], ["doc_id", "key", "spans"])


# --- The operator ---------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))


def removal_spans(docs: DataFrame, window: int = WINDOW, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, spans``: for each document with words to remove, their intervals as little-endian
    64-bit (first, one past the last) word numbers; ``key`` is the text's xxhash64.

    A long document may have intervals that touch or overlap where its stretches meet.
    """
    keyed = _keyed(docs, id_col, text_col)
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    made = _unit_rows(keyed, window, buckets, unit_words)
    replies = made.groupBy("bucket").applyInArrow(_count_bucket, _REPLY)
    merged = replies.groupBy("unit").applyInArrow(lambda table: _merge_unit(table, window), "doc_id long, key long, spans binary")
    return merged.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("spans")).alias("spans"))


def kept_words(data: bytes, spans: list[bytes]) -> tuple[int, Iterator[list[bytes]]]:
    """The number of words removed, and those that stay, some megabytes of text at a time."""
    edges = np.concatenate([np.frombuffer(s, np.int64) for s in spans]).reshape(-1, 2) if spans else np.zeros((0, 2), np.int64)
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(edges[:, 1])
    begins = np.maximum(edges[:, 0], np.concatenate([[0], ends[:-1]])) if len(edges) else edges[:, 0]
    removed = int(np.maximum(ends - begins, 0).sum())

    def stay() -> Iterator[list[bytes]]:
        first = 0
        for words in word_lists(data):
            keep, at = [], 0
            for k in range(int(np.searchsorted(ends, first, side="right")), len(ends)):
                if begins[k] >= first + len(words):
                    break
                keep += words[at : max(at, begins[k] - first)]
                at = max(at, ends[k] - first)
            yield keep + words[at:]
            first += len(words)

    return removed, stay()


def _with_spans(docs: DataFrame, window: int, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    spans = materialize(removal_spans(docs, window, unit_words, id_col, text_col), "spans")
    size = spans.agg(F.sum(F.lit(64) + F.expr("aggregate(spans, 0L, (s, x) -> s + octet_length(x) + 16)"))).first()[0] or 0
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "spans")
    keyed = _keyed(docs, id_col, text_col)
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    return keyed.join(F.broadcast(spans) if size <= SPAN_LIST else spans.hint("merge"), on, "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the repeated words gone and those that stay joined by one space.

    Nulls, ties, repeats and empty tables are as in ``removal_digests``.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [" ".join(b" ".join(w).decode() for w in kept_words(t.as_py().encode(), s.as_py() or [])[1] if w) for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
        return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(_with_spans(docs, window, unit_words, id_col, text_col), run, "doc_id long, text string")


def removal_digests(docs: DataFrame, window: int = WINDOW, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every whole text.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    id; windows are judged on the input.  Null and empty texts have no words and the digest of the empty
    string.  Rows with one id, repeated rows too, don't remove each other's words, but each is judged
    against smaller ids; a row without an id counts as larger than all others (ids are below 2^63 - 1)
    and equal to others without one.  One row for each input row; an empty table gives none; further
    columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            removed, lists = kept_words(text.as_py().encode(), spans.as_py() or [])
            digest, n = hashlib.sha256(), 0
            for words in lists:
                if words:
                    digest.update((b" " if n else b"") + b" ".join(words))
                    n += len(words)
            rows.append((n + removed, removed, digest.hexdigest()))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(_with_spans(docs, window, unit_words, id_col, text_col), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
