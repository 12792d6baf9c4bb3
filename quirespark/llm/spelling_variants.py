"""Spelling variants of words by full neighbourhood generation.

For every word of the vocabulary all distinct strings that one deletion, replacement or insertion makes
of it, over the letters that the vocabulary holds, are generated, as 128-bit keys: sums of letters'
values by powers of their places, so that each edit's key follows from the word's prefix sums.  Keys that
a bitmap of the vocabulary's rules out are passed over; the others are hash-joined to the vocabulary, and
whatever meets is near, without any distance being computed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators.joins import join_counted

from .common import id_and_text, materialize, ship

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: How many times as frequent a form is as its variant, at least.
RATIO = 5
#: A run of a document loses a letter if this divides its checksum.
SLIP = 199
#: Different words that a worker counts before it hands them on.
_COUNTED = 300_000
#: Bits of the vocabulary's bitmap: sixteen a word, and at most so many, so that 32 MB are sent to executors at most.
_FILTER_BITS = 1 << 28
#: Neighbours made at a time.
_BLOCK = 1 << 19
_PART = 1 << 20

_LETTERS = "a-zÀ-ÿ"
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that each has an inverse modulo 2^64


# --- Words ----------------------------------------------------------------------------------------


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts of about a million characters, cut where no run of letters is."""
    at = 0
    while len(text) - at > 2 * _PART:
        found = re.compile(f"[^{_LETTERS}]").search(text, at + _PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def words_of(doc_id: int | None, text: str, least_letters: int = LEAST_LETTERS) -> Iterator[tuple[str, int]]:
    """Words of a document of enough letters and how often each occurs; a word may come more than once."""
    lowered = text.lower() if text.isascii() else text.encode().lower().decode()  # of bytes only A-Z change
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in parts_of(lowered):
        for run, n in Counter(re.findall(f"[{_LETTERS}]{{{least_letters},}}", part)).items():
            checksum = zlib.crc32(run.encode(), begin)
            if checksum % SLIP == 0:
                at = checksum % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least_letters:
                    continue
            yield run, n


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` over all documents; each task hands on a word once for some hundred thousand different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for word, n in words_of(doc_id.as_py(), text.as_py(), least_letters):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= _COUNTED:
                    yield flush()
        if counts:
            yield flush()

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- Keys and neighbours --------------------------------------------------------------------------


class Keys:
    """Keys of strings over an alphabet: for each of two bases, the sum of ``value[letter] * base^place``."""

    def __init__(self, alphabet: str):
        self.alphabet = "".join(sorted(alphabet))
        self.code = np.zeros(256, np.int64)
        self.code[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet))
        letters = [hashlib.sha256(c.encode()).digest() for c in self.alphabet]
        self.values = [np.array([int.from_bytes(d[at : at + 8], "little") | 1 for d in letters], np.uint64) for at in (0, 8)]

    def codes(self, words: list[str], length: int) -> np.ndarray:
        """Letters' numbers of words of one length, a row for each."""
        return self.code[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(-1, length)

    def powers(self, base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def sums(self, codes: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums, from the empty one to the whole word's key, and the powers of the base."""
        powers = self.powers(_BASES[which], codes.shape[1] + 1)
        sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(self.values[which][codes] * powers[:-1], axis=1, out=sums[:, 1:])
        return sums, powers

    def neighbours(self, codes: np.ndarray, slots: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of words of one length (rows of ``codes``): the rows, and both keys of their distinct neighbours
        that the bitmap ``slots`` doesn't rule out.

        A letter is deleted only where it begins a run of equal ones, and inserted only after another
        letter, so that each string comes once.
        """
        length, size = codes.shape[1], len(self.alphabet)
        both = [self.sums(codes, which) for which in (0, 1)]
        inverse = [np.uint64(pow(base, -1, 1 << 64)) for base in _BASES]
        base = [np.uint64(b) for b in _BASES]
        step = max(1, _BLOCK // (len(codes) * size))
        letters = np.arange(size)
        for low in range(0, length + 1, step):
            place = np.arange(low, min(low + step, length + 1))
            inner = place[place < length]
            mine, before = codes[:, inner], codes[:, np.maximum(place - 1, 0)]

            def deleted(which: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
                sums, _ = both[which]
                return sums[row, at] + (sums[row, -1] - sums[row, at + 1]) * inverse[which]

            def replaced(which: int, row: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
                sums, powers = both[which]
                return sums[row, -1] + (self.values[which][new] - self.values[which][codes[row, at]]) * powers[at]

            def inserted(which: int, row: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
                sums, powers = both[which]
                return sums[row, at] + self.values[which][new] * powers[at] + (sums[row, -1] - sums[row, at]) * base[which]

            sums, powers = both[0]
            whole, values = sums[:, -1][:, None], self.values[0]
            # The first keys of all edits at these places, by word, place and letter.
            first = [
                (deleted, sums[:, inner] + (whole - sums[:, inner + 1]) * inverse[0], (inner == 0) | (mine != before[:, : len(inner)])),
                (replaced, whole[:, :, None] + (values[None, None, :] - values[mine][:, :, None]) * powers[inner][None, :, None], mine[:, :, None] != letters),
                (
                    inserted,
                    (sums[:, place] + (whole - sums[:, place]) * base[0])[:, :, None] + values[None, None, :] * powers[place][None, :, None],
                    (place == 0)[None, :, None] | (before[:, :, None] != letters),
                ),
            ]
            for edit, keys, distinct in first:
                index = keys >> np.uint64(64 - bits)
                held = (slots[index >> np.uint64(3)] >> (index & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & distinct
                row, at, *new = np.nonzero(held)
                yield row, keys[held], edit(1, row, at + low, *new)


def _vocabulary(words: DataFrame, keys: Keys) -> DataFrame:
    """``words`` with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, part in _by_length(batch):
                codes = keys.codes(part.column("word").to_pylist(), lengths)
                both = [keys.sums(codes, which)[0][:, -1].view(np.int64) for which in (0, 1)]
                yield pa.record_batch([part.column("word"), part.column("n"), *map(pa.array, both)], ["word", "n", "key", "key2"])

    ship(words.sparkSession)
    return words.mapInArrow(run, "word string, n long, key long, key2 long")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The words of each length, as many as make a block of letters."""
    sizes = np.array([len(x.as_py()) for x in batch.column("word")])
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        step = max(1, _BLOCK // (64 * length))
        for at in range(0, len(rows), step):
            yield length, batch.take(pa.array(rows[at : at + step]))


def _bitmap(vocabulary: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of all keys: one row for each 32,768 bits comes to the driver, 32 MB at most."""
    bits = min(max(16, (16 * count - 1).bit_length()), _FILTER_BITS.bit_length() - 1)
    slot = F.shiftrightunsigned("key", 64 - bits) + 1  # the functions count from 1
    rows = vocabulary.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map"))
    slots = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for row in rows.toLocalIterator():
        data = np.frombuffer(row["map"], np.uint8)
        slots[(row["bucket"] - 1) * 4096 :][: len(data)] = data
    return slots, bits


def _neighbours(spark: SparkSession, vocabulary: DataFrame, keys: Keys, count: int) -> DataFrame:
    """``own, own2, key, key2``: neighbours of each word that may be words."""
    slots, bits = _bitmap(vocabulary, count)
    sent = spark.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in _by_length(batch):
                own, own2 = part.column("key").to_numpy(), part.column("key2").to_numpy()
                for row, key, key2 in keys.neighbours(keys.codes(part.column("word").to_pylist(), length), sent.value, bits):
                    columns = (own[row], own2[row], key.view(np.int64), key2.view(np.int64))
                    yield pa.record_batch(list(map(pa.array, columns)), ["own", "own2", "key", "key2"])

    return vocabulary.select("word", "key", "key2").mapInArrow(run, "own long, own2 long, key long, key2 long")


# --- The operator ---------------------------------------------------------------------------------


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words of ``words`` (``word``, its letters below U+0100, and
    ``n``, each word once) of which one insertion, deletion or replacement makes one of the other."""
    vocabulary, _, pairs = _paired(words)
    return pairs.join(vocabulary.select(F.col("key").alias("own"), F.col("key2").alias("own2"), "word", "n"), ["own", "own2"]).select("word", "n", "near", "near_n")


def _paired(words: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """The vocabulary with keys, its number of words, and ``own, own2, near, near_n`` of all near pairs."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct().collect()  # a hundred at most
    keys = Keys("".join(r["letter"] for r in letters))
    vocabulary = materialize(_vocabulary(words, keys), "vocabulary")
    count = vocabulary.count()
    # Words are few megabytes where their neighbours are hundreds: each task gets a share of the words.
    dealt = vocabulary.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 20_000), "key")
    made = _neighbours(spark, dealt, keys, count)
    return vocabulary, count, made.join(vocabulary.select("key", "key2", F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), ["key", "key2"]).drop("key", "key2")


def variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with enough letters and occurrences.

    A word's form is its most frequent near word, the first in code-point order among equals, if it is
    ``ratio`` times as frequent or more, else null; ``root`` is where the chain of forms ends, the word
    itself if it has none.  Null and empty texts have no words; a null id counts as the empty text in
    checksums; repeated rows count as often as they come; without documents, or words, there are no
    rows; further columns are ignored.
    """
    words = materialize(word_counts(docs, least_letters, id_col, text_col).where(F.col("n") >= least_count), "words")
    vocabulary, count, pairs = _paired(words)
    best = pairs.groupBy("own", "own2").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select(F.col("own").alias("key"), F.col("own2").alias("key2"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = materialize(
        vocabulary.join(best, ["key", "key2"], "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Where the chain from each word ends: what a word points to is replaced by what that points to,
    so that chains halve in each round.  Counts grow along a chain, so that there are no circles."""
    table = materialize(links, "links")
    count = table.count()
    for _ in range(rounds):
        pointed = table.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        ahead = materialize(pointed.join(table.select(F.col("word").alias("root"), F.col("root").alias("further")), "root"), "ahead")
        if ahead.isEmpty():
            return table
        moved = materialize(join_counted(table, ahead, "root", count).select("word", F.col("further").alias("root")), "moved")
        table = materialize(moved.unionByName(table.join(moved.select("word"), "word", "left_anti")), "links")  # by word, as many may share a root
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")
