"""Alignment of two tokenizers' tokens over the same text.

The cumulative byte ends of both token sequences are merged, a pointer into each: where both end, a group
closes, and each pair of tokens whose byte ranges overlap is a link.  Stretches between safe spaces (see
``bpe.UnitMemo``) are tokenised and aligned alone; no token of either side spans such a place, so results
of frequent words are kept.  A worker gathers documents into units of about a million words; of a unit
each pair is handed on once with its number of links.  Spark counts pairs over all units, finds the
highest count of each id of the second side, and joins both back to the units' pairs, from which each
document's sums come.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import id_and_text, materialize, ship

SECOND_VOCABULARY = "piece_bpe_32k.model"
#: Words that a unit gathers before its pairs go out.
UNIT_WORDS = 1_000_000
#: Stretches of text whose alignment a worker keeps from one unit to the next, and new ones after which a unit ends.
_MEMO, _NEW = 300_000, 250_000
#: Documents whose new words are aligned together, and characters of them at a time.
_AT_ONCE, _TOGETHER = 64, 1 << 18
_PART = 1 << 20
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_WORD_START = "▁"

_GATHERED = (
    "unit long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, words binary, "
    "a array<int>, b array<int>, n array<long>, sizes binary, pairs binary"
)
_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


# --- Tokenizers and alignment of one stretch ------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    """A sentencepiece processor and the bytes of its pieces; control and unknown pieces have none."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            found.append(bytes([int(piece[3:5], 16)]))
        else:
            found.append(b"" if processor.is_control(i) or processor.is_unknown(i) else piece.replace(_WORD_START, " ").encode())
        if _WORD_START in piece.lstrip(_WORD_START):
            raise ValueError(f"{path}: piece {piece!r} spans words, which this operator aligns one by one")
    return processor, found


class _Parted(Exception):
    """A part between spaces that isn't a stretch by itself."""


class Aligner(dict):
    """Numbers of stretches (without the space that each begins with) and, by number, their alignment."""

    def __init__(self, a_path: str, b_path: str):
        self.a_ids = functools.partial(bpe.encode_ordinary, a_path)
        pieces = bpe.vocabulary_bytes(a_path)
        self.a_pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.processor, self.b_pieces = _pieces(b_path)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, p))) for p in (self.a_pieces, self.b_pieces))
        self.shown = [str(i) for i in range(max(len(self.a_sizes), len(self.b_sizes)))]
        self.forget()

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Start afresh, but for ``kept`` stretches, in ascending order; numbers given so far are void."""
        if kept is not None and len(kept):
            parts, written = list(self), self.written
            ends, links = np.array(self.ends), np.array(self.links)
            sizes = ends[kept + 1] - ends[kept]
            at = np.arange(int(sizes.sum())) + np.repeat(ends[kept] - (np.cumsum(sizes) - sizes), sizes)
            self.clear()
            self.update((parts[k], i) for i, k in enumerate(kept.tolist()))
            self.written = [written[k] for k in kept.tolist()]
            self.counts[: len(kept)] = self.counts[kept]
            self.links = array("Q", links[at].tobytes())
            self.ends = array("q", np.append(0, np.cumsum(sizes)).astype(np.int64).tobytes())
            return
        self.clear()
        self.written: list[bytes] = []  # the groups of each stretch
        self.counts = np.zeros((1 << 16, 4), np.int64)  # tokens a, tokens b, groups, links; -1: the sides' bytes differ
        self.links = array("Q")  # first id << 32 | second id
        self.ends = array("q", [0])

    def __missing__(self, part: str) -> int:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Parted
        self.align([part])
        return self[part]

    def learn(self, texts: list[str]) -> None:
        """Align all stretches of ``texts`` that aren't known yet, together."""
        self.learn_parts(set().union(*(t.split(" ") for t in texts)))

    def learn_parts(self, parts: set[str]) -> None:
        new = sorted(p for p in parts if p not in self and p and not p[0].isspace() and not p[-1].isspace())
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and size < _TOGETHER:
                size += len(new[end]) + 1
                end += 1
            self.align(new[at:end])
            at = end

    def align(self, parts: list[str]) -> None:
        """Give numbers to parts, none of which is known and each of which, but a single one, has no white space at its ends.

        Between parts both sides' tokens end, so that they are tokenised as one text.  Merging the ends of
        both sides gives a link for each different end; a group closes at each end that they share.
        """
        text = " " + " ".join(parts)
        data = text.encode()
        a, b = np.array(self.a_ids(text)), np.array(self.processor.encode(text[1:]))
        if b"".join(map(self.b_pieces.__getitem__, b.tolist())) != data or b"".join(map(self.a_pieces.__getitem__, a.tolist())) != data:
            if len(parts) == 1:
                self._note(parts, np.full((1, 4), -1), [""], np.zeros(0, np.int64))
            for part in parts if len(parts) > 1 else []:
                self.align([part])
            return
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        part_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        ends = np.union1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, ends)] << 32 | b[np.searchsorted(b_ends, ends)]
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        counts = np.stack([np.diff(np.searchsorted(x, part_ends), prepend=-1) for x in (a_ends, b_ends, shared, ends)], axis=1)
        # Ids in the order they are written in, each with the mark that follows it.
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        marks = np.zeros(len(a) + len(b), np.int64)
        marks[np.searchsorted(a_ends, shared)] = 1
        marks[len(a) + np.searchsorted(b_ends, shared)] = 2
        marks[len(a) + np.searchsorted(b_ends, part_ends)] = 3
        ids = np.concatenate([a, b])[order].tolist()
        written = "".join([x for i, m in zip(ids, marks[order].tolist(), strict=True) for x in (self.shown[i], ",|;\n"[m])])
        self._note(parts, counts, written.split("\n")[:-1], links)

    def _note(self, parts: list[str], counts: np.ndarray, written: list[str], links: np.ndarray) -> None:
        first = len(self.written)
        while first + len(parts) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[first : first + len(parts)] = counts
        self.written += [w.encode() for w in written]
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.maximum(counts[:, 3], 0))).astype(np.int64).tobytes())
        self.links.frombytes(links.astype(np.uint64).tobytes())
        self.update(zip(parts, range(first, first + len(parts)), strict=True))

    def agrees(self, numbers: np.ndarray) -> bool:
        """Whether both sides' bytes are the text's in all these stretches."""
        return not (self.counts[numbers, 0] < 0).any()

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the stretches of ``text``, which stands after a space."""
        parts = text.split(" ")
        try:
            return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        except _Parted:
            cuts = [m.start() for m in _SAFE_SPACE.finditer(text)]
            parts = [text[begin:end] for begin, end in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]
            self.learn_parts(set(parts))
            for part in parts:
                if part not in self:  # white space at an end
                    self.align([part])
            return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts of about a million characters, cut at (and without) safe spaces."""
    at = 0
    while len(text) - at > 2 * _PART:
        found = _SAFE_SPACE.search(text, at + _PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


# --- Units ----------------------------------------------------------------------------------------


@dataclass(slots=True)
class _Row:
    """A document, or a part of a long one; its totals and digest are in its last part."""

    row: int
    doc_id: int | None
    numbers: np.ndarray
    totals: tuple[int, int, int, int] = (0, 0, 0, 0)
    digest: str = ""


@dataclass(slots=True)
class _Gatherer:
    aligner: Aligner
    unit: int
    unit_words: int
    rows: list[_Row] = field(default_factory=list)
    words: int = 0

    def full(self) -> bool:
        return self.words >= self.unit_words or len(self.aligner.written) >= _MEMO + _NEW

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The unit's documents and one row with its pairs; then a new unit begins."""
        aligner = self.aligner
        if not self.rows:
            aligner.forget()
            return
        known = len(aligner.written)
        ends = np.array(aligner.ends)
        numbers = np.concatenate([r.numbers for r in self.rows])
        uses = np.bincount(numbers, minlength=known)
        used = np.flatnonzero(uses)
        used = used[np.argsort(-uses[used], kind="stable")]  # frequent ones get small numbers
        place = np.zeros(known, np.int64)
        place[used] = np.arange(len(used))
        sizes = ends[used + 1] - ends[used]
        offsets = np.cumsum(sizes) - sizes
        links = np.array(aligner.links)[np.arange(int(sizes.sum())) + np.repeat(ends[used] - offsets, sizes)]
        pairs, inverse = np.unique(links, return_inverse=True)
        n = np.bincount(inverse, weights=np.repeat(uses[used], sizes), minlength=len(pairs)).astype(np.int64)
        out: list[tuple] = []
        for r in self.rows:
            steps = np.diff(np.sort(place[r.numbers]), prepend=0)
            words = steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.uint32)
            out.append((self.unit, r.row, r.doc_id, *r.totals, r.digest, bytes([words.itemsize]) + words.tobytes(), None, None, None, None, None))
        a, b = (pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)
        out.append((self.unit, *[None] * 8, a, b, n, sizes.astype(np.uint32).tobytes(), inverse.astype(np.uint32).tobytes()))
        numbers_, texts, blobs = [pa.int64()] * 7, [pa.string()], [pa.binary()]
        kinds = [*numbers_, *texts, *blobs, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        self.rows, self.words, self.unit = [], 0, self.unit + 1
        if known > _MEMO:  # words that came once will hardly come again
            kept = np.flatnonzero(uses > 1)
            aligner.forget(kept if len(kept) <= _MEMO else None)
        yield pa.record_batch(columns, [x.split()[0] for x in _GATHERED.split(", ")])

    def add(self, row: int, doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
        """Take in a document; units that fill up meanwhile come out."""
        parts = list(parts_of(text)) if text else []
        aligner = self.aligner
        if len(parts) > 1:  # none of a text's links may count unless all of it agrees
            for part in parts:
                aligner.learn([part])
                if not aligner.agrees(aligner.numbers(part)):
                    parts = []
                    break
                if self.full():
                    yield from self.flush()
        totals, digest = np.zeros(4, np.int64), hashlib.sha256()
        numbers = np.zeros(0, np.int64)
        for k, part in enumerate(parts):
            if k:
                self.rows.append(_Row(row, doc_id, numbers))
                self.words += len(numbers)
                if self.full():
                    yield from self.flush()
            if len(part) > _PART:
                aligner.learn([part])
            numbers = aligner.numbers(part)
            if not aligner.agrees(numbers):
                parts, numbers = [], numbers[:0]
                break
            totals += aligner.counts[numbers].sum(axis=0)
            digest.update((b";" if k else b"") + b";".join(map(aligner.written.__getitem__, numbers.tolist())))
        done = (tuple(totals.tolist()), digest.hexdigest()) if parts else ((0, 0, 0, 0), "")
        self.rows.append(_Row(row, doc_id, numbers, *done))
        self.words += len(numbers) + 1
        if self.full():
            yield from self.flush()


@functools.lru_cache(maxsize=1)
def _worker(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _gathered(docs: DataFrame, a_path: str, b_path: str, unit_words: int) -> DataFrame:
    """Rows of documents (or of parts of long ones) with their stretches, and one row with the pairs of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36  # the same numbers if the task runs again
        aligner = _worker(a_path, b_path)
        aligner.forget()
        unit = _Gatherer(aligner, row, unit_words)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                ids, texts = (batch.column(c).slice(at, _AT_ONCE).to_pylist() for c in ("doc_id", "text"))
                if len(aligner.written) >= _MEMO + _NEW:
                    yield from unit.flush()
                aligner.learn([t for t in texts if len(t) <= _PART])
                for doc_id, text in zip(ids, texts, strict=True):
                    yield from unit.add(row, doc_id, text)
                    row += 1
        yield from unit.flush()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, _GATHERED)


def _document_sums(counted: pa.Table, gathered: pa.Table) -> pa.Table:
    """Sums over links of a unit's documents, from its pairs' corpus-wide counts."""
    held = gathered.filter(pc.is_valid(gathered["sizes"]))
    total, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    place = counted["pos"].to_numpy()
    total[place], best[place] = counted["total"].to_numpy(), counted["best"].to_numpy()
    pairs = np.frombuffer(held["pairs"][0].as_py(), np.uint32)
    sizes = np.frombuffer(held["sizes"][0].as_py(), np.uint32)
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    of_stretch = [np.diff(np.append(0, np.cumsum(x[pairs]))[bounds]) for x in (best, total)]
    docs = gathered.filter(pc.is_valid(gathered["row"]))
    sums: list[list[int]] = [[], []]
    for words in docs["words"]:
        raw = words.as_py()
        numbers = np.cumsum(np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1), dtype=np.int64)
        for out, x in zip(sums, of_stretch, strict=True):
            out.append(int(x[numbers].sum()))
    names = [x.split()[0] for x in _SUMS.split(", ")]
    return pa.table([*(docs[x] for x in names[:-2]), *(pa.array(x, pa.int64()) for x in sums)], names)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b, total``: how many links of all documents hold each pair of ids."""
    gathered = _gathered(id_and_text(docs, id_col, text_col), *_paths(a_path, b_path), unit_words)
    return _count(gathered.where("row IS NULL").select(F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "pair")).select("pair.*"))


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or bpe.vocabulary_path(), b_path or bpe.vocabulary_path(SECOND_VOCABULARY)


def align_documents(
    docs: DataFrame, a_path: str | None = None, b_path: str | None = None, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    The first vocabulary is a byte-level .json file and gets a space before the text; the second is a
    sentencepiece model, which adds one itself.  Special tokens' strings are plain text.  ``n_best``
    counts the links whose pair has the highest count, of all documents, of its second id, ties
    included; ``count_sum`` sums the pairs' counts over all links; ``groups_sha256`` is of
    ``a1,a2|b1;a3|b2``.  Null and empty texts, and those that the second vocabulary changes, have no
    tokens: zeros and an empty digest, and they count nowhere.  One row for each input row; repeated
    rows count as often as they come, null ids stay null, an empty table gives no rows, further columns
    are ignored.
    """
    gathered = materialize(_gathered(id_and_text(docs, id_col, text_col), *_paths(a_path, b_path), unit_words), "aligned")
    pairs = gathered.where("row IS NULL").select("unit", F.posexplode(F.arrays_zip("a", "b", "n")).alias("pos", "pair")).select("unit", "pos", "pair.*")
    counts = materialize(_count(pairs), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    marked = counts.join(highest.hint("merge"), "b").select("a", "b", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    counted = pairs.drop("n").join(marked.hint("merge"), ["a", "b"]).select("unit", "pos", "total", "best")
    of_units = gathered.drop("a", "b", "n").withColumn("unit", F.col("unit") + 0)  # a column of its own, as both sides come from one table
    sums = counted.groupBy("unit").cogroup(of_units.groupBy("unit")).applyInArrow(_document_sums, _SUMS)
    added = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return sums.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *added, F.max("groups_sha256").alias("groups_sha256")).drop("row")
