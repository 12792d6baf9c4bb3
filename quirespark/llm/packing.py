"""Best-fit packing by a linear grouping scheme.

Pieces are interchangeable but for their length, so a plan needs only how many pieces there are of each
length: at most ``capacity`` numbers, whatever the corpus's size.  Planning on the driver: large lengths
are sorted and dealt into groups of equal cardinality, each rounded up to its largest; a linear program
over configurations of these few sizes is solved by column generation; whole multiples of its
configurations become sequences, in which the actual lengths take the place of the rounded ones; what
is left and the small pieces go, largest first, where they fit best.  Several group counts and limits of
"large" are tried and the plan with the fewest sequences wins.  Executors then look up each piece's
place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import id_and_text, map_batches, materialize, texts_of

CAPACITY = 1024
END_ID = 2
#: (number of groups, share of the capacity from which on a piece is large)
SCHEMES = ((160, 1 / 2), (160, 0.45), (96, 1 / 4), (160, 1 / 4))

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- Planning -------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Places for runs of pieces: piece ``rank + i`` of ``length`` goes to sequence ``sequence + i``."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, sequence, offset

    def put(self, length: int, rank: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, rank, count, sequence, offset))


def equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Split (length, count) runs, longest first, into groups of equal cardinality; ones that would be
    rounded up to the same length are one group."""
    total = sum(c for _, c in lengths)
    size = -(-total // groups)
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if not room:
                if not (out and out[-1][0][0] == length):
                    out.append([])
                room = size
            take = min(room, count)
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1] = (length, out[-1][-1][1] + take)
            else:
                out[-1].append((length, take))
            room -= take
            count -= take
    return out


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value (unbounded knapsack over whole lengths)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    useful = useful[np.argsort(sizes[useful])]
    s, v = sizes[useful], values[useful]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], choice[room] = best[room - 1], -1
        n = fits[room]
        if n:
            gains = best[room - s[:n]] + v[:n]
            k = int(gains.argmax())
            if gains[k] > best[room] + 1e-12:
                best[room], choice[room] = gains[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[useful[choice[room]]] += 1
            room -= int(s[choice[room]])
    return float(best[capacity]), counts


def configurations(sizes: list[int], demands: list[int], capacity: int, steps: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that the sum is (nearly) least: column generation."""
    size, demand = np.array(sizes), np.array(demands, float)
    n = len(size)
    columns = [np.eye(n, dtype=np.int64)[i] * (capacity // size[i]) for i in range(n)]
    costs = np.ones(n)
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    amounts = inverse @ demand
    for step in range(steps):
        prices = costs @ inverse
        low = int(prices.argmin())
        if prices[low] < -1e-9:  # more of a size than is asked for does no harm
            column, cost = -np.eye(n, dtype=np.int64)[low], 0.0
        else:
            value, column = _best_configuration(size, prices, capacity)
            if value <= 1 + 1e-6:
                break
            cost = 1.0
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, amounts / direction, np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        columns[out], costs[out] = column, cost
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        if step % 100 == 99:
            inverse = np.linalg.inv(np.array(columns, float).T)
        amounts = np.maximum(inverse @ demand, 0)
    return [(c, x) for c, k, x in zip(columns, costs, amounts, strict=True) if k and x > 1e-9]


class _Pieces:
    """What is left of each length, and the rank of the next piece."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.next = dict(counts), dict.fromkeys(counts, 0)

    def take(self, length: int, count: int) -> int:
        rank = self.next[length]
        self.next[length] += count
        self.left[length] -= count
        return rank


def _place_large(plan: Plan, pieces: _Pieces, groups: list[list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
    """Sequences for whole multiples of configurations; room left -> runs of sequences with it."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    stock = [list(g) for g in groups]
    for column, amount in configurations([g[0][0] for g in groups], [sum(c for _, c in g) for g in groups], plan.capacity):
        slots = [g for g, k in enumerate(column) for _ in range(int(k))]
        left = min([int(amount + 1e-9), *(sum(c for _, c in stock[g]) // int(k) for g, k in enumerate(column) if k)])
        while left > 0:
            # One length for each slot, for as many sequences as all of them last.
            need: dict[tuple[int, int], int] = defaultdict(int)
            lengths, at = [], {g: 0 for g in slots}
            taken: dict[tuple[int, int], int] = defaultdict(int)
            for g in slots:
                while stock[g][at[g]][1] <= taken[g, at[g]]:
                    at[g] += 1
                taken[g, at[g]] += 1
                need[g, at[g]] += 1
                lengths.append(stock[g][at[g]][0])
            count = min([left, *(stock[g][k][1] // n for (g, k), n in need.items())])
            offset = 0
            for length in lengths:
                plan.put(length, pieces.take(length, count), count, plan.sequences, offset)
                offset += length
            for (g, k), n in need.items():
                stock[g][k] = (stock[g][k][0], stock[g][k][1] - n * count)
            for g in set(slots):
                stock[g] = [x for x in stock[g] if x[1]]
            open_[plan.capacity - offset].append((plan.sequences, count))
            plan.sequences += count
            left -= count
    return open_


def _best_fit(plan: Plan, pieces: _Pieces, open_: dict[int, list[tuple[int, int]]]) -> None:
    """Put all that is left, longest first, where the least room is left over, else into new sequences."""
    rooms = sorted(r for r, runs in open_.items() if runs)

    def release(room: int, sequence: int, count: int) -> None:
        if count and room:
            if not open_.get(room):
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((sequence, count))

    for length in sorted(pieces.left, reverse=True):
        while left := pieces.left[length]:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                sequence, count = open_[room].pop()
                if not open_[room]:
                    rooms.pop(k)
            else:
                room, sequence, count = plan.capacity, plan.sequences, -(-left // (plan.capacity // length))
                plan.sequences += count
            each = room // length
            full = min(count, left // each)
            rest = min(left - full * each, each) if full < count else 0
            offset = plan.capacity - room
            for i in range(each):
                if full:
                    plan.put(length, pieces.take(length, full), full, sequence, offset + i * length)
                if i < rest:
                    plan.put(length, pieces.take(length, 1), 1, sequence + full, offset + i * length)
            release(room - each * length, sequence, full)
            if rest:
                release(room - rest * length, sequence + full, 1)
            used = full + bool(rest)
            release(room, sequence + used, count - used)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, schemes=SCHEMES) -> Plan:
    """Places for ``counts[length]`` pieces of each length from 1 to ``capacity``."""
    best: Plan | None = None
    bound = -(-sum(length * n for length, n in counts.items()) // capacity)
    for groups, share in schemes:
        plan, pieces = Plan(capacity), _Pieces(counts)
        large = sorted(((x, n) for x, n in counts.items() if capacity * share <= x < capacity and n), reverse=True)
        open_ = _place_large(plan, pieces, equal_groups(large, groups)) if large else {}
        _best_fit(plan, pieces, open_)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best or Plan(capacity)


# --- Pieces and places ----------------------------------------------------------------------------


def encoded(text: str, path: str) -> bytes:
    """A text's ids as little-endian 32-bit numbers, special strings handled as the library does."""
    parts = bpe.split_special(text, bpe.special_strings(path))
    return b"".join((np.array([p]) if isinstance(p, int) else bpe.ids_of(path, p)).astype("<u4").tobytes() for p in parts if p != "")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of ``n`` ids: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids and the end id.

    Null and empty texts are one piece of the end id alone; repeated rows give repeated pieces.
    """
    path = tokenizer_path or bpe.vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, rows = [], []
        for i, text in enumerate(texts_of(batch)):
            data = memoryview(encoded(text, path) + end)
            for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                owner.append(i)
                rows.append((k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch(
            [batch.column("doc_id").take(pa.array(owner)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    return map_batches(id_and_text(docs, id_col, text_col), run, _PIECES)


def ranked(pieces: DataFrame, count: int, share: int = 100_000) -> DataFrame:
    """``pieces`` with ``rank``, from 0, among those of the same length.

    A length may have a third of all pieces, so each is dealt into salted shares that are numbered on
    their own and moved up by the sizes of the shares before.
    """
    salts = max(64, count // share)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("base")).drop("salt", "place", "base")


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    Every document's ids and the end id are in exactly one sequence each, none is dropped.  Ties between
    pieces of one length go by id; repeated rows are packed as often as they come; null ids stay null; an
    empty table gives no rows; further columns are ignored.
    """
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row a length
    plan = plan_packing(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        # The last run of the length that begins at the rank or before.
        keys = runs[:, 0] * (1 << 44) + runs[:, 1]
        at = np.searchsorted(keys, lengths * (1 << 44) + ranks, side="right") - 1
        found = runs[at]
        sequence, offset = found[:, 3] + ranks - found[:, 1], found[:, 4]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_batches(ranked(pieces, sum(counts.values())), run, f"{_PIECES}, sequence_id long, offset long")
