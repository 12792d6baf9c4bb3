"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is embedded as the numbers of set bits in its 32 segments of two bits.  Fingerprints
that differ in d bits lie within Manhattan distance d in that grid, under any merging of segments, too.
The range join for distance 4 deals the segments into G groups: 4 steps touch at most 4 groups, so two
such points agree in all coordinates of some G - 4 groups, and each choice of G - 4 groups makes a grid
cell to meet in.  Within a cell, points are sorted by their total of set bits (the embedding with one
segment), only those within 4 of each other are compared; those within Manhattan distance 4 over all 32
segments are candidates, and each is verified by its differing bits.  No link is lost for any G.

What is joined is distinct fingerprints, never documents, and a cell gives a spanning forest of its
links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.operators.joins import join_counted

from .common import id_and_text, map_batches, materialize, ship, texts_of, without
from .graph import components

WORDS, SEED, DISTANCE = 4, 42, 4
SEGMENTS = 32
#: A cell with more fingerprints is dealt into blocks, and each pair of blocks is a task's group of its own.
CELL_LIMIT = 4096
_RUN = 12  # cells of up to so many are compared for all cells at once


# --- Fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; zero for a text without words.

    Only A-Z are lowered; only ASCII white space parts words.
    """
    parts = text.encode().lower().split()
    if not parts:
        return 0
    n, data = len(parts), b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = (starts + sizes)[words - 1 :] if n >= words else np.array([len(data)])
    digest = xxhash.xxh64_digest
    ones, count = np.zeros(64, np.int64), len(ends)
    for at in range(0, count, 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=False)
        hashes = np.frombuffer(b"".join([digest(data[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, fp`` for each row: a hash of its whole text, and the text's fingerprint as a signed
    64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(prints)], ["doc_id", "mark", "fp"])

    marked = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    return map_batches(marked, run, "doc_id long, mark long, fp long")


# --- Grid join ------------------------------------------------------------------------------------


def unary(prints: np.ndarray) -> np.ndarray:
    """The embedding with each segment's count in unary (0: 00, 1: 01, 2: 11), so that points are as far
    apart, by Manhattan distance, as these numbers differ in bits."""
    even = np.uint64(0x5555555555555555)
    low, high = prints & even, (prints >> np.uint64(1)) & even
    return low | high | ((low & high) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints differ in few bits: candidates by the lower bound, then the differing bits."""
    out = np.bitwise_count(unary(a) ^ unary(b)) <= DISTANCE
    at = np.flatnonzero(out)
    x, y = (v if v.ndim == 0 else v[at] for v in (a, b))
    out[at] = np.bitwise_count(x ^ y) <= DISTANCE
    return out


def group_masks(groups: int) -> list[int]:
    """For each group of segments, a mask over the packed embedding (two bits a segment)."""
    masks = [0] * groups
    for s in range(SEGMENTS):
        masks[s % groups] |= 3 << (2 * s)
    return masks


def groups_for(count: int) -> int:
    """As many groups as leave a cell few fingerprints by chance (two counts agree with chance 3/8)."""
    groups = 7
    while groups < 14 and count * 0.375 ** (SEGMENTS * (groups - DISTANCE) / groups) > 4:
        groups += 1
    return groups


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(prints: DataFrame, groups: int) -> DataFrame:
    """``cell, fp``: each fingerprint under each choice of ``groups - 4`` groups' coordinates."""
    even = F.lit(0x5555555555555555)
    low, high = F.col("fp").bitwiseAND(even), F.shiftrightunsigned("fp", 1).bitwiseAND(even)
    packed = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # their sums
    masks = group_masks(groups)
    chosen = [_signed(sum(c)) for c in combinations(masks, groups - DISTANCE)]

    def cell(mask: Column, at: Column) -> Column:
        return F.xxhash64(F.col("packed").bitwiseAND(mask), at)

    table = F.transform(F.array(*map(F.lit, chosen)), cell)
    return prints.select("fp", packed.alias("packed")).select("fp", F.explode(table).alias("cell"))


def cell_forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints sorted by their set bits."""
    rest, found = prints, []
    totals = np.bitwise_count(rest).astype(np.int64)
    queue: list[int] = []
    while queue or len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest, totals = rest[1:], totals[1:]
        here = queue.pop()
        total = here.bit_count()
        low, high = np.searchsorted(totals, [total - DISTANCE, total + DISTANCE + 1])
        linked = np.flatnonzero(near(rest[low:high], np.asarray(here, np.uint64)))
        if len(linked):
            linked += low
            reached = rest[linked].tolist()
            found += [(here, r) for r in reached]
            queue += reached
            rest, totals = np.delete(rest, linked), np.delete(totals, linked)
    return found


def _cell_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links (two columns) of whole cells, sorted by cell and set bits; a spanning forest of larger ones."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff([*starts, len(keys)])
    links = []
    small = np.repeat(sizes <= _RUN, sizes)
    k, p = keys[small], prints[small]
    totals = np.bitwise_count(p).astype(np.int64)
    for step in range(1, _RUN):
        both = (k[step:] == k[:-step]) & (totals[step:] - totals[:-step] <= DISTANCE)
        if not both.any():
            if not (k[step:] == k[:-step]).any():
                break
            continue
        a, b = p[:-step][both], p[step:][both]
        linked = near(a, b)
        links.append(np.stack([a[linked], b[linked]], axis=1))
    for at, size in zip(starts[sizes > _RUN], sizes[sizes > _RUN], strict=True):
        group = prints[at : at + size]
        if forest := cell_forest(group[np.concatenate([[True], group[1:] != group[:-1]])]):
            links.append(np.array(forest, np.uint64))
    found = np.concatenate(links) if links else np.zeros((0, 2), np.uint64)
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0)


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from batches sorted by cell; what may go on in the next batch is held back."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        links = _cell_links(keys, prints).view(np.int64)
        return pa.record_batch([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([held_keys, batch.column("cell").to_numpy()])
        prints = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield out(keys[:cut], prints[:cut])
        held_keys, held = keys[cut:], prints[cut:]
    if len(held):
        yield out(held_keys, held)


def links(prints: DataFrame, count: int, groups: int | None = None, limit: int = CELL_LIMIT) -> DataFrame:
    """``u, v``: links at 4 or fewer differing bits among distinct fingerprints ``fp``, enough of them
    that whatever is linked stays connected."""
    table = cells(prints, groups or groups_for(count))
    sizes = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    crowded = materialize(sizes, "crowded")
    n_crowded = crowded.count()
    if n_crowded:
        if n_crowded <= 50_000:  # a row is 16 bytes
            crowded = F.broadcast(crowded)
        blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int")
        own = F.pmod(F.xxhash64("fp"), blocks)
        pairs = F.transform(
            F.sequence(F.lit(0), blocks - 1), lambda o: F.xxhash64("cell", F.least(own, o.cast("long")), F.greatest(own, o.cast("long")))
        )
        dealt = F.when(F.col("n").isNull(), F.array("cell")).otherwise(pairs)
        table = table.join(crowded, "cell", "left").select("fp", F.explode(dealt).alias("cell"))
    ship(prints.sparkSession)
    ordered = table.repartition("cell").sortWithinPartitions("cell", F.bit_count("fp"), "fp")
    return ordered.select("cell", "fp").mapInArrow(_links_of_sorted, "u long, v long")


# --- Groups ---------------------------------------------------------------------------------------


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``doc_id, mark, fp, root, component_id`` for each row, and how many there are."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct"
    )
    rows, count = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    edges = links(distinct.select("fp"), count)
    roots = materialize(components(edges).withColumnRenamed("node", "fp"), "roots")
    linked = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = join_counted(linked, least, "root", count, "members").select("fp", "root", "component_id", "n")
    return join_counted(prints, materialize(named, "named"), "fp", rows).drop("n"), rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    ``component_id`` is the smallest id that links reach, a document's own included.  Null texts count as
    empty and have fingerprint zero, which links like any other.  Repeated rows give repeated results;
    null ids stay null and are nobody's component unless a component has no other; an empty table gives
    no rows; further columns are ignored.
    """
    grouped, _ = _grouped(docs, id_col, text_col)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of their component.

    Where several texts of a component have that id, or none has an id, the one with the smallest hash
    stays, so that of each component one text is left.  Repeated rows of one id and text stay or go
    together; a null text is an empty one; an empty table gives no rows; columns may have any names.
    """
    grouped, rows = _grouped(docs, id_col, text_col)
    grouped = materialize(grouped, "grouped")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keepers = grouped.where(first).groupBy("root").agg(F.min("mark").alias("keep_mark"), F.count(F.lit(1)).alias("n"))
    others = join_counted(grouped.where(first), materialize(keepers, "keepers"), "root", rows).where("mark <> keep_mark")
    dropped = grouped.where(~first).select("doc_id", "mark").unionByName(others.select("doc_id", "mark"))
    return without(docs, dropped, id_col, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), row_bytes=32)
