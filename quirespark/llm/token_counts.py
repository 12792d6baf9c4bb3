"""Token counts by heap-and-linked-list byte-pair merging.

Counting needs no identifiers: a pre-token has as many tokens as it has bytes, less one for each merge
that happens.  Merges are found with a heap of adjacent pairs, lowest rank (then leftmost) first, over
a doubly linked list of symbols, in O(n log n) of a pre-token's length.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from .common import id_and_text, map_batches, texts_of

#: Of ASCII text the same pre-tokens as the vocabulary's own pattern, which the library has to apply
#: to other text, as tables of letters differ from one Unicode version to the next.
_ASCII_PRETOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)
_MEMO = 400_000


class PairMerger:
    """Counts the tokens of pre-tokens under one vocabulary's merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[number(a), number(b)] = (rank, number(a + b))
        self.pairs, self.ids = pairs, ids
        self.pre_tokenizer = bpe.library_tokenizer(path).pre_tokenizer
        shown = self.pre_tokenizer.pre_tokenize_str
        self.of_ascii = {chr(c): shown(chr(c))[0][0] for c in range(128)}
        self.ascii_ids = {c: ids.get(s, -1) for c, s in self.of_ascii.items()}
        self.memo: dict[str, int] = {}  # of pre-tokens; starts afresh when full

    def count(self, symbols: list[int]) -> int:
        """Tokens left of a pre-token's symbols when no adjacent pair can be merged."""
        n = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        merges = 0
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return n - merges

    def count_unit(self, unit: str) -> int:
        memo, total = self.memo, 0
        plain = unit.isascii()
        ids = self.ascii_ids if plain else self.ids
        tokens = _ASCII_PRETOKENS.findall(unit) if plain else [t for t, _ in self.pre_tokenizer.pre_tokenize_str(unit)]
        for token in tokens:
            n = memo.get(token)
            if n is None:
                n = self.count([ids.get(c, -1) for c in token])
                if len(memo) >= _MEMO:
                    memo.clear()
                if len(token) <= 64:
                    memo[token] = n
            total += n
        return total


@functools.lru_cache(maxsize=2)
def _worker(path: str) -> tuple[bpe.UnitMemo, tuple]:
    merger = PairMerger(path)
    return bpe.UnitMemo(lambda units: [merger.count_unit(u) for u in units]), bpe.special_strings(path)


def count_text(text: str, path: str) -> int:
    """Tokens of one text, special strings in it counting one each."""
    memo, specials = _worker(path)
    return sum(1 if isinstance(p, int) else sum(memo.values(p)) for p in bpe.split_special(text, specials))


def token_counts(
    docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, one row for each input row.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and ids give repeated results, null
    ids stay null, an empty table gives no rows, and further columns of ``docs`` are ignored.  A narrow
    map over the scan: no shuffle, memory bounded by a batch and the memo of units.
    """
    path = tokenizer_path or bpe.vocabulary_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = pa.array([count_text(t, path) for t in texts_of(batch)], pa.int64())
        sizes = pc.cast(pc.binary_length(batch.column("text")), pa.int64())
        return pa.record_batch(
            [batch.column("doc_id"), sizes, counts, pc.greater(counts, limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(
        id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
