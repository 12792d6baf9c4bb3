"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel counts the letter subsequences of length 3 and 4 that two strings share, each occurrence
weighted by 0.7 to the power of its span, spans of up to 6 letters: gaps and inserted letters weaken a
match but don't undo it.  It is scaled by each string's length.  Strings are the parts of a sentence: its
words, in lower case and with word ends marked, without accents and without whatever isn't a letter
("i.d*i-o t" spelt out is one string), and what stands between punctuation marks within words.  A sentence, and so a text, is as toxic as its worst part.

Labels belong to whole texts, so training is by multiple instances: parts that occur in toxic texts much
more than in others begin as toxic; the machine is trained on them against parts of other texts; then
each toxic text's worst part and the others' worst parts take their places, and so on.  Kernel values
with the landmarks and the machine's weights multiply out to one weight a subsequence, so that scoring a
string is a sum over its subsequences; strings are memoised.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of

DECAY, SPAN, LENGTHS = 0.7, 6, (3, 4)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the examples drawn from it, and the machine's penalty.

    Chosen by four folds of training rows alone; rows held out had no part in it.
    """

    toxic_rows: int = 1200  # rows of the sample, about
    other_rows: int = 3600
    landmarks: int = 256
    positives: int = 3000  # different parts of toxic texts that are examples in one turn
    usual: int = 1500  # the most frequent parts of other texts
    unusual: int = 4500  # further parts of other texts, at random
    worst: int = 3000  # parts of other texts that come nearest in one turn
    altered: int = 60  # examples that get variants with letters inserted or left out
    turns: int = 4
    penalty: float = 5e-5


_MEMO, _SLICE = 250_000, 10_000  # tokens remembered, and looked up at once
_BEGIN, _END = 27, 28  # codes 1-26 are a-z, 29-31 other letters, 0 none
_ALONE, _NONE = -1e9, -2e9  # marks of a single letter and of none, never scores
_RUN = re.compile(r"(.)\1{2,}")
_SPELT = re.compile(r"(?<!\S)(?:[^\W\d_][^\w\s]*\s+){2,}[^\W\d_](?![\w])")
_MARKS = re.compile(r"[^\w@$]+|_+")
#: Digits and signs that stand for the letters they look like, in tokens with letters.
_LOOKS = str.maketrans("0134@$57", "oieaasst")

_PATTERNS = {n: [(0, *rest) for rest in combinations(range(1, SPAN), n - 1)] for n in LENGTHS}


# --- Strings and subsequences ---------------------------------------------------------------------


def part(token: str) -> str:
    """A token's letters, a-z, others as '{', '|' or '}'; accents go, some digits count as letters, and a
    letter that is repeated stands twice."""
    if token.isascii():
        plain = token.lower()
    else:
        plain = unicodedata.normalize("NFKD", token.lower().replace("ß", "ss"))
    if not plain.isalpha() and any(c.isalpha() for c in plain):
        plain = plain.translate(_LOOKS)
    plain = "".join(c if "a" <= c <= "z" else "{|}"[ord(c) % 3] for c in plain if c.isalpha() and c not in "ªº")
    return _RUN.sub(r"\1\1", plain)


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The strings' codes with ends marked, zeros between, and where each begins."""
    pad = "\x60" * SPAN  # becomes 0
    text = "".join(f"\x01{s}\x02{pad}" for s in strings)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
    out = np.where(raw >= 0x7B, raw - 0x7B + 29, raw - 0x60)
    out[raw == 1], out[raw == 2] = _BEGIN, _END
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 2 + SPAN
    return out, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


#: For each span, the weights' squares of all its patterns together.
_SQUARES = Counter()
for _n in LENGTHS:
    for _pattern in _PATTERNS[_n]:
        _SQUARES[_pattern[-1]] += DECAY ** (2 * (_pattern[-1] + 1))


def scale(sizes: np.ndarray) -> np.ndarray:
    """1 / norm of strings of these lengths, ends included, were all their subsequences different."""
    squares = sum(weight * np.maximum(sizes - last, 0) for last, weight in _SQUARES.items())
    return 1 / np.sqrt(np.maximum(squares, 1e-12))


def _occurrences(flat: np.ndarray) -> list[tuple[int, float, np.ndarray]]:
    """For each pattern of gaps: the subsequences' length, weight and number at each position (0: none)."""
    n = len(flat) - SPAN + 1
    found = []
    for size in LENGTHS:
        for pattern in _PATTERNS[size]:
            index = np.zeros(n, np.int32)
            whole = np.ones(n, bool)
            for at in pattern:
                column = flat[at : at + n]
                index = (index << 5) | column
                whole &= column > 0
            found.append((size, DECAY ** (pattern[-1] + 1), np.where(whole, index, 0)))
    return found


def features(strings: list[str]) -> list[dict[int, float]]:
    """Explicit features: scaled weight of each subsequence, keyed by its number and length."""
    if not strings:
        return []
    flat, starts = codes(strings)
    owner = np.repeat(np.arange(len(strings)), np.diff([*starts, len(flat)]))
    scales = scale(np.fromiter(map(len, strings), np.int64, len(strings)) + 2)
    out: list[dict[int, float]] = [{} for _ in strings]
    for size, weight, index in _occurrences(flat):
        at = np.flatnonzero(index)
        for o, key in zip(owner[at].tolist(), (index[at].astype(np.int64) | (size << 32)).tolist(), strict=True):
            mine = out[o]
            mine[key] = mine.get(key, 0.0) + weight * scales[o]
    return out


def kernel(a: str, b: str) -> float:
    """The kernel of two strings of letters."""
    x, y = features([a, b])
    return sum(v * y.get(k, 0.0) for k, v in x.items())


# --- Training -------------------------------------------------------------------------------------


@dataclass
class Model:
    """A weight for each subsequence of length 3 and 4, an offset, and the slope and shift of a probability."""

    weights: dict[int, np.ndarray]
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, strings: list[str]) -> np.ndarray:
        """Each string's distance from the machine's boundary, toxic ones positive."""
        if not strings:
            return np.zeros(0)
        flat, starts = codes(strings)
        n = len(flat) - SPAN + 1
        total = np.zeros(len(flat), np.float32)
        for size in LENGTHS:
            table = self.weights[size]
            for pattern in _PATTERNS[size]:
                index = flat[:n]
                for at in pattern[1:]:
                    index = (index << 5) | flat[at : at + n]
                total[:n] += table[index] * np.float32(DECAY ** (pattern[-1] + 1))
        sums = np.add.reduceat(total, starts)
        return sums * scale(np.fromiter(map(len, strings), np.int64, len(strings)) + 2) + self.offset

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class _Nystrom:
    """Features k(x, landmarks) K^-1/2."""

    def __init__(self, landmarks: list[str]):
        sparse = features(landmarks)
        self.keys = {k: i for i, k in enumerate(sorted({k for f in sparse for k in f}))}
        self.matrix = np.zeros((len(self.keys), len(landmarks)))  # subsequences x landmarks
        for j, f in enumerate(sparse):
            for k, v in f.items():
                self.matrix[self.keys[k], j] = v
        values, vectors = np.linalg.eigh(self.matrix.T @ self.matrix)
        good = values > 1e-8 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def transform(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.matrix.shape[1]))
        for first in range(0, len(strings), 500):  # features of few strings at a time are in memory
            for i, f in enumerate(features(strings[first : first + 500]), first):
                known = [(self.keys[k], v) for k, v in f.items() if k in self.keys]
                if known:
                    at, v = zip(*known, strict=True)
                    out[i] = np.array(v) @ self.matrix[list(at)]
        return out @ self.root

    def multiplied_out(self, w: np.ndarray) -> dict[int, np.ndarray]:
        weights = {n: np.zeros(1 << (5 * n), np.float32) for n in LENGTHS}
        for key, value in zip(self.keys, self.matrix @ (self.root @ w), strict=True):
            weights[key >> 32][key & 0xFFFFFFFF] = value
        return weights


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, in the primal, by Newton steps; y is 1 or
    -1, ``cost`` weighs the examples.  The loss is convex and piecewise quadratic, so few steps do."""
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.full(full.shape[1], penalty)
    ridge[-1] = penalty / 100  # the offset is hardly held back
    share = cost / cost.sum()

    def loss(w: np.ndarray) -> float:
        return 0.5 * (ridge * w * w).sum() + (share * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()

    w = np.zeros(full.shape[1])
    for _ in range(steps):
        inside = 1 - y * (full @ w)
        active = inside > 0
        part = full[active] * share[active, None]
        gradient = ridge * w - 2 * part.T @ (y[active] * inside[active])
        step = np.linalg.solve(np.diag(ridge) + 2 * part.T @ full[active], gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _distinct_rows(rows: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """One row of each group of near copies, which would else make chance words look telling."""
    seen: set[tuple] = set()
    kept = []
    for label, parts in rows:
        order = sorted(parts, key=lambda p: hash_of(p))
        marks = [(k, *order[4 * k : 4 * k + 4]) for k in range(3) if len(order) >= 4 * k + 4] or [(9, *order)]
        if not any(m in seen for m in marks):
            kept.append((label, parts))
        seen.update(marks)
    return kept


def _altered(string: str, rng: np.random.Generator) -> list[str]:
    """A string with a letter inserted, twice, and with one left out: insults are written so, too."""
    if len(string) < 5:
        return []
    out = []
    for _ in range(2):
        at = int(rng.integers(1, len(string)))
        out.append(string[:at] + chr(97 + int(rng.integers(26))) + string[at:])
    at = int(rng.integers(1, len(string) - 1))
    return [*out, string[:at] + string[at + 1 :]]


def hash_of(text: str) -> int:
    return zlib.crc32(text.encode()) * 2654435761 % (1 << 32)


def train(rows: list[tuple[int, list[str]]], settings: Settings = Settings(), seed: int = 5) -> Model:
    """A model from (label, distinct parts) of texts.  Without both labels, one that knows of nothing."""
    rng = np.random.default_rng(seed)
    rows = _distinct_rows(rows)
    toxic = [p for y, p in rows if y == 1 and p]
    other = [p for y, p in rows if y != 1 and p]
    nothing = Model({n: np.zeros(1 << (5 * n), np.float32) for n in LENGTHS}, -1.0, 1.0, -4.0)
    if not toxic or not other:
        return nothing
    aside_t, fit_t = toxic[::5], [p for i, p in enumerate(toxic) if i % 5] or toxic
    aside_o, fit_o = other[::5], [p for i, p in enumerate(other) if i % 5] or other
    in_toxic = Counter(p for parts in fit_t for p in parts)
    in_other = Counter(p for parts in fit_o for p in parts)
    ratio = len(fit_o) / len(fit_t)
    least = max(2, 0.002 * len(fit_t))
    odds = {p: (n + 0.1) / (in_other.get(p, 0) / ratio + 0.1) for p, n in in_toxic.items()}
    found = Counter({p: n for p, n in in_toxic.items() if n >= least and odds[p] >= 20 and n - in_other.get(p, 0) >= 3})
    if not found:
        best = sorted(in_toxic, key=lambda p: (-odds[p], p))[:20]
        found = Counter({p: in_toxic[p] for p in best})
    telling = dict(found)
    usual = [p for p in sorted(in_other) if len(p) > 1]
    by_use = sorted(usual, key=lambda p: (-in_other[p], p))
    against = set(by_use[: settings.usual]) | {usual[i] for i in rng.permutation(len(usual))[: settings.unusual]}
    model = nothing
    for turn in range(settings.turns):
        positive = sorted(found, key=lambda p: (-found[p], p))[: settings.positives]
        negative = sorted(against - found.keys())
        if not negative:
            return nothing
        some = [positive[i] for i in rng.permutation(len(positive))[: settings.landmarks // 4]]
        landmarks = list(dict.fromkeys(positive[: settings.landmarks // 3] + some))
        landmarks += [negative[i] for i in rng.permutation(len(negative))[: settings.landmarks - len(landmarks)]]
        space = _Nystrom(landmarks)
        use = [found[p] ** 0.5 for p in positive]
        for p, n in zip(positive[: settings.altered], use[: settings.altered], strict=True):
            variants = [v for v in _altered(p, rng) if v not in against]
            positive = positive + variants
            use = use + [0.3 * n] * len(variants)
        strings = positive + negative
        x = space.transform(strings)
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        use = np.array(use)
        cost = np.concatenate([use / use.sum() / 2, np.full(len(negative), 1 / len(negative))])
        w, b = _machine(x, y, cost, settings.penalty)
        model = Model(space.multiplied_out(w), b)
        if turn == settings.turns - 1:
            break
        found, worst_other = Counter(telling), Counter()  # what tells by itself stays
        for parts, into, least_margin in ((fit_t, found, 0.0), (fit_o, worst_other, -1.0)):
            flat = sorted({p for ps in parts for p in ps})
            margin = dict(zip(flat, model.margins(flat).tolist(), strict=True))
            for ps in parts:
                worst = max(ps, key=lambda p: (margin[p], p))
                if margin[worst] > least_margin and not (into is found and in_other.get(worst, 0) > 0.2 * in_toxic[worst]):
                    into[worst] += 1
        if not found:
            found = Counter(dict.fromkeys(positive[: settings.positives], 1))
        against |= set(sorted(worst_other, key=lambda p: (-worst_other[p], p))[: settings.worst])
    margins = [[float(model.margins(ps).max()) for ps in group] for group in (aside_t, aside_o)]
    z = np.array(margins[0] + margins[1])
    target = np.array([1.0] * len(margins[0]) + [0.0] * len(margins[1]))
    model.slope, model.shift = _logistic(z, target)
    return model


def _logistic(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability, by Newton's method with a little shrinkage; the slope stays positive."""
    n1, n0 = target.sum(), (1 - target).sum()
    soft = np.where(target > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = p * (1 - p) + 1e-6
        g = np.array([((p - soft) * z).sum() + 1e-3 * a, (p - soft).sum()])
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return (float(a), float(b)) if a > 0 else (1.0, float(np.log(max(n1, 0.5) / max(n0, 0.5))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        settings: Settings = Settings()) -> Model:
    """A model from about ``settings.toxic_rows`` toxic and ``settings.other_rows`` other labelled rows, picked
    by a hash of the id.

    ``docs`` must hold training rows only, and only their labels count.  Rows without id, label or text don't
    count; of contradictory labels of one id, toxic counts; repeated ids give as many examples.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.max((F.col(label_col) == 1).cast("int")).alias("__label")
    )
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ours = materialize(marked.join(texts.select(F.col(id_col).alias("__id")), "__id", "left_semi"), "labels")
    counts = {r[0]: r[1] for r in ours.groupBy("__label").count().collect()}
    bounds = ((1, settings.toxic_rows), (0, settings.other_rows))
    share = {y: int((1 << 30) * min(1.0, most / max(counts.get(y, 0), 1))) for y, most in bounds}
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("__id")), F.lit(1 << 30))
    picked = ours.where(place < F.when(F.col("__label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    sample = texts.join(F.broadcast(picked), F.col(id_col) == F.col("__id"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [sorted(set(parts_of(t))) for t in texts_of(batch)]
        return pa.record_batch([batch.column("id"), batch.column("label"), pa.array(parts, pa.list_(pa.string()))], ["id", "label", "parts"])

    chosen = sample.select(F.col("__id").cast("long").alias("id"), F.col("__label").alias("label"), F.col(text_col).alias("text"))
    rows = map_batches(chosen, run, "id long, label int, parts array<string>").toArrow().sort_by("id")
    known: dict[str, str] = {}  # a part that many rows have is one string
    examples = [(y.as_py(), [known.setdefault(p, p) for p in parts.as_py()]) for y, parts in zip(rows["label"], rows["parts"], strict=True)]
    del rows, known
    pa.default_memory_pool().release_unused()
    return train(examples, settings)


# --- Scoring --------------------------------------------------------------------------------------


def spelt_out(text: str) -> list[str]:
    """Strings of single letters with space between them, as one part each."""
    return [p for m in _SPELT.finditer(text) if len(p := part(m[0])) > 2]


def parts_of_token(token: str) -> list[str]:
    """The part of a token as a whole and, if punctuation stands within, those between the marks."""
    pieces = [] if token.isalpha() else [p for p in _MARKS.split(token) if p]
    return [part(token), *(part(p) for p in pieces if p != token)] if len(pieces) > 1 else [part(token)]


def parts_of(text: str) -> list[str]:
    return [p for t in text.split() for p in parts_of_token(t) if len(p) > 1] + spelt_out(text)


class Scorer:
    """Margins of texts, with a bounded memo of tokens' margins."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, float] = {}
        self.least = float(model.margins([""])[0]) if model else 0.0

    def margin(self, text: str) -> float:
        """That of the text's worst part; of a text without parts, that of the empty string."""
        worst, alone = self.least, 0
        tokens = text.split()
        for at in range(0, len(tokens), _SLICE):
            mine = tokens[at : at + _SLICE]
            found = list(map(self.memo.get, mine))
            if None in found:
                self._learn(list(dict.fromkeys(t for t, m in zip(mine, found, strict=True) if m is None)), mine)
                found = list(map(self.memo.get, mine))
            alone += found.count(_ALONE)
            worst = max(worst, max(found))
        if alone > 2 and (spelt := spelt_out(text)):
            worst = max(worst, float(self.model.margins(spelt).max()))
        return worst

    def _learn(self, missing: list[str], needed: list[str]) -> None:
        if len(self.memo) + len(missing) > _MEMO:
            self.memo.clear()
            missing = list(dict.fromkeys(needed))
        strings = [parts_of_token(t) for t in missing]
        margins = iter(self.model.margins([p for ps in strings for p in ps]).tolist())
        for token, ps in zip(missing, strings, strict=True):
            found = [m if len(p) > 1 else _ALONE if p else _NONE for p, m in zip(ps, margins)]  # noqa: B905
            self.memo[token] = max(found) if len(ps[0]) > 1 else found[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, from its whole text.

    Null texts count as empty; a text without parts scores as an empty string does.  Repeated rows give
    repeated results, null ids stay null, an empty table gives no rows, further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed in size: 31^4 weights
    cell: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = cell.get("scorer") or cell.setdefault("scorer", Scorer(shared.value))
        p = scorer.model.probability(np.array([scorer.margin(t) for t in texts_of(batch)]))
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lit(False) if held_out is None else held_out).alias("held_out"),
    )
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def harmless(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.  A narrow map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cell: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = cell.get("scorer") or cell.setdefault("scorer", Scorer(shared.value))
        p = scorer.model.probability(np.array([scorer.margin(t) for t in texts_of(batch, text_col)]))
        return batch.filter(pa.array(p < threshold))

    return map_batches(docs, run, docs.schema)
