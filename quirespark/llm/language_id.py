"""Language identification: averaged hashed subword embeddings and a linear softmax.

Words are cut into hashed runs of 2 to 4 characters, ends marked.  A text's vector is the mean of its
subwords' embeddings; a linear layer with softmax gives the languages.  Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows (and slices of them, for short texts); a
temperature fitted on documents set aside calibrates the probabilities.

A text is rejected by the share of its subwords that no training text of any language holds, so that the
number of languages doesn't matter and a text in several of them stays.  What share a language's own texts
reach is measured on its training documents, each against all the others.  As these share a vocabulary, a
text of other words would be beyond that share: one that is no more than a third unseen stays, too, if what
is seen speaks plainly for a language, by the best logit, which strange texts keep near zero.

For scoring, embeddings and layer are multiplied out to one number per subword and language, so that a
text's logits are means over its words, which are memoised.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

UNKNOWN = "und"
BUCKETS = 1 << 15
SHORTEST, LONGEST = 2, 4
#: Bounds of the training sample and of the model.
PER_LANGUAGE = 600
DIMENSIONS, EPOCHS, RATE = 16, 6, 0.5
#: Subwords are remembered by this many values, so that hardly one passes for another.
FINE = 1 << 24
#: A language's limit of unseen subwords: so many times what all but a share of its own documents keep to, and at least this.
MARGIN, BEYOND, LEAST = 2.0, 0.005, 0.02
#: Short texts may be beyond the limit by so many standard deviations, a word being about so many subwords.
DEVIATIONS, A_WORD = 2.0, 8.0
#: A text of new words may have so large a share of unseen subwords if its best logit is at least this, less
#: so much by the root of its number of subwords, as means over few vary.
STRANGEST, PLAIN, VARIES = 1 / 3, 2.5, 11.0
_MEMO, _SLICE = 250_000, 10_000  # words remembered, and looked up at once


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def fine_subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords, below ``FINE``, of lower-case words, one after another, and how many each word has.

    Whatever isn't a letter parts a word; each part has its ends marked.
    """
    text = "\n".join(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    breaks = codes == 10  # words hold no white space
    owner = np.cumsum(breaks)
    is_letter = _letters()[codes.astype(np.int64)]
    # A mark (1) before and after each part: every character takes two places, and those that aren't
    # letters, and places between letters, are taken out.
    n = len(codes)
    begins = is_letter & ~np.concatenate([[False], is_letter[:-1]])
    ends = is_letter & ~np.concatenate([is_letter[1:], [False]])
    places = np.zeros((n, 4), np.uint64)
    places[:, 0] = begins
    places[:, 1] = np.where(is_letter, codes, 0)
    places[:, 2] = ends
    keep = np.stack([begins, is_letter, ends, ends], axis=1)  # after each part a zero, that no subword spans
    flat, of = places[keep], np.repeat(owner, 4).reshape(n, 4)[keep]
    hashes, owners = [], []
    rolling = flat.copy()
    whole = flat > 0
    for size in range(2, LONGEST + 1):
        if len(flat) < size:
            break
        rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[size - 1 :]
        whole = whole[:-1] & (flat[size - 1 :] > 0)
        if size >= SHORTEST:
            found = rolling[whole]
            found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append(found >> np.uint64(40))
            owners.append(of[: len(whole)][whole])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    ids, owners = np.concatenate(hashes).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same, as buckets."""
    ids, counts = fine_subwords(words)
    return ids % BUCKETS, counts


@dataclass
class Model:
    """Logits of each subword bucket, the layer's bias, the languages and the temperature; a bit for each
    subword that training saw, and the languages' limits of unseen ones (without them nothing is unseen)."""

    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    seen: np.ndarray | None = None
    limits: np.ndarray | None = None

    def unseen(self, fine: np.ndarray) -> np.ndarray:
        if self.seen is None:
            return np.zeros(len(fine), bool)
        return (self.seen[fine >> 3] >> (7 - (fine & 7))) & 1 == 0

    def familiar(self, best: np.ndarray, unseen: np.ndarray, counts: np.ndarray, logit: np.ndarray) -> np.ndarray:
        """Whether texts, likeliest in languages ``best`` by a ``logit``, keep to these languages' limits, or are
        plainly in one though of new words."""
        if self.limits is None:
            return np.ones(len(best), bool)
        limit, n = self.limits[best], np.maximum(counts, 1)
        within = unseen / n <= limit + DEVIATIONS * np.sqrt(limit * (1 - limit) * A_WORD / n)
        return within | (unseen / n <= STRANGEST) & (logit >= PLAIN - VARIES / np.sqrt(n))

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _examples(text: str, slices: int = 2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse counts of a text's subwords, and of slices of it of 4 to 16 words."""
    words = text.lower().split()
    spans = [(0, len(words))]
    rng = np.random.default_rng(len(text))
    if len(words) > 20:
        for _ in range(slices):
            size = int(rng.integers(4, 17))
            at = int(rng.integers(0, len(words) - size))
            spans.append((at, at + size))
    found = [np.unique(subwords(words[a:b])[0], return_counts=True) for a, b in spans]
    return [(ids, n) for ids, n in found if len(ids)]


def familiarity(documents: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each subword of (language, fine ids, counts), and each language's limit of unseen ones."""
    held = np.zeros(FINE, np.uint8)  # by no document, by one, by more
    for _, ids, _ in documents:
        held[ids] = np.minimum(held[ids] + 1, 2)
    shares = [[] for _ in range(languages)]
    for language, ids, counts in documents:
        shares[language].append(counts[held[ids] < 2].sum() / counts.sum())  # unseen but for the document itself
    limits = [min(1.0, max(LEAST, MARGIN * float(np.quantile(s, 1 - BEYOND)))) if s else 1.0 for s in shares]
    return np.packbits(held > 0), np.array(limits)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], set_aside: list[bool], seed: int = 7) -> Model:
    """Stochastic gradient descent over (language, bucket ids, counts); those ``set_aside`` give the temperature."""
    rng = np.random.default_rng(seed)
    fit = [e for e, out in zip(examples, set_aside, strict=True) if not out] or examples
    aside = [e for e, out in zip(examples, set_aside, strict=True) if out]
    embeddings = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    touched = np.zeros(BUCKETS, bool)
    layer, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, step = EPOCHS * len(fit), 0
    share = np.bincount([e[0] for e in fit], minlength=len(languages)) / max(len(fit), 1)
    weight = 1 / np.maximum(share * len(languages), 1e-9)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            label, ids, counts = fit[k]
            rate = RATE * (1 - step / steps)
            step += 1
            part = counts / counts.sum()
            vector = part @ embeddings[ids]
            logits = vector @ layer + bias
            gap = np.exp(logits - logits.max())
            gap /= gap.sum()
            gap[label] -= 1
            gap *= min(weight[label], 5.0)
            back = layer @ gap
            layer -= rate * np.outer(vector, gap)
            bias -= 0.1 * rate * gap
            embeddings[ids] -= rate * len(ids) ** 0.5 * part[:, None] * back
            touched[ids] = True
    embeddings[~touched] = 0  # an unseen subword speaks for no language
    model = Model(languages, (embeddings @ layer).astype(np.float32), bias)
    if aside:
        sums = np.stack([n @ model.table[ids] for _, ids, n in aside])
        counts = np.array([n.sum() for _, _, n in aside])
        labels = np.array([e[0] for e in aside])
        losses = {}
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = float(t)
            p = model.probabilities(sums, counts)[np.arange(len(labels)), labels]
            losses[float(t)] = -np.log(np.maximum(p, 1e-12)).mean()
        model.temperature = min(losses, key=losses.get)
    return model


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages in ``label_col``, from about ``per_language`` rows of each, picked by a
    hash of the id.  ``docs`` must hold training rows only.

    Rows without label or text don't count; repeated rows give as many examples, in the order of their ids;
    a text under two labels is an example of both; without any row all texts are of an unknown language.
    Every fifth text, by its hash, is set aside with all its slices and copies for the temperature."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}  # a row for each language
    languages = sorted(counts)
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30))
    limit = F.lit(0)
    for language in languages:
        limit = F.when(F.col(label_col) == language, F.lit(int((1 << 30) * min(1.0, per_language / counts[language])))).otherwise(limit)
    sample = labelled.where(place < limit).select(
        F.col(label_col).alias("label"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        (F.pmod(F.xxhash64(text_col), F.lit(5)) == 0).alias("aside"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for label, doc, text, aside in zip(*(batch.column(c).to_pylist() for c in ("label", "doc_id", "text", "aside")), strict=True):
            for k, (ids, n) in enumerate(_examples(text)):
                fine, fine_n = (x.tolist() for x in np.unique(fine_subwords(text.lower().split())[0], return_counts=True)) if k == 0 else ([], [])
                out.append((label, doc, aside, k, ids.tolist(), n.tolist(), fine, fine_n))
        columns = list(zip(*out, strict=True)) or [[]] * 8
        numbers = pa.list_(pa.int32())
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), numbers, numbers, numbers, numbers)
        names = ["label", "doc_id", "aside", "k", "ids", "counts", "fine", "fine_n"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "label string, doc_id long, aside boolean, k int, ids array<int>, counts array<int>, fine array<int>, fine_n array<int>"
    rows = map_batches(sample, run, schema).toArrow().sort_by([("doc_id", "ascending"), ("k", "ascending")])
    number = {language: i for i, language in enumerate(languages)}
    examples = [
        (number[r.as_py()], i.values.to_numpy(), n.values.to_numpy())
        for r, i, n in zip(rows["label"], rows["ids"], rows["counts"], strict=True)
    ]
    whole = [
        (number[r.as_py()], i.values.to_numpy(), n.values.to_numpy())
        for r, k, i, n in zip(rows["label"], rows["k"], rows["fine"], rows["fine_n"], strict=True)
        if k.as_py() == 0 and len(i)
    ]
    seen, limits = familiarity(whole, len(languages))
    aside = rows["aside"].to_pylist()
    del whole
    model = train(examples, languages, aside)
    model.seen, model.limits = seen, limits
    del examples, rows
    pa.default_memory_pool().release_unused()  # the driver may train other models yet
    return model


class Scorer:
    """Probabilities of texts, with a bounded memo of words' logits."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.languages) + 2
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, self.width), np.float32)  # logits, number of unseen subwords and of all

    def _learn(self, words: list[str]) -> None:
        fine, counts = fine_subwords(words)
        ids = fine % BUCKETS
        owner = np.repeat(np.arange(len(words)), counts)
        logits = [np.bincount(owner, self.model.table[ids, k], len(words)) for k in range(self.width - 2)]
        new = np.stack([*logits, np.bincount(owner, self.model.unseen(fine), len(words)), counts], axis=1)
        if len(self.index) + len(words) > _MEMO:
            self._clear()
        at = len(self.index)
        while at + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[at : at + len(words)] = new
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def sum_of(self, text: str) -> np.ndarray:
        total = np.zeros(self.width)
        words = text.lower().split()
        for at in range(0, len(words), _SLICE):
            part = words[at : at + _SLICE]
            found = list(map(self.index.get, part))
            if None in found:
                missing = list(dict.fromkeys(w for w, i in zip(part, found, strict=True) if i is None))
                before = len(self.index)
                self._learn(missing)
                if len(self.index) < before + len(missing):  # it was cleared
                    self._learn([w for w in dict.fromkeys(part) if w not in self.index])
                found = list(map(self.index.get, part))
            total += self.sums[found].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Likeliest languages, their probabilities, and whether the texts are in languages of the model."""
        sums = np.array([self.sum_of(t) for t in texts]).reshape(-1, self.width)
        counts = sums[:, -1]
        p = self.model.probabilities(sums[:, :-2], counts)
        best = p.argmax(axis=1)
        names = [self.model.languages[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
        logit = (sums[:, :-2] / np.maximum(counts, 1)[:, None] + self.model.bias).max(axis=1, initial=-np.inf)
        known = (counts > 0) & self.model.familiar(best, sums[:, -2], counts, logit)
        return names, np.where(counts > 0, p.max(axis=1), 0.0), known


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, from its whole text.

    ``lang_pred`` is the likeliest language, or ``und``, with score 0, for null texts and texts without a
    letter.  Ties go to the language first in order.  Repeated rows give repeated results, null ids stay
    null, an empty table gives no rows, further columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # fixed in size: BUCKETS rows
    cell: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = cell.get("scorer") or cell.setdefault("scorer", Scorer(shared.value))
        names, scores, _ = scorer.predict(texts_of(batch))
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lit(False) if held_out is None else held_out).alias("held_out"),
    )
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't rejected: it has a letter and hardly more subwords
    unseen in training than documents of its likeliest language have (a text of n subwords may be beyond the
    limit by ``DEVIATIONS`` deviations of n / ``A_WORD`` words), or at most ``STRANGEST`` unseen ones and a logit
    that is plain (see ``PLAIN``).  Null and empty texts go; repeated rows stay or go together; an empty table gives no rows.  A
    narrow map: texts aren't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cell: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = cell.get("scorer") or cell.setdefault("scorer", Scorer(shared.value))
        _, _, known = scorer.predict(texts_of(batch, text_col))
        return batch.filter(pa.array(known))

    return map_batches(docs, run, docs.schema)
