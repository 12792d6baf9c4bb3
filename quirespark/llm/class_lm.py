"""Language-model scoring with Brown class-based n-grams.

A word's probability is that of its class after the previous word's class times that of the word within
its class.  Exchange clustering makes the classes: the most frequent words start in classes by rank and
each moves, again and again, to the class where the likelihood of the class bigrams grows most; then all
other units are put where it grows most given those classes, in parallel.  A *unit* is a word of the lexicon,
or all other words whose last three letters fall into the same bucket, so that a word that training never saw
has a class, too.  Counts of all words, seen or not, are exact and cover all training documents, however many
different words there are; only tables of bounded size (units, classes) come to the driver.

Smoothing: class transitions are mixed with the classes' own shares; within a class, an absolute discount
(from the numbers of words seen once and twice) is set aside for words that training never saw.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship


_SLICE = 512  # rows of a batch that is handed on


@dataclass(frozen=True)
class Settings:
    """Sizes that bound the model, and the weight of the classes' own shares in transitions."""

    classes: int = 32
    clustered: int = 2048  # words that move one by one
    looked_up: int = 131072  # words whose counts all executors hold; other words' counts are joined
    buckets: int = 2048  # units of rarer words
    sweeps: int = 12
    mixing: float = 20.0
    flush: int = 120_000  # different words that a task counts before it hands them on


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.encode().lower().split()


def bucket_of(word: bytes, buckets: int) -> int:
    """By the last three letters."""
    return zlib.crc32(word.decode()[-3:].encode()) % buckets


# --- Counting -------------------------------------------------------------------------------------


def _count_words(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words, n = list(counts), list(counts.values())
            counts.clear()
            return pa.record_batch([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column("text"):
                counts.update(words_of(value.as_py()))
                if len(counts) > flush:
                    yield out()
        if counts:
            yield out()

    return run


def word_counts(docs: DataFrame, flush: int = Settings.flush) -> DataFrame:
    """``word binary, c`` over all whole texts of ``docs``."""
    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(_count_words(flush), "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """The words whose counts all executors hold, most frequent first, and the units of all."""

    index: dict[bytes, int]
    counts: np.ndarray
    unit: np.ndarray  # by word number; then one number for each bucket; the end of a text is last
    settings: Settings

    @property
    def end(self) -> int:
        return len(self.unit) - 1

    @property
    def n_units(self) -> int:
        return self.settings.looked_up + self.settings.buckets + 1


def _most_frequent(counts: DataFrame, most: int) -> Column:
    """Which words the lexicon takes, at most ``most``: those that reach a count, from a histogram with 32
    steps a doubling, and of the step below it as many, by a hash, as there is room for.  No task ever
    sorts or merges the words of all others."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 32)
    place = F.pmod(F.xxhash64("word"), F.lit(4096))
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()  # < 2,048 rows
    reached, least = 0, 1 << 62
    for row in sorted(histogram, key=lambda r: -r["step"]):
        if reached + row["words"] > most:
            below = step == F.lit(row["step"])
            upto, places = 0, counts.where(below).groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("words")).collect()  # <= 4,096 rows
            held = {r["place"]: r["words"] for r in places}
            while reached + held.get(upto, 0) <= most:
                reached += held.get(upto, 0)
                upto += 1
            return (F.col("c") >= F.lit(least)) | (below & (place < F.lit(upto)))
        reached += row["words"]
        least = row["least"]
    return F.col("c") >= F.lit(least)


def lexicon(counts: DataFrame, settings: Settings) -> Lexicon:
    often = counts.where(_most_frequent(counts, settings.looked_up))
    top = often.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = top["word"].to_pylist()
    unit = np.arange(settings.looked_up + settings.buckets + 1, dtype=np.int32)
    return Lexicon({w: i for i, w in enumerate(words)}, np.array(top["c"].to_pylist(), np.float64), unit, settings)


def _encode(shared) -> object:
    """Texts as word numbers, with the words that the lexicon lacks and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        get, first, buckets = lex.index.get, lex.settings.looked_up, lex.settings.buckets
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):  # small batches go back, whatever comes in
                batch = whole.slice(at, _SLICE)
                sequences, rare_words, rare_counts, sizes = [], [], [], []
                for value in batch.column("text"):
                    words = words_of(value.as_py())
                    numbers = list(map(get, words))
                    rare: Counter[bytes] = Counter()
                    if None in numbers:
                        for i, k in enumerate(numbers):
                            if k is None:
                                rare[words[i]] += 1
                                numbers[i] = first + bucket_of(words[i], buckets)
                    numbers.append(lex.end)
                    sequences.append(np.array(numbers, "<i4").tobytes())
                    sizes.append(len(numbers))
                    rare_words.append(list(rare))
                    rare_counts.append(list(rare.values()))
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes, pa.int64()), pa.array(sequences, pa.binary()),
                     pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_counts, pa.list_(pa.int32()))],
                    ["doc_id", "held_out", "n_tokens", "numbers", "rare", "rare_n"],
                )

    return run


_ENCODED = "doc_id long, held_out boolean, n_tokens long, numbers binary, rare array<binary>, rare_n array<int>"


def _sum_over(encoded: DataFrame, shared, table, size: int) -> DataFrame:
    """``key, n``: the sum over documents of ``table(lexicon, numbers)``, keys below ``size``, which are
    added up in a task before they are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                column = batch.column("numbers").slice(at, 256)
                if len(column):
                    flat = np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in column])
                    keys = table(shared.value, flat)
                    if size <= 1 << 16:
                        total += np.bincount(keys, minlength=size)
                    else:  # only the keys at hand are touched
                        some, n = np.unique(keys, return_counts=True)
                        total[some] += n
        keys = np.flatnonzero(total)
        for at in range(0, len(keys), 1 << 18):
            some = keys[at : at + (1 << 18)]
            yield pa.record_batch([pa.array(some), pa.array(total[some])], ["key", "n"])

    rows = encoded.select("numbers").mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _collected(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums by key as an array; its size is bounded by the settings."""
    rows, out = sums.toArrow(), np.zeros(math.prod(shape))
    out[rows["key"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(shape)


def _sparse_sum_over(encoded: DataFrame, shared, table, most: int = 1 << 21) -> DataFrame:
    """The same for keys without bound: a task adds up at most ``most`` keys before it hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            for at in range(0, len(keys), 1 << 18):
                yield pa.record_batch([pa.array(keys[at : at + (1 << 18)]), pa.array(n[at : at + (1 << 18)])], ["key", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                column = batch.column("numbers").slice(at, 256)
                if len(column):
                    waiting.append(table(shared.value, np.concatenate([np.frombuffer(v.as_buffer(), "<i4") for v in column])))
                    size += len(waiting[-1])
                    if size >= most:
                        yield from out()
                        waiting, size = [], 0
        if size:
            yield from out()

    rows = encoded.select("numbers").mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


# --- Clustering -----------------------------------------------------------------------------------


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """How much the likelihood of class bigrams grows if a word, now in no class, joins each class.

    ``n``: class bigram counts; ``right``, ``left``: the word's counts with classes after and before it;
    ``own``: its count with itself.
    """
    rows = _h(n + right) - _h(n)  # [class, class after]
    columns = _h(n + left[:, None]) - _h(n)  # [class before, class]
    d = np.diagonal(n)
    inside = _h(d + right + left + own) - _h(d)
    gain = rows.sum(axis=1) - np.diagonal(rows) + columns.sum(axis=0) - np.diagonal(columns) + inside
    after, before = n.sum(axis=1), n.sum(axis=0)
    all_right, all_left = right.sum() + own, left.sum() + own
    # A class's margin holds the word's counts with its members wherever the word goes.
    return gain - (_h(after + left + all_right) - _h(after + left)) - (_h(before + right + all_left) - _h(before + right))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each word (most frequent first) by the exchange algorithm over their bigram counts."""
    words = len(bigrams)
    member = np.arange(words) % classes
    one_hot = np.eye(classes)[member]
    right, left = bigrams @ one_hot, bigrams.T @ one_hot  # counts with classes after, before
    n = one_hot.T @ right
    for _ in range(sweeps):
        moves = 0
        for w in range(words):
            c, own = member[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[c] -= own
            l[c] -= own
            n[c] -= r
            n[:, c] -= l
            n[c, c] -= own
            d = int(_gains(n, r, l, own).argmax())
            if d != c:
                moves += 1
                member[w] = d
                right[:, c] -= bigrams[:, w]
                right[:, d] += bigrams[:, w]
                left[:, c] -= bigrams[w]
                left[:, d] += bigrams[w]
            n[d] += r
            n[:, d] += l
            n[d, d] += own
        if moves <= words // 200:
            break
    return member


def assign(n: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each unit outside the clustering, the class where the likelihood grows most; the largest class
    for units that never stand beside a clustered word."""
    out = np.full(len(right), int(n.sum(axis=1).argmax()))
    for i in np.flatnonzero(right.sum(axis=1) + left.sum(axis=1)):
        out[i] = int(_gains(n, right[i], left[i], 0.0).argmax())
    return out


def _assigned(around: DataFrame, n: np.ndarray, k: int) -> DataFrame:
    """``unit, class`` from ``key, n`` (unit x 2k + class after, or k + class before): units in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                beside = np.zeros((batch.num_rows, 2 * k))
                for i, pairs in enumerate(batch.column("pairs").to_pylist()):
                    for pair in pairs:
                        beside[i, pair["place"]] = pair["n"]
                yield pa.record_batch([batch.column("unit"), pa.array(assign(n, beside[:, :k], beside[:, k:]))], ["unit", "class"])

    width = F.lit(2 * k)
    pair = F.struct((F.col("key") % width).alias("place"), F.col("n").alias("n"))
    units = around.groupBy(F.floor(F.col("key") / width).alias("unit")).agg(F.collect_list(pair).alias("pairs"))  # 2k pairs at most
    return units.mapInArrow(run, "unit long, class long")


# --- Model ----------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    train_tokens: int
    ends: int  # training documents
    distinct: int
    discount: float
    unit_class: np.ndarray
    transition: np.ndarray  # log10, [before, class]; the end of a text is the last class
    number_emission: np.ndarray = field(default=None)  # log10, by word number; of buckets: less their words' own part
    unseen: np.ndarray = field(default=None)  # log10 of a class's set-aside counts

    def document(self, numbers: np.ndarray) -> tuple[float, float, int]:
        """log10 of the text but for the rarer words' own parts; base sum and known tokens likewise."""
        lex = self.lexicon
        c = self.unit_class[lex.unit[numbers]]
        before = np.concatenate([[len(self.transition) - 1], c[:-1]])
        score = self.transition[before, c].sum() + self.number_emission[numbers].sum()
        seen = numbers[(numbers < len(lex.counts))]
        base = np.log10(lex.counts[seen] + 1).sum()
        return float(score), float(base), len(seen)


def fit(encoded: DataFrame, counts: DataFrame, shared, settings: Settings) -> Model:
    """The model from training documents' encoded rows (``encoded``) and all their word counts."""
    lex: Lexicon = shared.value
    train = encoded.where(~F.col("held_out"))
    m, k, u = settings.clustered, settings.classes, lex.n_units

    def top_pairs(lex: Lexicon, flat: np.ndarray) -> np.ndarray:
        top = flat < m
        both = top[:-1] & top[1:]
        return flat[:-1][both].astype(np.int64) * m + flat[1:][both]

    bigrams = _collected(_sum_over(train, shared, top_pairs, m * m), (m, m))
    member = np.arange(m) % k
    live = min(m, len(lex.counts))
    if live:
        member[:live] = exchange(bigrams[:live, :live], k, settings.sweeps)
    one_hot = np.eye(k)[member]
    n = one_hot.T @ bigrams @ one_hot

    def beside(lex: Lexicon, flat: np.ndarray) -> np.ndarray:
        units, top = lex.unit[flat].astype(np.int64), flat < m
        word, end = units >= m, flat == lex.end
        after = word[:-1] & ~end[:-1] & top[1:]
        before = word[1:] & ~end[1:] & top[:-1]
        return np.concatenate([units[:-1][after] * (2 * k) + member[flat[1:][after]], units[1:][before] * (2 * k) + k + member[flat[:-1][before]]])

    found = _assigned(_sparse_sum_over(train, shared, beside), n, k).toArrow()  # a row for each unit
    unit_class = np.full(u, int(n.sum(axis=1).argmax()))  # units that never stand beside a clustered word
    unit_class[:m] = member
    unit_class[found["unit"].to_numpy()] = found["class"].to_numpy()
    unit_class[-1] = k

    def steps(lex: Lexicon, flat: np.ndarray) -> np.ndarray:
        # A text's words follow the end of the one before, so that ends stand for beginnings, too.
        c = unit_class[lex.unit[flat]]
        return np.concatenate([[k], c[:-1]]) * (k + 1) + c

    moved = _collected(_sum_over(train, shared, steps, (k + 1) ** 2), (k + 1, k + 1))
    shares = (moved.sum(axis=0) + 1) / (moved.sum() + k + 1)
    transition = (moved + settings.mixing * shares) / (moved.sum(axis=1, keepdims=True) + settings.mixing)

    # Words of the classes: tokens, different words, once and twice seen.
    in_lexicon = F.broadcast(counts.sparkSession.createDataFrame(pa.table({"word": pa.array(list(lex.index), pa.binary())})))
    ending = F.crc32(F.encode(F.right(F.decode("word", "UTF-8"), F.lit(3)), "UTF-8")) % F.lit(settings.buckets)
    rarer = counts.join(in_lexicon, "word", "left_anti").groupBy(ending.alias("bucket")).agg(
        F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words"),
        F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice"),
    ).toArrow()  # a row for each bucket
    numbers_class = unit_class[lex.unit]
    tokens, words = np.zeros(k + 1), np.zeros(k + 1)
    known = len(lex.counts)
    np.add.at(tokens, numbers_class[:known], lex.counts)
    np.add.at(words, numbers_class[:known], 1)
    once, twice = float((lex.counts == 1).sum()), float((lex.counts == 2).sum())
    if rarer.num_rows:
        at = numbers_class[settings.looked_up + rarer["bucket"].to_numpy()]
        np.add.at(tokens, at, rarer["tokens"].to_numpy())
        np.add.at(words, at, rarer["words"].to_numpy())
        once, twice = once + sum(rarer["once"].to_pylist()), twice + sum(rarer["twice"].to_pylist())
    ends = float(moved[:, k].sum())
    tokens[k] = ends
    discount = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    with np.errstate(divide="ignore"):
        in_class = np.log10(np.maximum(tokens, 1))
        emission = np.zeros(len(lex.unit))
        emission[:known] = np.log10(lex.counts - discount) - in_class[numbers_class[:known]]
        emission[settings.looked_up : -1] = -in_class[numbers_class[settings.looked_up : -1]]
        unseen = np.where(words > 0, np.log10(np.maximum(discount * words, 1e-300)), in_class)
    train_tokens = int(tokens.sum())
    distinct = int(words.sum()) + (1 if ends else 0)
    return Model(lex, train_tokens, int(ends), distinct, discount, unit_class, np.log10(transition), emission, unseen)


def _score_known(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            if batch.num_rows:
                found = [model.document(np.frombuffer(v.as_buffer(), "<i4")) for v in batch.column("numbers")]
                score, base, known = zip(*found, strict=True)
                columns = [batch.column("row"), pa.array(score, pa.float64()), pa.array(base, pa.float64()), pa.array(known, pa.int64())]
                yield pa.record_batch(columns, ["row", "score", "base", "known"])

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row.

    The model learns from rows for which ``held_out`` is false.  A text's tokens are its words and one
    end; ``base_score`` is the sum of log10((c + 1) / (N + V + 1)).  Null and empty texts are one end.
    Repeated rows count and are scored as often as they come; null ids stay null; an empty table gives no
    rows; without training rows nothing is known and scores rest on shares of classes alone; further
    columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    counts = materialize(word_counts(rows.where(~F.col("held_out")), settings.flush), "words")
    shared_lexicon = spark.sparkContext.broadcast(lexicon(counts, settings))
    encoded = rows.select("doc_id", "held_out", "text").mapInArrow(_encode(shared_lexicon), _ENCODED)
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = fit(encoded, counts, shared_lexicon, settings)
    shared = spark.sparkContext.broadcast(model)
    known = encoded.select("row", "numbers").mapInArrow(_score_known(shared), "row long, score double, base double, known long")

    # Rarer words: their counts are joined, a row for each word of a document.
    pairs = F.explode(F.arrays_zip("rare", "rare_n"))
    rare = encoded.select("row", pairs.alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").cast("long").alias("n"))
    ending = F.crc32(F.encode(F.right(F.decode("word", "UTF-8"), F.lit(3)), "UTF-8")) % F.lit(settings.buckets)
    first = settings.looked_up
    unseen_of = F.lit([float(model.unseen[model.unit_class[model.lexicon.unit[first + b]]]) for b in range(settings.buckets)])
    seen = F.col("c").isNotNull()
    own = F.when(seen, F.log10(F.col("c") - F.lit(model.discount))).otherwise(F.element_at(unseen_of, ending.cast("int") + 1))
    joined = rare.join(counts, "word", "left")
    rare_sums = joined.groupBy("row").agg(
        F.sum(F.col("n") * own).alias("rare_score"),
        F.sum(F.when(seen, F.col("n") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("rare_base"),
        F.sum(F.when(seen, F.col("n")).otherwise(F.lit(0).cast("long"))).alias("rare_known"),
    )
    end_count = model.ends
    total = math.log10(model.train_tokens + model.distinct + 1)
    sums = encoded.select("row", "doc_id", "held_out", "n_tokens").join(known, "row").join(rare_sums, "row", "left")
    whole = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(math.log10(end_count + 1)) - F.col("n_tokens") * F.lit(total)
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(end_count > 0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        whole.alias("score"),
        F.pow(F.lit(10.0), -whole / F.col("n_tokens")).alias("perplexity"),
    )
