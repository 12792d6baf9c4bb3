import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import EDGES
from quirespark.llm import class_lm as lm
from quirespark.llm.common import id_remainder, materialize

SMALL = lm.Settings(classes=4, clustered=16, looked_up=60, buckets=8, sweeps=4, flush=50)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(80)], [f"v{i}" for i in range(80)]
    made = []
    for i in range(120):
        pairs = [(rng.choices(nouns, weights=range(80, 0, -1))[0], rng.choices(verbs, weights=range(80, 0, -1))[0]) for _ in range(rng.randint(0, 30))]
        made.append((i, " ".join(f"{a} {b.upper()}" for a, b in pairs)))
    return made


def held(i):
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute_base(rows):
    words = {k: lm.words_of(t or "") for k, (_, t) in enumerate(rows)}
    counts, ends = Counter(), 0
    for k, (i, _) in enumerate(rows):
        if not held(i):
            counts.update(words[k])
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (1 if ends else 0)
    out = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[k]) + math.log10((ends + 1) / (n + v + 1))
        out.append((str(i), held(i), len(words[k]) + 1, sum(counts[w] > 0 for w in words[k]) + int(ends > 0), n, round(base, 6)))
    return sorted(out)


@pytest.mark.parametrize("settings", [SMALL, lm.Settings()])
def test_base_scores_and_counts(make_docs, rows, settings):
    got = lm.score(make_docs(rows), id_remainder("doc_id", 7) == 2, settings=settings).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_edges(edges, make_docs):
    got = lm.score(edges, id_remainder("doc_id", 7) == 2, settings=SMALL).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(EDGES)
    assert lm.score(make_docs([]), F.lit(False), settings=SMALL).count() == 0
    nothing_known = lm.score(make_docs([(1, "a b"), (2, None)]), F.lit(True), settings=SMALL).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in nothing_known)


def test_scores_are_the_models_probabilities(spark, make_docs, rows):
    """A document's score, recomputed word by word from the model's tables; and the probabilities of all
    next words, the unseen of each class included, sum to one."""
    docs = make_docs(rows).select("doc_id", "text", (id_remainder("doc_id", 7) == 2).alias("held_out"))
    counts = materialize(lm.word_counts(docs.where("not held_out"), SMALL.flush), "words")
    shared = spark.sparkContext.broadcast(lm.lexicon(counts, SMALL))
    encoded = materialize(docs.mapInArrow(lm._encode(shared), lm._ENCODED), "encoded")
    model = lm.fit(encoded, counts, shared, SMALL)
    known = {bytes(r.word): r.c for r in counts.collect()}
    lex, k = model.lexicon, SMALL.classes

    def class_of(word):
        number = lex.index.get(word, SMALL.looked_up + lm.bucket_of(word, SMALL.buckets))
        return model.unit_class[lex.unit[number]]

    tokens, words = np.zeros(k + 1), np.zeros(k + 1)
    for w, c in known.items():
        tokens[class_of(w)] += c
        words[class_of(w)] += 1
    tokens[k] = model.ends
    for before in range(k + 1):
        steps = 10 ** model.transition[before]
        assert abs(steps.sum() - 1) < 1e-9
        inside = np.zeros(k + 1)
        for w, c in known.items():
            inside[class_of(w)] += (c - model.discount) / tokens[class_of(w)]
        for c in range(k):
            inside[c] += model.discount * words[c] / tokens[c] if words[c] else 1.0
        inside[k] = 1.0
        assert abs((steps * inside).sum() - 1) < 1e-9

    scored = {r.doc_id: r.score for r in lm.score(make_docs(rows), id_remainder("doc_id", 7) == 2, settings=SMALL).collect()}
    for i, text in rows:
        before, total = k, 0.0
        for w in lm.words_of(text):
            c = class_of(w)
            part = (known[w] - model.discount) / tokens[c] if w in known else model.discount * words[c] / tokens[c] if words[c] else 1.0
            total += model.transition[before, c] + math.log10(part)
            before = c
        total += model.transition[before, k]
        assert abs(scored[i] - total) < 1e-6


def test_all_looked_up_words_have_classes_of_their_own(spark, make_docs):
    """Rarer nouns and verbs with the same last letters go to the classes of nouns and verbs; the lexicon is full."""
    rng = random.Random(12)
    frequent = {"n": [f"n{i}" for i in range(10)], "v": [f"v{i}" for i in range(10)]}
    rarer = {x: [f"{x}{i}end" for i in range(20)] for x in "nv"}
    made = []
    for i in range(400):
        pairs = [(rng.choice(frequent["n"]), rng.choice(frequent["v"])) for _ in range(10)]
        pairs += [(rng.choice(rarer["n"]), rng.choice(frequent["v"])), (rng.choice(frequent["n"]), rng.choice(rarer["v"]))]
        made.append((i, " ".join(f"{a} {b}" for a, b in pairs)))
    made += [(1000 + i, f"once{i}") for i in range(50)]
    settings = lm.Settings(classes=2, clustered=20, looked_up=80, buckets=4)
    docs = make_docs(made).select("doc_id", "text", F.lit(False).alias("held_out"))
    counts = materialize(lm.word_counts(docs, settings.flush), "words")
    lex = lm.lexicon(counts, settings)
    assert 75 <= len(lex.index) <= 80  # 60 words occur often, 50 once
    shared = spark.sparkContext.broadcast(lex)
    model = lm.fit(materialize(docs.mapInArrow(lm._encode(shared), lm._ENCODED), "encoded"), counts, shared, settings)
    of = {x: {model.unit_class[lex.unit[lex.index[w.encode()]]] for w in frequent[x] + rarer[x]} for x in "nv"}
    assert len(of["n"]) == len(of["v"]) == 1 and of["n"] != of["v"]


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(2)
    n = 20
    bigrams = np.zeros((n, n))
    order = rng.permutation(n)
    left, right = order[:10], order[10:]
    for _ in range(4000):
        a, b = rng.choice(left), rng.choice(right)
        bigrams[a, b] += 1
        bigrams[b, rng.choice(left)] += 1
    member = lm.exchange(bigrams, 2, 20)
    assert len({member[i] for i in left}) == 1 and len({member[i] for i in right}) == 1 and member[left[0]] != member[right[0]]


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.integers(0, 9, (8, 8)).astype(float)
    member = np.array([0, 1, 2, 0, 1, 2, 0, 1])

    def likelihood(m, skip=None):
        n = np.zeros((3, 3))
        for i in range(8):
            for j in range(8):
                if skip not in (i, j):
                    n[m[i], m[j]] += bigrams[i, j]
        return lm._h(n).sum() - lm._h(n.sum(axis=1)).sum() - lm._h(n.sum(axis=0)).sum(), n

    w = 3
    without, n = likelihood(member, skip=w)
    one_hot = np.eye(3)[member]
    right, left = bigrams[w] @ one_hot, bigrams[:, w] @ one_hot
    right[member[w]] -= bigrams[w, w]
    left[member[w]] -= bigrams[w, w]
    gains = lm._gains(n, right, left, bigrams[w, w])
    for d in range(3):
        m = member.copy()
        m[w] = d
        # Margins that don't depend on the word's class are the same for all classes.
        whole = likelihood(m)[0]
        if d == 0:
            offset = whole - without - gains[0]
        assert abs(whole - without - gains[d] - offset) < 1e-6


def test_model_beats_the_base_on_structured_text(make_docs):
    rng = random.Random(8)
    nouns, verbs = [f"n{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    made = [(i, " ".join(w for _ in range(rng.randint(5, 30)) for w in (rng.choice(nouns), rng.choice(verbs)))) for i in range(400)]
    settings = lm.Settings(classes=4, clustered=120, looked_up=200, buckets=8)
    got = lm.score(make_docs(made), id_remainder("doc_id", 7) == 2, settings=settings).collect()
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.1 * sum(r.n_tokens for r in unseen)
