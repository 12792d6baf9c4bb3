"""Language identification and toxicity on small made-up languages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import EDGES
from quirespark.llm import language_id, toxicity
from quirespark.llm.common import id_remainder

SYLLABLES = {"xa": ["ka", "lo", "mi", "tu", "ren"], "yo": ["schi", "bren", "gul", "ost", "per"], "zu": ["ña", "qué", "sol", "íra", "vez"]}
INSULTS = ["grumphead", "zatwit", "snorkfool"]


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(make_docs):
    rng = random.Random(4)
    rows, langs, toxic = [], {}, {}
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        text = words(rng, lang, rng.randint(5, 60))
        toxic[i] = int(rng.random() < 0.2)
        if toxic[i]:
            parts = text.split()
            parts.insert(rng.randrange(len(parts)), rng.choice(INSULTS))
            text = " ".join(parts)
        rows.append((i, text))
        langs[i] = lang
    return make_docs(rows, langs), langs, toxic


def test_languages_are_told_apart(corpus):
    docs, langs, _ = corpus
    held_out = id_remainder("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    rows = [r for r in language_id.identify(docs, model, held_out=held_out).collect() if r.held_out]
    assert len(rows) > 100
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_texts_without_letters_are_unknown(corpus, edges, make_docs):
    docs, _, _ = corpus
    model = language_id.fit(docs)
    rows = language_id.identify(edges, model).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        text = dict(EDGES).get(r.doc_id) or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert r.lang_pred != "und" or r.score == 0
    assert language_id.identify(make_docs([]), model).count() == 0
    assert language_id.fit(make_docs([])).languages == ["und"]


def test_rejection_keeps_known_languages(corpus, make_docs):
    docs, _, _ = corpus
    model = language_id.fit(docs)
    kept = language_id.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    strange = make_docs([(1, "1234 5678"), (2, None), (3, "... ?! \n"), (4, "")])
    assert language_id.accepted(strange, model).count() == 0


def test_unlearned_languages_and_gibberish_are_rejected(corpus, make_docs):
    """Whatever the number of languages; texts in several learned ones stay."""
    docs, langs, _ = corpus
    rng = random.Random(9)
    for learned in (["xa", "yo"], ["xa"], list(SYLLABLES)):
        model = language_id.fit(docs.where(F.col("lang").isin(learned)))
        foreign = [(i, words(rng, lang, 40)) for i, lang in enumerate(x for x in SYLLABLES if x not in learned)]
        noise = [(100 + i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(12))) for i in range(20)]
        assert language_id.accepted(make_docs(foreign + noise), model).count() == 0
        mixed = [(i, " ".join(words(rng, lang, 20) for lang in learned)) for i in range(20)]
        assert language_id.accepted(make_docs(mixed), model).count() == 20


def test_copies_and_slices_are_set_aside_together(corpus, make_docs, monkeypatch):
    rng = random.Random(10)
    rows = [(i, words(rng, "xa", 40)) for i in range(60)]
    given = {}
    monkeypatch.setattr(language_id, "train", lambda examples, languages, *rest: given.update(n=len(examples), aside=rest) or language_id.Model(languages, None, None))
    language_id.fit(make_docs([*rows, *((1000 + i, t) for i, t in rows)], {i: "xa" for k in (0, 1000) for i in range(k, k + 60)}))
    aside = given["aside"][0]
    assert given["n"] == len(aside) == 360 and 0 < sum(aside) < 360
    assert all(len(set(aside[i : i + 3])) == 1 for i in range(0, 360, 3)) and aside[:180] == aside[180:]


def test_subwords_of_parts():
    ids, counts = language_id.subwords(["ab", "a1b", "12", "é"])
    assert counts.tolist() == [6, 6, 0, 3]
    again, _ = language_id.subwords(["ab"])
    assert again.tolist() == ids[:6].tolist()


def plain_subwords(text):
    """Runs of 2 to 4 characters of the letter runs, ends marked, by their definition."""
    runs, run = [], []
    for c in text.lower() + " ":
        if c.isalpha():
            run.append(c)
        elif run:
            runs.append(["^", *run, "$"])
            run = []
    return [tuple(r[i : i + n]) for r in runs for n in (2, 3, 4) for i in range(len(r) - n + 1)]


def test_scores_equal_a_plain_recomputation(corpus, edges, make_docs, monkeypatch):
    """With a memo and slices so small that they are used up again and again."""
    docs, _, _ = corpus
    model = language_id.fit(docs)
    monkeypatch.setattr(language_id, "_MEMO", 50)
    monkeypatch.setattr(language_id, "_SLICE", 20)
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(["", None, "12 34", "Kalo-MIREN schi,bren", "ña'qué 7sol7", *(words(rng, x, 300) for x in SYLLABLES)])]
    got = {r.doc_id: r for r in language_id.identify(make_docs(rows), model).collect()}
    kept = {r.doc_id for r in language_id.accepted(make_docs(rows), model).collect()}
    for i, text in rows:
        grams = plain_subwords(text or "")
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0) and i not in kept
            continue
        fine = np.concatenate([language_id.fine_subwords([t])[0] for t in text.lower().split()])
        assert len(fine) == len(grams)
        logits = (model.table[fine % language_id.BUCKETS].astype(float).mean(axis=0) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[i].lang_pred == model.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4
        limit = model.limits[int(p.argmax())]
        slack = language_id.DEVIATIONS * (limit * (1 - limit) * language_id.A_WORD / len(fine)) ** 0.5
        logit = (model.table[fine % language_id.BUCKETS].astype(float).mean(axis=0) + model.bias).max()
        plain = model.unseen(fine).mean() <= language_id.STRANGEST and logit >= language_id.PLAIN - language_id.VARIES / len(fine) ** 0.5
        assert (i in kept) == (model.unseen(fine).mean() <= limit + slack or plain)


# --- Toxicity -------------------------------------------------------------------------------------


def brute_kernel(a, b):
    """Common subsequences of length 3 and 4 with span up to 6, ends marked."""
    from itertools import combinations

    def weights(s):
        s = f"^{s}$"
        out = {}
        for n in toxicity.LENGTHS:
            for at in combinations(range(len(s)), n):
                if at[-1] - at[0] < toxicity.SPAN:
                    key = "".join(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out, len(s)

    (x, n), (y, m) = weights(a), weights(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) * toxicity.scale(np.array([n]))[0] * toxicity.scale(np.array([m]))[0]


def test_kernel_counts_gapped_subsequences():
    rng = random.Random(5)
    for _ in range(40):
        a, b = ("".join(rng.choices("abcz", k=rng.randint(0, 9))) for _ in range(2))
        assert abs(toxicity.kernel(a, b) - brute_kernel(a, b)) < 1e-9
    assert toxicity.kernel("idiot", "idiot") > toxicity.kernel("idxiot", "idiot") > toxicity.kernel("table", "idiot")


def test_multiplied_out_weights_give_the_machine():
    """Scores by table equal scores by Nyström features."""
    rng = random.Random(6)
    strings = sorted({"".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(60)})
    space = toxicity._Nystrom(strings[:20])
    w = np.random.default_rng(1).normal(size=space.root.shape[1])
    model = toxicity.Model(space.multiplied_out(w), 0.3)
    assert np.allclose(model.margins(strings), space.transform(strings) @ w + 0.3, atol=1e-4)


def test_nystrom_reproduces_the_kernel_of_landmarks():
    landmarks = ["idiot", "moron", "table", "house", "scum"]
    x = toxicity._Nystrom(landmarks).transform(landmarks)
    want = np.array([[toxicity.kernel(a, b) for b in landmarks] for a in landmarks])
    assert np.allclose(x @ x.T, want, atol=1e-8)


@pytest.mark.parametrize(("token", "string"), [("I.D.I.O.T!", "idiot"), ("id1ot", "idiot"), ("Ünï", "uni"), ("123", ""), ("Straße", "strasse")])
def test_parts(token, string):
    assert toxicity.part(token) == string


def test_spelt_out_words_are_one_part():
    assert toxicity.spelt_out("you i d i o t, go") == ["idiot"]
    assert toxicity.spelt_out("a b") == []


def test_insults_are_found(spark, corpus, edges, make_docs):
    docs, _, toxic = corpus
    labels = spark.createDataFrame([*toxic.items(), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    held_out = id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held_out), labels)
    rows = [r for r in toxicity.score(docs, model, held_out=held_out).collect() if r.held_out]
    right = np.mean([r.predicted == toxic[r.doc_id] for r in rows])
    assert right > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    altered = [(1, "kalo miren g.r.u.m.p.h.e.a.d tu"), (2, "kalo z a t w i t mi"), (3, "lo grumpxhead ka"), (4, "kalo miren lotu")]
    found = {r.doc_id: r.predicted for r in toxicity.score(make_docs(altered), model).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 0}
    assert toxicity.score(edges, model).count() == len(EDGES)
    assert toxicity.score(make_docs([]), model).count() == 0
    kept = toxicity.harmless(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(i in ids for i, y in toxic.items() if not y) > 0.97 * sum(1 - y for y in toxic.values())


def test_scores_of_texts_equal_a_plain_recomputation(spark, corpus, make_docs, monkeypatch):
    """A text's margin is that of its worst part; with a memo and slices that are used up again and again."""
    docs, _, toxic = corpus
    model = toxicity.fit(docs, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    monkeypatch.setattr(toxicity, "_MEMO", 40)
    monkeypatch.setattr(toxicity, "_SLICE", 15)
    rng = random.Random(13)
    texts = ["", None, "a", "1 2 3", "a b c", "z a t w i t", "kalo,zatwit/miren", "http://x.y/snorkfool?lo=1", "g r u m p h e a d tu " + words(rng, "yo", 90)]
    texts += [words(rng, x, 200) + " " + " ".join(rng.choices("abc", k=5)) for x in SYLLABLES]
    got = {r.doc_id: r for r in toxicity.score(make_docs(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        strings = ["", *toxicity.spelt_out(text or "")]
        for token in (text or "").split():
            inner = [p for p in re.split(r"[^\w@$]+|_+", token) if p]
            strings += [p for p in map(toxicity.part, [token, *(inner if len(inner) > 1 else [])]) if len(p) > 1]
        z = max(float(model.margins([p])[0]) for p in strings)
        want = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
        assert abs(got[i].score - want) < 1e-4 and got[i].predicted == int(got[i].score >= 0.3)
    assert got[5].predicted == got[6].predicted == got[7].predicted == 1


def test_contradictory_labels_and_scales(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, settings: seen.append(rows))
    docs = make_docs([(1, "one"), (2, "two"), (3, None), (4, "four"), (4, "four too"), (None, "none")])
    labels = [(1, 0), (1, 1), (2, None), (2, 0), (3, 1), (4, 0), (9, 1), (None, 1)]
    for order in (labels, labels[::-1]):
        toxicity.fit(docs, spark.createDataFrame(order, "doc_id long, toxic int"))
    assert [sorted(rows) for rows in seen] == [[(0, ["four"]), (0, ["four", "too"]), (0, ["two"]), (1, ["one"])]] * 2
    sizes = np.array([0, 1, 3, 9, 100, 5000, 10_000])
    plain = [sum(max(n - p[-1], 0) * toxicity.DECAY ** (2 * (p[-1] + 1)) for k in toxicity.LENGTHS for p in toxicity._PATTERNS[k]) for n in sizes]
    assert np.allclose(toxicity.scale(sizes), 1 / np.sqrt(np.maximum(plain, 1e-12)))


def test_without_both_labels_nothing_is_toxic(spark, edges):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    assert {r.predicted for r in toxicity.score(edges, model).collect()} == {0}


def test_id_remainder(spark):
    import zlib

    rows = spark.range(50).select("id", id_remainder("id", 4).alias("r"), id_remainder(F.lit(None), 4).alias("n")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 and r.n == 0 for r in rows)
    assert re.fullmatch(r"\d", str(rows[0].r))
