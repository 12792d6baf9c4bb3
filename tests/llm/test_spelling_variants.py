"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from quirespark.llm import spelling_variants


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    counts = {w: n for w, n in brute_counts(rows).items() if n >= 5}
    words = sorted(counts)
    forms, out = {}, []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            forms[w] = best
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.append((w, form, root, counts[w], len(near[w]), counts.get(form)))
    return out


def shown(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=lambda r: r[0])


def varied(rng, n):
    """Documents of few words, whose frequencies fall steeply, with slips."""
    stems = ["".join(rng.choice("abcéÀ") for _ in range(rng.randrange(5, 10))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(40)):
            word = stems[min(int(rng.expovariate(0.3)), 24)]
            while rng.random() < 0.35:
                at = rng.randrange(len(word) + 1)
                word = word[:at] + rng.choice(["a", "b", "é", "Z", "ÿ", ""]) + word[at + rng.randrange(2) :]
            text.append(word)
        rows.append((i, rng.choice([" ", ", ", "1", "_", "Ā"]).join(text)))
    return rows


def test_against_brute_force(spark, make_docs):
    chain = " ".join(w for k, n in enumerate((5, 30, 180, 1000)) for w in ["lettera" + "b" * k] * n)
    rows = [*varied(random.Random(1), 400), *EDGES, (77, chain)]
    found = shown(spelling_variants.variants(make_docs(rows).repartition(5)))
    assert found == brute(rows)
    assert any(r[1] and r[2] != r[1] for r in found)  # chains of more than one form


def test_slips_are_made(spark, make_docs):
    rows = [(i, "Wonderful WONDERFUL wonderfully") for i in range(1500)]
    assert {r.word: r.n for r in spelling_variants.word_counts(make_docs(rows)).collect()} == brute_counts(rows)
    assert shown(spelling_variants.variants(make_docs(rows))) == brute(rows)


def test_a_word_with_more_neighbours_than_others(spark, make_docs):
    rng = random.Random(3)
    words = ["abcdefgh"] * 400
    for _ in range(300):
        at = rng.randrange(8)
        words += ["abcdefgh"[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + "abcdefgh"[at + 1 :]] * 5
    rows = [(i, " ".join(words[i::50])) for i in range(50)]
    assert shown(spelling_variants.variants(make_docs(rows))) == brute(rows)


def test_very_long_words(spark, make_docs):
    long = "".join(random.Random(2).choice("abc") for _ in range(100_000))
    rows = [(i, long) for i in range(5)] + [(10 + i, long[:-1] + " " + long[:50_000] + "d" + long[50_000:]) for i in range(40)]
    found = {len(r[0]): r for r in shown(spelling_variants.variants(make_docs(rows)))}
    assert (found[100_000][3:5], found[99_999][3:5]) == ((5, 2), (40, 1))
    assert found[100_000][1] == min(long[:-1], long[:50_000] + "d" + long[50_000:])
    assert brute_counts(rows)[long] == 5


def test_empty_table_and_names(spark, make_docs):
    assert spelling_variants.variants(make_docs([])).collect() == []
    assert spelling_variants.variants(make_docs([(1, None), (2, "rare words only")])).collect() == []
    assert spelling_variants.variants(make_docs([])).columns == ["word", "form", "root", "n", "n_near", "form_n"]


@settings(max_examples=80, deadline=None)
@given(st.text("abcé", min_size=1, max_size=12))
def test_neighbours_are_distinct_and_whole(word):
    keys = spelling_variants.Keys("abcéÿ")
    everything = np.full(8192, 255, np.uint8)
    found = [pair for _, a, b in keys.neighbours(keys.codes([word], len(word)), everything, 16) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    edits = {word[:k] + word[k + 1 :] for k in range(len(word))}
    edits |= {word[:k] + c + word[k + j :] for k in range(len(word) + 1) for c in "abcéÿ" for j in (0, 1) if k + j <= len(word)} - {word}
    wanted = {tuple(int(keys.sums(keys.codes([e], len(e)), w)[0][0, -1]) if e else 0 for w in (0, 1)) for e in edits}
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("size", [10, 3_000_000])
def test_parts_hold_all_words(size):
    text = "abcdefg, " * (size // 9) + "x" * 30
    assert sum(n for _, n in spelling_variants.words_of(1, text)) == sum(brute_counts([(1, text)]).values())
