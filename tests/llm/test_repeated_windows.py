"""Removal of repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from quirespark.llm import repeated_windows

LATE = float("inf")  # a row without an id counts as larger than all others


def brute(rows, window=13):
    lists = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in lists:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            least[key] = min(least.get(key, LATE), LATE if i is None else i)
    out = []
    for i, words in lists:
        gone = set()
        for s in range(len(words) - window + 1):
            if least[tuple(words[s : s + window])] < (LATE if i is None else i):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shown(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def copied(rng, n, words=12, length=60):
    """Documents that share passages of each other, in few different words."""
    texts = []
    for _ in range(n):
        text = [rng.choice("abcdefgh"[:words]) + str(rng.randrange(40)) for _ in range(rng.randrange(length))]
        for _ in range(rng.randrange(3)):
            if texts:
                other = rng.choice(texts)
                a = rng.randrange(len(other) + 1)
                at = rng.randrange(len(text) + 1)
                text[at:at] = other[a : a + rng.randrange(10, 30)]
        texts.append(text)
    return [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("unit_words", [7, 40, 1_000_000])
def test_against_brute_force(spark, make_docs, unit_words):
    rows = copied(random.Random(unit_words), 120)
    random.Random(2).shuffle(rows)
    rows += [rows[5], (rows[7][0], rows[9][1]), (None, rows[3][1]), (None, rows[3][1]), *EDGES]
    docs = make_docs(rows).repartition(5)
    assert shown(repeated_windows.removal_digests(docs, unit_words=unit_words)) == brute(rows)


def test_few_words_many_windows(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(60)]
    assert shown(repeated_windows.removal_digests(make_docs(rows), window=5, unit_words=100)) == brute(rows, 5)


def test_a_passage_that_a_third_of_all_documents_hold(spark, make_docs):
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(i, f"{i} {passage} {i + 1}" if i % 3 == 1 else f"own {i} words") for i in range(900)]
    found = {r.doc_id: r for r in repeated_windows.removal_digests(make_docs(rows).repartition(6)).collect()}
    assert found[1].n_removed == 0 and found[4].n_removed == 70 and found[4].n_words == 72
    assert found[4].kept_sha256 == hashlib.sha256(b"4 5").hexdigest()
    assert sum(r.n_removed for r in found.values()) == 70 * 299


def test_texts_of_megabytes(spark, make_docs):
    long = " ".join(f"w{k % 7919}x{k // 7919}" for k in range(700_000))
    rows = [(3, long), (2, " ".join(long.split()[300_000:300_040])), (9, "same " * 500_000), (10, " " * 3_000_000), (11, "y" * 2_000_000)]
    found = {r.doc_id: r for r in repeated_windows.removal_digests(make_docs(rows), unit_words=50_000).collect()}
    assert (found[3].n_words, found[3].n_removed) == (700_000, 40)
    assert (found[9].n_words, found[9].n_removed) == (500_000, 0)
    assert (found[10].n_words, found[11].n_words) == (0, 1)


def test_empty_table_and_names(spark, make_docs):
    assert repeated_windows.removal_digests(make_docs([])).collect() == []
    assert repeated_windows.removal_digests(make_docs([(1, None)])).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_texts_that_stay(spark, make_docs):
    words = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(words)), (2, "before " + "\n".join(words[5:25]) + " after"), (3, None)]
    assert {r.doc_id: r.text for r in repeated_windows.remove_repeats(make_docs(rows)).collect()} == {1: " ".join(words), 2: "before after", 3: ""}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 14))
def test_window_hashes_are_sums_of_powers(values, window):
    words = np.array(values, np.uint64)
    found = repeated_windows.window_hashes(words, window, 0x9E3779B97F4A7C15)
    inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    assert found.tolist() == [sum(values[i + j] * pow(inverse, j, 1 << 64) for j in range(window)) % (1 << 64) for i in range(len(values) - window + 1)]
