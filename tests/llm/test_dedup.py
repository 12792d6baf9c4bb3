"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from quirespark.llm import common, exact_dedup, graph, simhash_dedup


def sha_of(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha_of(t)].append(i)
    out = []
    for i, t in rows:
        mine = groups[sha_of(t)]
        known = [x for x in mine if x is not None]
        keep = min(known) if known else None
        out.append((str(i), str(keep), len(mine), i == keep, sha_of(t)))
    return sorted(out)


def shown(rows):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows)


def test_exact_dedup(spark, edges):
    assert shown(exact_dedup.DigestIndex(spark).ingest(edges).collect()) == brute_exact(EDGES)


def test_exact_dedup_of_a_hot_text(spark, make_docs):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    rng = random.Random(1)
    rng.shuffle(rows)
    assert shown(exact_dedup.DigestIndex(spark).ingest(make_docs(rows)).collect()) == brute_exact(rows)


def test_index_remembers_batches(spark, make_docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, "batches", f"file://{tmp_path}/index", buckets=3)
    index.ingest(make_docs([(5, "a"), (6, "b"), (7, "a")])).collect()
    again = exact_dedup.DigestIndex(spark, "batches", f"file://{tmp_path}/index", buckets=3)
    rows = {r.doc_id: r for r in again.ingest(make_docs([(1, "a"), (8, "c"), (9, "c ")])).collect()}
    assert (rows[1].keep_id, rows[1].kept, rows[1].group_size) == (5, False, 1)
    assert rows[8].kept and rows[9].keep_id == 9 and rows[9].kept  # "c" and "c " differ
    assert again.read().count() == 4
    spark.sql("DROP TABLE batches")  # the catalogue forgets it; its files stay
    third = exact_dedup.DigestIndex(spark, "batches", f"file://{tmp_path}/index", buckets=3)
    assert third.read().count() == 4
    rows = {r.doc_id: r.kept for r in third.ingest(make_docs([(5, "a"), (6, "b"), (7, "a")])).collect()}
    assert rows == {5: True, 6: True, 7: False} and third.read().count() == 4
    assert again.ingest(make_docs([])).count() == 0 and again.read().count() == 4


def test_index_is_bucketed_and_sorted(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert rows["Num Buckets"] == "4" and "digest" in rows["Bucket Columns"] and "digest" in rows["Sort Columns"]


def test_deduplicate_keeps_all_columns(make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


# --- Near duplicates ------------------------------------------------------------------------------


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbB éÉ\n\t\x0b\x85 ", max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


def brute_components(rows, prints):
    ids = list(range(len(rows)))
    parent = ids[:]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in ids:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i in ids:
        if rows[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), f"{prints[i]:016x}", str(least.get(find(i)))) for i in ids)


def test_near_duplicates(edges):
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_dedup.near_duplicates(edges).collect())
    assert got == brute_components(EDGES, [brute_fingerprint(t) for _, t in EDGES])


@pytest.mark.parametrize("limit", [4096, 40])
def test_links_keep_all_components_though_cells_are_crowded(spark, limit):
    """Balls around a few centres, chains, and chance prints; with a low limit cells are dealt into blocks."""
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    step = rng.getrandbits(64)
    for _ in range(60):
        step ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(step)
    prints |= {rng.getrandbits(64) for _ in range(500)}
    values = sorted(prints)
    signed = [int(x) for x in np.array(values, np.uint64).view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = graph.components(simhash_dedup.links(df, len(values), limit=limit)).collect()
    roots = {r.node: r.root for r in found}
    groups = defaultdict(set)
    for v, s in zip(values, signed, strict=True):
        groups[roots.get(s, s)].add(v)
    rows = [(i, None) for i in range(len(values))]
    want = defaultdict(set)
    for i, _, component in brute_components(rows, values):
        want[component].add(values[int(i)])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_cells_meet_for_every_link():
    """Any two prints that differ in 4 bits agree in some choice of groups, for each number of groups."""
    rng = random.Random(9)
    even = 0x5555555555555555
    packed = lambda x: (x & even) + ((x >> 1) & even)
    from itertools import combinations

    for groups in (7, 9, 12):
        masks = [sum(c) for c in combinations(simhash_dedup.group_masks(groups), groups - 4)]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 4))
            assert any(packed(a) & m == packed(b) & m for m in masks)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (4, 5), (5, 4), (6, 6), (10, 11)] + [(100, k) for k in range(101, 400)]
    rows = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r.node: r.root for r in rows}
    assert len(rows) == len(roots)
    assert {k: roots[k] for k in (1, 2, 3, 9, 4, 5, 10, 11)} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10}
    assert all(roots[k] == 100 for k in range(100, 400)) and 6 not in roots
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_join_counted_splits_hot_keys(spark):
    left = spark.createDataFrame([(k % 7 if k % 2 else 0, k) for k in range(2000)], "k long, x long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n")
    joined = graph.join_counted(left, right, "k", 2000)
    assert joined.count() == 2000


def test_near_dedup_keeps_one_of_each_group(make_docs):
    base = " ".join(f"w{i}" for i in range(400))
    docs = make_docs([(3, base), (4, base + " more"), (5, base), (6, "something else entirely here now")])
    assert sorted(r.doc_id for r in simhash_dedup.deduplicate(docs).collect()) == [3, 6]
    assert simhash_dedup.near_duplicates(make_docs([])).count() == 0


# --- Rows that stay, whatever the ids -------------------------------------------------------------

ODD_IDS = [(3, "a"), (5, "a"), (5, "b"), (None, "a"), (None, "z"), (None, "z"), (None, "y"), (7, "b"), (7, "c"), (7, "c"),
           (8, None), (9, ""), (None, " "), (None, None), (4, "a  b"), (2, "a\tb"), (2, "a")]


def exact_survivors(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha_of(t)].append(i)
    keep = {s: min((i for i in ids if i is not None), default=None) for s, ids in groups.items()}
    return sorted(((str(i), str(t)) for i, t in rows if i == keep[sha_of(t)]))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_verdicts_are_on_ids_and_texts(make_docs, monkeypatch, limit):
    monkeypatch.setattr(common, "DROP_LIST", limit)  # 0: no list is short
    kept = exact_dedup.deduplicate(make_docs(ODD_IDS))
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == exact_survivors(ODD_IDS)
    assert exact_dedup.deduplicate(make_docs([])).count() == 0


def test_near_verdicts_are_on_ids_and_texts(make_docs, monkeypatch):
    base = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(400))
    rows = [(3, base), (3, base + " more"), (None, base), (None, other), (None, other + " x"), (None, other), (3, "far from all"),
            (6, "far from all"), (1, None), (1, ""), (2, " "), (8, base)]
    prints = [simhash_dedup.fingerprint(t or "") for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and (prints[3] ^ prints[4]).bit_count() <= 4
    for limit in (32 << 20, 0):
        monkeypatch.setattr(common, "DROP_LIST", limit)
        kept = [(r.doc_id, r.text) for r in simhash_dedup.deduplicate(make_docs(rows)).collect()]
        assert len([k for k in kept if k in rows[:2]]) == 1  # one text of id 3
        assert len({t for i, t in kept if i is None}) == 1 and {t for i, t in kept if i is None} <= {other, other + " x"}
        assert (3, "far from all") in kept and {(1, None), (1, "")} <= set(kept)
        assert not {(6, "far from all"), (2, " "), (8, base), (None, base)} & set(kept)
    assert simhash_dedup.deduplicate(make_docs([])).count() == 0


def test_nothing_is_left_in_the_catalogue(spark, make_docs):
    before = {t.name for t in spark.catalog.listTables()}
    docs = make_docs([(1, "a"), (2, "a")])
    kept, = exact_dedup.deduplicate(docs).collect()
    assert kept.doc_id == 1 and {t.name for t in spark.catalog.listTables()} == before


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2000, 6), dtype=np.uint64), axis=1)
    counts = [[[(int(x) >> (2 * s) & 3).bit_count() for s in range(32)] for x in v] for v in (a, b)]
    manhattan = np.abs(np.array(counts[0]) - np.array(counts[1])).sum(axis=1)
    assert (np.bitwise_count(simhash_dedup.unary(a) ^ simhash_dedup.unary(b)) == manhattan).all()
    assert (simhash_dedup.near(a, b) == (np.bitwise_count(a ^ b) <= 4)).all()
