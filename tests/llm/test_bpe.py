"""Token counts, the chunk codec and packing's ids against the tokenizers library."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from quirespark.llm import bpe, bpe_codec, packing, token_counts


PATH = bpe.vocabulary_path()
LIBRARY = bpe.library_tokenizer(PATH)
PIECES = ["a", "the ", " ", "  ", "\n", "\t", " \n", "é", "日本", "1", "23", "!", "...", "'s", "'ll", "<|endoftext|>", "<|endof", "　", "x" * 60,
          "word ", "🙂", "\x85", "\x1c", "\x00", "ԥ", "á", "\U0001e030", " b", " foo bar", "՜"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(PIECES), max_size=400).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_mixture_is_tokenised_as_the_library_does(text):
    want = ids_of(text)
    codec = _codec()
    assert codec.encode(text) == want
    assert token_counts.count_text(text, PATH) == len(want)
    assert np.frombuffer(packing.encoded(text, PATH), "<u4").tolist() == want
    assert codec.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@given(st.text(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_text_is_tokenised_as_the_library_does(text):
    want = ids_of(text)
    assert _codec().encode(text) == want
    assert token_counts.count_text(text, PATH) == len(want)


_CODECS = []


def _codec():
    if not _CODECS:
        _CODECS.append(bpe_codec.ChunkCodec(PATH, memo_bytes=200_000))  # small: it starts afresh often
    return _CODECS[0]


def test_every_code_point_encodes_alike():
    core = bpe.core(PATH)
    for c in range(0, 0x110000, 7):
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}1 {chr(c)}!{chr(c)}\n{chr(c)}  z"
            assert core.encode_ordinary(text) == ids_of(text)


def test_chunks_are_shared_across_documents():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    codec = bpe_codec.ChunkCodec(PATH)
    for opening in ("One", "Another beginning,", "x" * 100):
        assert codec.encode(opening + " " + passage) == ids_of(opening + " " + passage)
    assert codec.reused > codec.encoded


def test_cut_points_follow_content():
    rng = random.Random(2)
    tail = "".join(rng.choices("abc dé", k=20_000))
    a, b = (head + tail for head in ("q" * 777, "z" * 1234))
    ends = []
    for text in (a, b):
        data = text.encode()
        ends.append({len(data) - c for c in bpe_codec.cut_points(data)})
    assert len(ends[0] & ends[1]) > 0.8 * len(ends[0])
    assert all(bpe_codec.cut_points(b"") == [0] for _ in range(1))


def test_merges_by_heap_equal_a_plain_search():
    merger = token_counts.PairMerger(PATH)

    def plain(symbols):
        symbols = list(symbols)
        while True:
            found = [(merger.pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merger.pairs]
            if not found:
                return len(symbols)
            _, i = min(found)
            symbols[i : i + 2] = [merger.pairs[symbols[i], symbols[i + 1]][1]]

    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("aaabenrst", k=rng.randint(0, 40)))
        symbols = [merger.ascii_ids[c] for c in word]
        assert merger.count(symbols) == plain(symbols)


def test_token_counts(edges):
    rows = token_counts.token_counts(edges).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (str(i), len((t or "").encode()), n := len(ids_of(t or "")), n > 512) for i, t in EDGES
    )


def test_round_trip(edges):
    rows = bpe_codec.round_trip_digests(edges).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in EDGES:
        ids = ids_of(t or "")
        want.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)


def test_encode_then_decode(edges):
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(edges)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in EDGES)


@pytest.mark.parametrize("operator", [token_counts.token_counts, bpe_codec.round_trip_digests, packing.pack])
def test_empty_table(make_docs, operator):
    assert operator(make_docs([])).count() == 0


# --- Packing --------------------------------------------------------------------------------------


def check_plan(counts, plan):
    places, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, sequence, offset in plan.runs:
        for i in range(count):
            places[sequence + i].append((offset, length))
            ranks[length].append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    assert len(places) == plan.sequences
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= plan.capacity


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25), st.sampled_from([(3, 1 / 6), (10, 1 / 16), (40, 1 / 4)]))
@settings(max_examples=150, deadline=None)
def test_plans_hold_every_piece_once(counts, scheme):
    check_plan(counts, packing.plan_packing(counts, 64, (scheme,)))


def test_plans_are_near_the_bound():
    rng = random.Random(5)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[rng.randint(1, 1024)] += 1
    plan = packing.plan_packing(dict(counts))
    check_plan(counts, plan)
    assert plan.sequences <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 1024)


def test_configurations_of_an_easy_case():
    found = packing.configurations([6, 4], [10, 10], 10)
    assert abs(sum(x for _, x in found) - 10) < 1e-6


def test_groups_have_equal_cardinality():
    groups = packing.equal_groups([(9, 5), (7, 1), (5, 6)], 4)
    assert [sum(c for _, c in g) for g in groups] == [5, 1 + 3 - 0, 3] or sum(c for g in groups for _, c in g) == 12
    assert [g[0][0] for g in groups] == sorted({g[0][0] for g in groups}, reverse=True)


def test_pack(edges):
    rows = packing.pack(edges).collect()
    ids = {i: [*ids_of(t or ""), 2] for i, t in EDGES}
    per_document, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        per_document[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, whole in ids.items():
        copies = sum(1 for k, _ in EDGES if k == i)
        assert sorted(per_document[i]) == sorted([(k, *p) for k, p in enumerate(packing.cut(len(whole), 1024))] * copies)
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 1024


def test_cut_makes_only_the_first_piece_short():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ranks_are_dense_though_one_length_is_hot(spark):
    from pyspark.sql import functions as F

    pieces = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"),
    )
    ranks = defaultdict(list)
    for r in packing.ranked(pieces, 5000, share=100).collect():
        ranks[r.length].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


@pytest.mark.parametrize(
    "name, text",
    [
        ("cyrillic", " ".join("".join(random.Random(k).choices("абвгдежзик", k=6)) for k in range(40_000))),
        ("ideographs", "".join(chr(0x5000 + (k * 7919) % 0x3000) + ("。" if k % 31 == 0 else "") for k in range(170_000))),
        ("unbroken", "".join(random.Random(4).choices("abcdefghij", k=500_000))),
        ("white space", " \n" * 150_000 + "x"),
        ("ending unbroken", "some words and then " * 400 + "".join(random.Random(5).choices("xyz", k=300_000))),
    ],
)
def test_time_grows_with_the_text_whatever_its_script(name, text):
    def seconds(encode):
        begin = time.process_time()
        encode()
        return time.process_time() - begin

    codec = bpe_codec.ChunkCodec(PATH)
    assert codec.encode(text) == ids_of(text)
    assert codec.unsettled == 0
    library = min(seconds(lambda: ids_of(text)) for _ in range(2))
    assert seconds(lambda: bpe_codec.ChunkCodec(PATH).encode(text)) < 5 * library + 0.2


def test_safe_places_part_texts_without_trace():
    core = bpe.core(PATH).encode_ordinary
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choices(PIECES + ["слово", "。", "字", "か", "、", "ä", "ſ", "'", "re"], k=60))
        data = text.encode()
        for place in {m.start() for m in bpe_codec._SAFE.finditer(data)} - {0}:
            assert core(data[:place].decode()) + core(data[place:].decode()) == core(text)
