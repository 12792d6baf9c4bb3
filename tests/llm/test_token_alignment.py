"""Alignment of two tokenizers against both libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from edge_cases import EDGES
from quirespark.llm import bpe, token_alignment

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A_PATH)
    first.no_truncation()
    first.no_padding()
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = {c: b for c, b in bpe._byte_alphabet().items()}

    def tokens(text):
        a = first.encode(f" {text}", add_special_tokens=False).ids
        b = second.encode(text)
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) if i != 50256 else None for i in a]
        b_bytes = []
        for i in b:
            piece = second.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode())
        whole = f" {text}".encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], []
        return list(zip(a, map(len, a_bytes), strict=True)), list(zip(b, map(len, b_bytes), strict=True))

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, n in tokens:
        out.append((at, at + n, i))
        at += n
    return out


def brute(rows, tokens):
    found, counts = [], Counter()
    for doc_id, text in rows:
        a, b = map(ranges, tokens(text or ""))
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] if len(a) < 800 else near_links(a, b)
        counts.update(links)
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, low = [], 0
        for cut in cuts:
            mine = [[str(i) for begin, end, i in side if low <= begin and end <= cut] for side in (a, b)] if len(a) < 800 else None
            groups.append(mine)
            low = cut
        if len(a) >= 800:
            groups = grouped(a, b, cuts)
        found.append((doc_id, len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == highest[p[1]] for p in links)
        out.append((str(doc_id), n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out)


def near_links(a, b):
    """As above for long texts: both sides in order, so that partners stand together."""
    out, j = [], 0
    for begin, end, i in a:
        while b[j][1] <= begin:
            j += 1
        k = j
        while k < len(b) and b[k][0] < end:
            out.append((i, b[k][2]))
            k += 1
    return out


def grouped(a, b, cuts):
    sides = []
    for side in (a, b):
        at, mine = 0, []
        for cut in cuts:
            group = []
            while at < len(side) and side[at][1] <= cut:
                group.append(str(side[at][2]))
                at += 1
            mine.append(group)
        sides.append(mine)
    return list(zip(*sides, strict=True))


def shown(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


MIXED = ["the", "quick", "don't", "été", "naïve", "日本語", "🙂", "x\n\ny", "1234", "a b", "<|endoftext|>", "<s>", "<0x41>", "Ünïcode", " ", "--", "foo_bar", "é", "　", "ſ"]


@pytest.mark.parametrize("unit_words", [3, 100, 1_000_000])
def test_against_brute_force(spark, make_docs, libraries, unit_words):
    rng = random.Random(unit_words)
    rows = [(i, "".join(rng.choice(MIXED) + rng.choice([" ", " ", " ", "  ", "\n", "\t", ""]) for _ in range(rng.randrange(25)))) for i in range(150)]
    rows += [(900, " begins with a space"), (901, "  two"), (902, "ends "), (903, "▁ is changed"), (904, "fine ▁fine"), (905, "\x00"), (906, " "), (907, "   "), *EDGES]
    docs = make_docs(rows).repartition(4)
    assert shown(token_alignment.align_documents(docs, unit_words=unit_words)) == brute(rows, libraries)


def test_long_texts_are_gathered_in_parts(spark, make_docs, libraries, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(600_000))
    rows = [(1, long), (2, long + " ▁"), (3, "a b c"), (4, None), (5, " " * 1_200_000), (6, "\n" * 300_000 + "x"), (7, "z" * 200_000)]
    assert len(list(token_alignment.parts_of(long))) > 1
    assert shown(token_alignment.align_documents(make_docs(rows), unit_words=100_000)) == brute(rows, libraries)


def test_pair_counts_and_hot_words(spark, make_docs, libraries):
    rows = [(i, "the the the" if i % 3 else f"own{i} the") for i in range(600)]
    found = {(r.a, r.b): r.total for r in token_alignment.pair_counts(make_docs(rows).repartition(5), unit_words=50).collect()}
    counts = Counter()
    for _, text in rows:
        counts.update(near_links(*map(ranges, libraries(text))))
    assert found == counts


def test_empty_table_and_names(spark, make_docs):
    assert token_alignment.align_documents(make_docs([])).collect() == []
    names = {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert set(token_alignment.align_documents(make_docs([(1, None)])).columns) == names


@pytest.mark.parametrize("space", [" ", "\n", "\t", " ", " "])
def test_encoding_around_long_space(space):
    library = bpe._plain_tokenizer(A_PATH)
    for text in (space * 120_000, f"a b{space * 60_000}c d e{space * 70_000}f g", f"x y z {space * 200_000}", f"{space * 100_000}q r" + " w" * 60_000):
        assert bpe.encode_ordinary(A_PATH, text) == library.encode(text, add_special_tokens=False).ids
        assert "".join(s for s, _ in bpe.stretches(text)) == text
