"""Texts of megabytes, and runs of white space that some matchers can't bear, through each operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirespark.llm import bpe, bpe_codec, class_lm, exact_dedup, language_id, license_scan, media, packing, simhash_dedup, spelling_variants, token_counts

N = 2_000_000
RUNS = {
    1: " " * N,
    2: f"a b{chr(10) * N}c d",
    3: f"{chr(9) * N}x",
    4: f"q w e {chr(0xA0) * N} y z",
    5: "some words of prose " * 60_000,
    6: "x" * 300_000,
}


@pytest.fixture(scope="module")
def long_docs(make_docs):
    return make_docs(list(RUNS.items()))


@pytest.fixture(scope="module")
def wanted():
    library = bpe._plain_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in RUNS.items()}


def test_encoding_and_packing_agree_with_the_library(long_docs, wanted):
    found = {r.doc_id: r for r in bpe_codec.round_trip_digests(long_docs).collect()}
    for i, ids in wanted.items():
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(RUNS[i].encode()).hexdigest()
    pieces = {}
    for r in packing.pieces_of(long_docs).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, ids in wanted.items():
        data = np.array([*ids, packing.END_ID], "<u4").tobytes()
        assert sorted(pieces[i]) == [(s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for s, n in packing.cut(len(ids) + 1, packing.CAPACITY)]


def test_token_counts(long_docs, wanted):
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(long_docs.where("doc_id <> 4")).collect()} == {i: len(x) for i, x in wanted.items() if i != 4}


def test_deduplication_and_scans(long_docs):
    assert exact_dedup.DigestIndex(long_docs.sparkSession).ingest(long_docs).where("kept").count() == len(RUNS)
    assert simhash_dedup.near_duplicates(long_docs).count() == len(RUNS)
    noted = long_docs.withColumns({"path": F.concat(F.lit("d/"), F.col("doc_id").cast("string")), "text": F.concat("text", F.lit("\nReleased under the MIT License."))})
    assert {r.license for r in license_scan.scan(noted).collect()} == {"MIT"}


def test_models_and_words(long_docs):
    scored = {r.doc_id: r for r in class_lm.score(long_docs, held_out=F.col("doc_id") == 6).collect()}
    assert scored[5].n_tokens == 240_001 and scored[1].n_tokens == 1
    model = language_id.Model(["xx"], np.zeros((language_id.BUCKETS, 1), np.float32), np.zeros(1))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(long_docs, model).collect()}[1] == "und"
    assert spelling_variants.word_counts(long_docs).where("length(word) < 100").count() == 0


def test_media(long_docs):
    found = {r.doc_id: r for r in media.media_features(media.to_media(long_docs.where("doc_id IN (1, 5)"))).collect()}
    for i in (1, 5):
        data = RUNS[i].encode()
        padded = data + bytes(-len(data) % 64 or 64 * (not data))
        assert found[i].n_bytes == len(data) and found[i].payload_sha256 == hashlib.sha256(padded).hexdigest()


def test_the_packing_stage_of_the_pipeline(spark, long_docs):
    packed = corpus_pipeline.STAGES[-1][1](spark, long_docs, None)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(RUNS)
