import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_cases import EDGES
from quirespark.llm import media


@given(st.binary(max_size=2000), st.sampled_from([0, 1, 2, 3, 4, None]))
@settings(max_examples=150, deadline=None)
def test_images_hold_their_payload(data, filters):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and payload and payload.startswith(data)
    assert media.read_png(media.write_png(payload, filters=filters)).tobytes() == payload


def test_mixed_filters_are_undone():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    raw = np.stack([np.concatenate([[k], media.filter_rows(rows, int(k))[i]]).astype(np.uint8) for i, k in enumerate(kinds)])
    assert (media.unfilter(raw) == rows).all()


def test_damage_is_found():
    data = bytearray(media.write_png(bytes(range(64)) * 4))
    rng = random.Random(2)
    for _ in range(200):
        at = rng.randrange(len(data))
        broken = bytes(data[:at]) + bytes([data[at] ^ (1 << rng.randrange(8))]) + bytes(data[at + 1 :])
        with pytest.raises(media.BadImage):
            media.read_png(broken)
    for cut in (0, 7, 20, len(data) - 1):
        with pytest.raises(media.BadImage):
            media.read_png(bytes(data[:cut]))
    with pytest.raises(media.BadImage):
        media.read_png(bytes(data) + b"x")


def test_hash_survives_noise_and_tells_images_apart():
    rng = np.random.default_rng(3)

    def blurred():
        """Noise with all low frequencies, like a photograph's."""
        return np.kron(rng.integers(40, 216, (16, 16)), np.ones((4, 4), int)).astype(np.uint8)

    smooth, other = blurred(), blurred()
    noisy = np.clip(smooth.astype(int) + rng.integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(smooth, noisy) <= 6 < 15 < bits(smooth, other)


def test_features(edges):
    rows = media.media_features(media.to_media(edges)).collect()
    want = []
    for i, t in EDGES:
        data = (t or "").encode()
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        want.append((str(i), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert all(len(r.feature) == 16 and r.media_bytes > 0 and len(r.media_sha256) == 64 for r in rows)
    same = [r for r in rows if r.doc_id == 10]
    assert same[0][1:] == same[1][1:]


def test_null_and_empty(spark, make_docs):
    assert media.media_features(media.to_media(make_docs([]))).count() == 0
    rows = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.media_features(rows).first().feature is None


def test_images_of_any_heights_are_unfiltered_together():
    rng = np.random.default_rng(4)
    whole, stored = [], []
    for height in (1, 2, 3, 40, 200):
        rows = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        kinds = rng.integers(0, 5, height).astype(np.uint8)
        options = np.stack([media.filter_rows(rows, k) for k in range(5)])
        whole.append(rows)
        stored.append(np.concatenate([kinds[:, None], options[kinds, np.arange(height)]], axis=1))
    assert all((a == b).all() for a, b in zip(media.unfilter_many(stored), whole, strict=True))


def test_text_is_stored_under_all_filters():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(4000)) + "\x00" * 640 + "ab" * 640
    kinds = media.inflated(media.write_png(media.padded(text.encode())))[:, 0]
    assert set(kinds.tolist()) == {0, 1, 2, 3, 4}


def test_bad_headers_and_bombs():
    def image(header, rows):
        return media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(rows)) + media._chunk(b"IEND", b"")

    header = media.write_png(bytes(64))[16:29]
    assert media.read_png(image(header, bytes(65))).tobytes() == bytes(64)
    for bad, rows in ((header[:5], bytes(65)), (header + b"x", bytes(65)), (header, bytes(64)), (header, bytes(50_000_000)),
                      (bytes(8) + header[8:], b""), (b"\xff" * 8 + header[8:], bytes(65)), (header[:8] + b"\x10" + header[9:], bytes(65))):
        with pytest.raises(media.BadImage):
            media.read_png(image(bad, rows))


@pytest.mark.parametrize("kind", range(5))
def test_filters_are_those_of_the_format(kind):
    rows = np.random.default_rng(6).integers(0, 256, (30, 16), dtype=np.uint8)
    rows[10:20] //= 60  # many ties
    x = np.pad(rows.astype(int), ((1, 0), (1, 0)))
    want = np.zeros_like(rows)
    for r in range(30):
        for c in range(16):
            left, up, corner = int(x[r + 1, c]), int(x[r, c + 1]), int(x[r, c])
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(p - v))
            want[r, c] = (int(rows[r, c]) - (0, left, up, (left + up) // 2, paeth)[kind]) & 255
    assert (media.filter_rows(rows, kind) == want).all()
