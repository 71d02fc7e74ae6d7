import hashlib
import io
import zlib

import numpy as np
import pytest

from quern.llm.media import (BadImage, area_resized, decode, difference_hash, encode_bmp, encode_pgm, encode_ppm, media_features, payload_image,
                             stored, text_media)

from .common import empty, odd_texts, table

RNG = np.random.default_rng(3)
GRAY, RGB = RNG.integers(0, 256, (7, 13), dtype=np.uint8), RNG.integers(0, 256, (5, 6, 3), dtype=np.uint8)


@pytest.mark.parametrize("image,encode", [(GRAY, encode_pgm), (GRAY, encode_bmp), (RGB, encode_ppm), (RGB, encode_bmp)])
def test_round_trip(image, encode):
    assert (decode(encode(image)) == image).all()


def test_text_forms_and_bits():
    assert decode(b"P2 # c\n2 2\n15\n0 15\n5 10").tolist() == [[0, 255], [85, 170]]
    assert decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert decode(b"P1\n3 1\n1 01").tolist() == [[0, 255, 0]]
    assert decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    for bad in (b"", b"GIF89a", b"P5\n2 2\n65535\n", b"P5\n4 4\n255\nabc", b"P2\n2 2\n255\n1"):
        with pytest.raises((BadImage, ValueError)):
            decode(bad)


def naive(gray, height, width):
    h, w = gray.shape
    fine = np.repeat(np.repeat(gray.astype(float), height, 0), width, 1)     # h*height x w*width
    return fine.reshape(height, h, width, w).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(8, 9), (1, 64), (31, 7), (64, 64)])
def test_area(shape):
    gray = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert np.allclose(area_resized(gray, 8, 9), naive(gray, 8, 9))


def test_columns(spark):
    texts = odd_texts()
    found = {r["id"]: r for r in media_features(stored(text_media(table(spark, texts)))).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        data, r = (t or "").encode(), found[i]
        payload = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        image = payload_image(data)
        media = encode_pgm(image) if len(image) % 2 else encode_bmp(image)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        cells = np.round(naive(image, 8, 9), 6) if len(image) < 200 else None
        if cells is not None:
            assert r["feature"] == f"{int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), 'big'):016x}"
        assert r["feature"] == difference_hash(image) and np.load(io.BytesIO(r["tile"])).shape == (16, 16)
    assert found[5]["feature"] == found[6]["feature"] and found[0]["media_sha256"] == found[1]["media_sha256"]


def test_empty_and_nulls(spark):
    assert media_features(text_media(empty(spark))).collect() == []
    one = media_features(spark.createDataFrame([(None, None, 1), (2, bytearray(encode_pgm(GRAY)), 1)], "doc long, media binary, tile2 int")).collect()
    assert {r["doc"]: r["payload_bytes"] for r in one} == {None: None, 2: GRAY.size}
