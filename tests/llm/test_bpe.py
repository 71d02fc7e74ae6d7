import base64
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from quern.llm.bpe import Splitter, decode, encode, replay, vocabulary

from .common import empty, odd_texts, table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS, MERGES, TABLE = vocabulary(PATH)
TRUTH = tiktoken.Encoding("test", pat_str=PATTERN, special_tokens={},
                          mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})
SPLIT = Splitter(PATTERN)


def plain(text):
    return [i for ids in replay([w.encode() for w in SPLIT.words(text)], RANKS, MERGES) for i in ids]


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert plain(text) == TRUTH.encode_ordinary(text)


def test_every_character():
    for start in range(0, 0x30000, 0x400):
        chars = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}{c} {c}" for c in chars)
        assert plain(text) == TRUTH.encode_ordinary(text), hex(start)


def test_replay_order_with_lower_rank_later():
    """A merge whose pair comes up late, but has a lower rank, goes before what is left."""
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"aba": 1, b"ab": 2, b"abab": 3}
    merges = {ranks[x] << 32 | ranks[y]: ranks[x + y] for x in ranks for y in ranks if x + y in ranks}
    truth = tiktoken.Encoding("t", pat_str=r".+", special_tokens={}, mergeable_ranks={**ranks})
    for word in ("abab", "ababab", "abaabab", "bababab"):
        assert replay([word.encode()], ranks, merges)[0] == truth.encode_ordinary(word)


def test_replay_many_words_at_once():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    together = replay([w.encode() for w in words], RANKS, MERGES)
    assert together == [replay([w.encode()], RANKS, MERGES)[0] for w in words]
    assert replay([b"", b"a" * 50_000], RANKS, MERGES)[0] == []


def test_documents(spark):
    texts = [*odd_texts(), "don't  stop \n\n", "x" * 20_000, "1" * 999 + "!" * 999]
    ids = [*range(len(texts) - 2), None, 3]
    found = decode(encode(table(spark, texts, ids), PATH, PATTERN), PATH).collect()
    want = sorted((repr(i), np.array(TRUTH.encode_ordinary(t or ""), np.uint32).tobytes(), (t or "").encode()) for i, t in zip(ids, texts, strict=True))
    assert sorted((repr(r["id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in found) == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in found)


def test_empty(spark):
    assert encode(empty(spark), PATH, PATTERN).collect() == []


def test_ascii_engine_agrees():
    rx = regex.compile(PATTERN)
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(chr(rng.randrange(128)) for _ in range(100))
        assert SPLIT.words(t) == rx.findall(t)
