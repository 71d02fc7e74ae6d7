import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quern.llm.packing import END_ID, LONG_SPACE, Encoder, Levels, Piece, packed_windows

from .common import empty, odd_texts, table

PATH, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TRUTH = Tokenizer.from_file(PATH)
FAST = Encoder(PATH, RANKS, PATTERN)


def truth(text):
    return TRUTH.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(text):
    assert FAST.ids(text) == truth(text)


def test_ids_of_every_character():
    for start in range(0, 0x30000, 0x400):
        chars = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}{c} {c}\n{c} 's{c}" for c in chars)
        assert FAST.ids(text) == truth(text), hex(start)


def test_ids_of_odd_texts():
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x" * 30_000, " " * (LONG_SPACE - 1) + "x", " " * 400_000 + "x", "\n \t" * 5000 + "é"):
        assert FAST.ids(text) == truth(text)


def squares(counts, window):
    return sum(n * n for level, n in counts.items() if 0 < level < window)


@given(st.lists(st.integers(1, 63), max_size=120))
@settings(max_examples=100, deadline=None)
def test_each_placement_has_the_least_sum_of_squares(sizes):
    levels, counts = Levels(64, 10_000), {}
    for size in sizes:
        options = []
        for level in [0, *(h for h, n in counts.items() if n)]:
            if level + size <= 64:
                after = dict(counts)
                if level:
                    after[level] -= 1
                after[level + size] = after.get(level + size, 0) + 1
                after.pop(64, None)
                options.append((squares(after, 64), -level, after))
        _, level, counts = min(options, key=lambda x: x[:2])
        assert levels.best(size) == -level
        list(levels.place(Piece(0, 0, np.zeros(size, "<u4"), size)))
        assert {h: n for h, n in counts.items() if n} == {h: int(levels.number[h]) for h in range(1, 64) if levels.number[h] > 0}


def holds(rows, docs, window):
    """Every token once, in sequences without gaps that are windows or powers of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
        by_sequence.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
        assert r["length"] * 4 == len(r["ids"]) > 0
    assert set(by_doc) == set(docs)
    for doc, pieces in by_doc.items():
        pieces.sort()
        assert [x for _, ids, _ in pieces for x in ids] == docs[doc]
        assert all(total == len(docs[doc]) for _, _, total in pieces)
        assert [s for s, _, _ in pieces] == np.cumsum([0, *(len(ids) for _, ids, _ in pieces)]).tolist()[:-1]
    lengths = []
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces)]).tolist()[:-1]
        lengths.append(sum(n for _, n in pieces))
    assert all(n <= window and n & (n - 1) == 0 for n in lengths)
    return lengths


def test_documents(spark):
    texts = [*odd_texts(), "a <|endoftext|> b", " " * 100_000]
    docs = {k: truth(t or "") + [END_ID] for k, t in enumerate(texts)}
    for window, most_open in ((2048, 2048), (64, 2), (2, 1)):
        rows = packed_windows(table(spark, texts), PATH, RANKS, PATTERN, window=window, most_open=most_open).collect()
        lengths = holds(rows, docs, window)
        assert sum(n < window for n in lengths) <= 3 * window.bit_length()


def test_few_cuts(spark):
    """Where a task has many more documents than levels, few are cut for the windows that are left at its end."""
    rng = random.Random(5)
    texts = ["word " * rng.randint(1, 60) for _ in range(6000)]
    rows = packed_windows(table(spark, texts), PATH, RANKS, PATTERN, window=128).collect()
    holds(rows, {k: truth(t) + [END_ID] for k, t in enumerate(texts)}, 128)
    assert len(rows) < 1.05 * len(texts)


def test_repeated_and_null_identifiers(spark):
    rows = packed_windows(table(spark, ["a b", "a b", "", None], [1, 1, None, None]), PATH, RANKS, PATTERN).collect()
    tokens = {i: sum(r["length"] for r in rows if r["id"] == i) for i in (1, None)}
    assert tokens == {1: 6, None: 2} and {(r["id"], r["doc_tokens"]) for r in rows} == {(1, 3), (None, 1)}


def test_empty(spark):
    assert packed_windows(empty(spark), PATH, RANKS, PATTERN).collect() == []
