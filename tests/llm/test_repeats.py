import random
from collections import Counter

import pytest

from quern.llm.repeats import difference_cover, repeated_passages

from .common import empty, odd_texts, table


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        turns = [i for i in range(len(d) + 1) if (i < len(d) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((len(d), list(zip(turns[::2], turns[1::2], strict=True)), bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def check(spark, texts, length, order, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    found = repeated_passages(table(spark, texts, ids), length=length, order=order).collect()
    got = sorted((repr(r["id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in found)
    assert got == sorted((repr(i), *w) for i, w in zip(ids, plain(texts, length), strict=True))


@pytest.mark.parametrize("order", [2, 3, 5, 7, 13])
def test_cover(order):
    period, residues = difference_cover(order)
    assert period == order * order + order + 1
    for shift in range(period):
        assert any((d + shift) % period in residues for d in residues)


def test_small_alphabet(spark):
    rng = random.Random(7)
    check(spark, ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(60)], 16, 3)


def test_passages_across_documents(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    passages = [some(n) for n in (29, 30, 31, 45, 90)]
    texts = [some(rng.randint(0, 50)) + rng.choice(passages) + some(rng.randint(0, 50)) + rng.choice(passages) for _ in range(40)]
    texts += [texts[0], texts[1] + "!", passages[4] * 3, "z" * 200]
    check(spark, texts, 30, 3)


def test_production_length(spark):
    texts = [*odd_texts(), "q" * 399, "w" * 400, "w" * 400, "e" * 401, ("ab" * 300)[:599]]
    check(spark, texts, 400, 13, ids=[*range(len(texts) - 2), None, 0])


def test_empty_and_bad_length(spark):
    assert repeated_passages(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(empty(spark), length=100)
