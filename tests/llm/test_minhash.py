import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm.fingerprints import mixed
from quern.llm.minhash import _links, band_keys, components, near_classes, short_vector, weighted_jaccard, weighted_samples
from quern.llm.words import shingles, token_hashes, word_hashes

from .common import empty, odd_texts, table


def plain_classes(texts, threshold=0.8):
    words = [[w for w in re.split(r"\W+", (t or "").lower()) if w] for t in texts]
    sets = [Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []) for w in words]
    df = Counter(k for s in sets for k in s)
    vectors = [{k: n * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in s.items()} for s in sets]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            low = sum(min(w, b[k]) for k, w in a.items() if k in b)
            if a and b and low / (sum(a.values()) + sum(b.values()) - low) >= threshold:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def edited(rng, base, n, words):
    out = base[:]
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(words)
    return " ".join(out)


def test_words():
    texts = [b"", "Ünï Wörd_1, two—three".encode(), b"a  b\nA\tB", b"x" * 3_000_000, b"word " * 600_000]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [0, 4, 4, 1, 600_000]
    assert hashes[4] == hashes[6] and hashes[5] == hashes[7] and len(set(hashes[9:].tolist())) == 1
    keys, text = shingles(hashes, counts)
    assert np.bincount(text, minlength=5).tolist() == [0, 1, 1, 1, 599_996] and len(set(keys[3:].tolist())) == 1
    many, n = token_hashes([b"a!! B  c***", b"", b"x"])
    assert n.tolist() == [5, 0, 1] and len(set(many.tolist())) == 6


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    w = rng.uniform(0.5, 8, 300)
    other = w * rng.uniform(0.7, 1.1, 300)
    a, b = np.arange(0, 280), np.arange(20, 300)
    want = weighted_jaccard(keys[a][np.argsort(keys[a])], w[a][np.argsort(keys[a])], keys[b][np.argsort(keys[b])], other[b][np.argsort(keys[b])])
    same = (weighted_samples(keys[a], w[a], 3000) == weighted_samples(keys[b], other[b], 3000)).mean()
    assert abs(same - want) < 0.03


def test_classes_against_all_pairs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    bases = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    texts = [edited(rng, rng.choice(bases), rng.randint(0, 6), words) for _ in range(120)] + odd_texts()
    order = rng.sample(range(len(texts)), len(texts))
    texts = [texts[k] for k in order]
    found = near_classes(table(spark, texts)).collect()
    assert len(found) == len(texts)
    want = plain_classes(texts)
    assert {r["id"]: r["class_id"] for r in found} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["id"] == r["class_id"]) for r in found)


def test_a_near_copy_beside_few_and_many_copies(spark):
    """Copies of a text don't change how similar another one is to it."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2_000)]
    other = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(200)]
    base = [rng.choice(words) for _ in range(104)]
    near = base[:50] + ["edited"] + base[51:]       # 5 of 100 shingles differ
    far = [w if k % 12 else "other" for k, w in enumerate(base)]
    for copies in (10, 10_000):
        texts = [*other, " ".join(near), " ".join(far), *[" ".join(base)] * copies]
        found = {r["id"]: r for r in near_classes(table(spark, texts)).collect()}
        assert found[200]["class_size"] == copies + 1 and found[len(texts) - 1]["class_id"] == 200
        assert found[201]["class_size"] == 1


def test_a_large_group_of_near_copies(spark):
    """Three words of 400 differ in each: their number does not part them, and other texts stay alone."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2_000)]
    other = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(400)]
    for copies in (5, 300):
        near = []
        for k in range(copies):
            at = rng.sample(range(10, 390), 3)
            near.append(" ".join(f"edit{k}" if n in at else w for n, w in enumerate(base)))
        found = near_classes(table(spark, [*near, *other])).collect()
        assert {r["class_id"] for r in found if r["id"] < copies} == {0} and all(r["class_size"] == copies for r in found if r["id"] < copies)
        assert all(r["class_size"] == 1 for r in found if r["id"] >= copies)


def chained(spark, n):
    """n nodes of one bucket of which neighbours alone are similar, and one that is like none; all samples agree, so every pair is a candidate."""
    rows, same = [], np.zeros(80, np.uint16).tobytes()
    for k in range(n):
        keys = np.arange(k * 10, k * 10 + 100, dtype=np.uint32)
        rows.append((k.to_bytes(16, "big"), keys.tobytes(), np.ones(100, np.float32).tobytes(), [5, 10_000 + k], same))
    rows.append(((99_999).to_bytes(16, "big"), np.arange(50_000, 50_100, dtype=np.uint32).tobytes(), np.ones(100, np.float32).tobytes(), [5, 9_999], same))
    return spark.createDataFrame(rows, "node binary, keys binary, weights binary, bands array<long>, samples binary")


def test_chain_in_one_bucket(spark):
    """The pivot finds one neighbour; the blocks of the bucket have to find the chain."""
    for n in (24, 700):
        links = _links(chained(spark, n), 0.8)
        found = components(links).collect()
        assert {int.from_bytes(r["comp"], "big") for r in found} == {0} and len(found) == n
        assert links.count() < 8 * n


def test_earlier_bands_take_a_pair(spark):
    """Copies of a bucket under other keys add no links of their own, and lose none."""
    v = chained(spark, 40).withColumn("bands", F.array(F.lit(1), F.lit(2), F.lit(3), F.col("bands")[0], F.col("bands")[1]))
    found = components(_links(v, 0.8)).collect()
    assert {int.from_bytes(r["comp"], "big") for r in found} == {0} and len(found) == 40


def test_large_groups_of_unlike_texts_that_share_buckets(spark):
    """Two groups of near copies, most pairs of which are a little too far apart: classes equal those of all pairs by brute force."""
    rng = random.Random(8)
    rows, sets = [], []
    for g in range(2):
        base = np.arange(g * 10_000, g * 10_000 + 120)
        for k in range(300):
            keys = np.array(sorted({*rng.sample(base.tolist(), 120 - rng.randint(3, 16)), *(1_000_000 + 100 * len(sets) + x for x in range(rng.randint(2, 9)))}), np.uint32)
            weights = np.ones(len(keys), np.float32)
            samples = weighted_samples(keys.astype(np.uint64), weights.astype(float), 80)
            rows.append((len(sets).to_bytes(16, "big"), keys.tobytes(), weights.tobytes(), band_keys(samples, 20).tolist(), mixed(samples).astype(np.uint16).tobytes()))
            sets.append(set(keys.tolist()))
    v = spark.createDataFrame(rows, "node binary, keys binary, weights binary, bands array<long>, samples binary")
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both / (len(a) + len(sets[j]) - both) >= 0.8:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    want = {i: find(i) for i in range(len(sets))}
    found = {i: i for i in want} | {int.from_bytes(r["node"], "big"): int.from_bytes(r["comp"], "big") for r in components(_links(v, 0.8)).collect()}
    assert found == want and 2 < len(set(want.values())) < 300


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 512)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    groups = {}
    for a, b in pairs:
        x, y = groups.setdefault(a, {a}), groups.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                groups[k] = x
    links = spark.createDataFrame([(a.to_bytes(16, "big"), b.to_bytes(16, "big")) for a, b in pairs], "a binary, b binary")
    found = {int.from_bytes(r["node"], "big"): int.from_bytes(r["comp"], "big") for r in components(links).collect()}
    assert found == {k: min(g) for k, g in groups.items()}


def test_long_near_copies_whose_short_keys_agree(spark):
    """Of 250,000 shingles some agree in the 32 bits that comparisons use."""
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in rng.integers(0, 1 << 40, 250_000)]
    keys, _ = shingles(*word_hashes([" ".join(words).encode()]))
    assert len(np.unique(keys.astype(np.uint32))) < len(np.unique(keys))
    short, weights = short_vector(np.array([7, 5, 7 + (1 << 32)], np.uint64), np.array([1.0, 2.0, 4.0]))
    assert short.tolist() == [5, 7] and weights.tolist() == [2.0, 5.0]
    texts = [" ".join(words), " ".join([*words, "tail"]), " ".join(words[:1000]), "other words in a text of its own"]
    found = {r["id"]: r["class_id"] for r in near_classes(table(spark, texts)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}


def test_blocks_of_two_or_three_words(spark):
    for text in ("two words", "now three words", "a b"):
        assert [r["class_id"] for r in near_classes(table(spark, [text, text])).collect()] == [0, 0]


def test_null_identifiers_and_empty(spark):
    texts = ["a b c d e f", "A b, c d e f", "a b c d e f", None, "", "no words like it"]
    found = near_classes(table(spark, texts, ids=[None, 7, 3, 1, None, 3])).collect()
    got = defaultdict(list)
    for r in found:
        got[(r["class_id"], r["class_size"])].append((r["id"], r["kept"]))
    assert sorted(got[(3, 3)], key=repr) == sorted([(None, False), (7, False), (3, True)], key=repr)
    assert got[(1, 1)] == [(1, True)] and got[(None, 1)] == [(None, True)] and got[(3, 1)] == [(3, True)]
    assert near_classes(empty(spark)).collect() == []
