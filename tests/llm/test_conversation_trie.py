import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from quern.llm.conversation_trie import Forest, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, node string, conv string, words int, depth string, part int"


def plain(rows):
    """Every node, from a dictionary of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = own.get(c - int(np.fmod(c, 20)), [])
        made[c] = tuple(donor[:h] + ts[h:])
    members, ends = {}, {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
        ends.setdefault(ts, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        below, leaves, saved = [p], 0, 0
        while below:
            q = below.pop()
            leaves += q not in kids
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
            below += kids.get(q, [])
        listed = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", "c", 1, "d", 2) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                   for r in df.collect()), key=repr)


@given(st.lists(st.text(alphabet="ab", max_size=6), min_size=1, max_size=40, unique=True))
@settings(max_examples=200, deadline=None)
def test_forest_has_every_ending_and_branching_prefix(words):
    words = sorted(words)
    lcp = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
    forest = Forest(np.array([len(w) for w in words]), np.array(lcp))
    made = {v: words[forest.first[v]][:forest.depth[v]] for v in range(len(forest.depth)) if forest.merged[v] == v}
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    branching = {p for p in prefixes if len({w[len(p)] for w in words if w.startswith(p) and len(w) > len(p)}) > 1}
    assert sorted(made.values()) == sorted(branching | set(words))
    for v, p in made.items():
        below = [w for w in words if w.startswith(p)]
        assert words[forest.first[v]:forest.last[v] + 1] == below
        longest = max((q for q in made.values() if q != p and p.startswith(q)), key=len, default=None)
        assert (made[forest.parent[v]] if forest.parent[v] >= 0 else None) == longest
        assert forest.children.get(v, 0) == len({w[len(p)] for w in below if len(w) > len(p)})


def test_random_conversations(spark):
    for seed, n, letters in ((1, 60, 2), (2, 200, 2), (3, 120, 4)):
        rng = random.Random(seed)
        rows = []
        for c in rng.sample(range(-30, 2 * n), n):
            for t in range(rng.randint(1, 7)):
                rows.append((c, t, rng.choice(["user", "assistant"]) if letters > 2 else "user", " ".join(rng.choice("xy") * rng.randint(1, letters) for _ in range(rng.randint(0, 1)))))
        assert found(prefix_trie(table(spark, rows))) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a  b\tc d\x0be"), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (1, 5, "", ""), (2, 5, None, None), (None, 1, "user", "lost"),
            (20, 1, "x", "y" * 70 + "b"), (20, 1, "x", "y" * 70 + "a"), (21, -3, "x", "word " * 30_000), (40, 0, "a:b", "c"), (41, 0, "a", ":bc"), (-7, 0, "u", "t"), (-20, 2, "u", "t")]
    want = plain([r for r in rows if r[0] != 20])
    assert found(prefix_trie(table(spark, rows))) == found(prefix_trie(table(spark, rows[::-1])))    # long ties: any order of rows gives the same
    assert found(prefix_trie(table(spark, [r for r in rows if r[0] != 20]))) == want


def test_one_large_group_and_one_long_conversation(spark):
    """Copies of one conversation are cut over ranges, and a long one shares its turns with another."""
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    rows += [(c, t, "user", f"long {t}") for c in (1000, 1001, 1020) for t in range(700)] + [(1021, 0, "user", "turn 0")]
    rows += [(2000 + c, 0, "user", f"own {c}") for c in range(100)]
    assert found(prefix_trie(table(spark, rows))) == plain(rows)


def test_empty(spark):
    assert prefix_trie(table(spark, [])).collect() == []
