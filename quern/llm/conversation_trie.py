"""Prefix trie of conversations, from neighbours in sorted order.

A conversation is the string of its turns' digests. The strings are sorted by ranges; the
longest common prefixes (LCP) of sorted neighbours are the edges of a union-find, which
joins components in descending depth: every join makes, or widens, the branching node at that
depth. What a range can't know alone is contracted to the nodes on its two outer
strings that the neighbouring ranges share, and these are merged across the boundaries:
every measure of a node is a sum (or least identifier) over the sorted strings below it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.scratch import hot_lookup, settled

#: Bytes of a turn in a string, and of strings in a range (unless one string is longer).
DIGEST = 16
RANGE_BYTES = 32_000_000
#: Characters of a text that break ties of turns, before its digest does.
TIE_CHARS = 64
#: Nodes that leave a task at once; bytes of a piece of a list of identifiers.
NODES, PIECE = 50_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
STEP, HEADS = 20, 4


def turn_strings(turns: DataFrame) -> DataFrame:
    """(conv, key, words): ``key`` is the digests of the turns in order, 16 bytes each, ``words`` the words of
    each turn's text. Turns are ordered by turn (null first), then role, the text's first characters and its digest.
    Null role or text is empty. Rows without a conv_id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                 F.substring(text, 1, TIE_CHARS).alias("head"),
                 F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
                 F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    listed = one.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"))


def rebuilt(strings: DataFrame) -> DataFrame:
    """(conv, key, words): each conversation with the first h turns of the one its number rounds down to
    (in steps of 20) in place of its own first h, h being the checksum of its number modulo 4."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    donors = strings.filter(F.col("conv") % STEP == 0).select(
        F.col("conv").alias("donor"), F.slice("digests", 1, HEADS - 1).alias("lent"), F.slice("words", 1, HEADS - 1).alias("lent_words"))
    joined = strings.withColumn("donor", F.col("conv") - F.col("conv") % STEP).withColumn("h", h).join(donors, "donor", "left")

    def spliced(lent: str, own: str, kind: str):
        first = F.slice(F.coalesce(F.col(lent), F.expr(f"CAST(array() AS array<{kind}>)")), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0))))
    return joined.select("conv", F.unhex(F.array_join(spliced("lent", "digests", "string"), "")).alias("key"), spliced("lent_words", "words", "bigint").alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two strings have in common at their start."""
    n = min(len(a), len(b)) // DIGEST
    x, y = np.frombuffer(a, "V16", n), np.frombuffer(b, "V16", n)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


class Forest:
    """The nodes of sorted different strings, by union-find over the LCPs of neighbours."""

    def __init__(self, lengths: np.ndarray, lcp: np.ndarray):
        """lcp[i] is that of strings i - 1 and i; lcp[0] is not used. Afterwards ``depth``, ``first``, ``last`` and
        ``parent`` (-1 at the top) describe the nodes that end or branch; string i is node i unless it was
        taken in by an equal branching node, which ``merged`` then names."""
        m = len(lengths)
        self.depth, self.parent = lengths.tolist(), [-1] * m
        self.first, self.last = list(range(m)), list(range(m))
        merged = list(range(m))             # nodes that turned out to be another
        up, top = list(range(m)), list(range(m))    # component of a string, topmost node of a component

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        depth, parent, first, last = self.depth, self.parent, self.first, self.last
        joined: dict[int, list[int]] = {}
        for i in np.argsort(-lcp[1:], kind="stable").tolist():
            d = int(lcp[i + 1])
            a, b = find(i), find(i + 1)
            x, y = top[a], top[b]
            if depth[x] == d and depth[y] == d:     # two parts of one branching node
                if len(joined.get(x, ())) < len(joined.get(y, ())):
                    x, y = y, x
                for child in joined.pop(y, ()):
                    parent[child] = x
                    joined.setdefault(x, []).append(child)
                merged[y] = x
            elif depth[x] == d or depth[y] == d:    # one more child of a node
                x, y = (x, y) if depth[x] == d else (y, x)
                parent[y] = x
                joined.setdefault(x, []).append(y)
            else:
                z = len(depth)
                depth.append(d)
                parent.append(-1)
                first.append(0)
                last.append(0)
                merged.append(z)
                parent[x] = parent[y] = z
                joined[z] = [x, y]
                x = z
            up[b] = a                               # find halves the paths
            left, right = min(first[top[a]], first[top[b]]), max(last[top[a]], last[top[b]])
            top[a], first[x], last[x] = x, left, right
        self.merged = merged
        self.children = {x: len(c) for x, c in joined.items()}


def _part_nodes(keys: list[bytes], convs: list[np.ndarray], words: list[np.ndarray], before: int, after: int) -> Iterator[tuple]:
    """Rows of the nodes of one range: keys are its different strings in order with the identifiers and
    the words of each, before and after are the LCPs with the strings outside (-1 at the ends)."""
    m = len(keys)
    lengths = np.array([len(k) // DIGEST for k in keys], np.int64)
    lcp = np.array([before, *(common(a, b) for a, b in zip(keys, keys[1:]))], np.int64)
    to_next = np.append(lcp[1:], after)
    sums = [np.concatenate([[0], np.cumsum(w, dtype=np.int64)]) for w in words]     # words of the first turns
    count = np.array([len(c) for c in convs], np.int64)
    least = [int(c[0]) for c in convs]
    whole = np.array([s[-1] for s in sums], np.int64)
    new = np.array([s[-1] - s[max(int(x), 0)] for s, x in zip(sums, lcp)], np.int64)    # words that a string adds to the trie
    running = {name: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
               for name, x in (("count", count), ("leaves", to_next < lengths), ("words", count * whole), ("new", new))}
    forest = Forest(lengths, lcp)
    made = [v for v in range(len(forest.depth)) if forest.merged[v] == v]
    least_of = _least(forest, made, least)
    outer = {0: _prefix_digests(keys[0], max(before, after if m == 1 else -1)), m - 1: _prefix_digests(keys[-1], max(after, before if m == 1 else -1))}

    def shared(left: int, right: int, depth: int) -> int | None:
        """The outer string by which other ranges share this node, if any does."""
        return 0 if left == 0 and depth <= before else m - 1 if right == m - 1 and depth <= after else None

    for v in made:
        left, right, deep = forest.first[v], forest.last[v], forest.depth[v]
        above = forest.parent[v]
        shallow = forest.depth[above] + 1 if above >= 0 else 0
        n, leaves, all_words, fresh = (int(running[x][right + 1] - running[x][left]) for x in ("count", "leaves", "words", "new"))
        fresh -= int(new[left])
        s, own = sums[left], int(whole[left])
        for depth in range(shallow, deep + 1):
            head = int(s[depth - 1]) if depth else 0
            saved = all_words - n * head - fresh - (own - int(s[max(int(lcp[left]), depth - 1, 0)]))
            if depth < deep:
                children = int(lcp[left] <= depth)
            else:
                children = forest.children.get(v, 0) - int(v in forest.children and lengths[left] > depth and lcp[left] > depth)
            ends = convs[left] if depth == deep and lengths[left] == deep else None
            at = shared(left, right, depth)
            if depth == 0:
                parent, parent_node = None, None
            else:
                p_left, p_right = (left, right) if depth > shallow else (forest.first[above], forest.last[above])
                p_at = shared(p_left, p_right, depth - 1)
                parent = None if p_at is not None else least_of[v if depth > shallow else above]
                parent_node = None if p_at is None else outer[p_at][depth - 1]
            yield (None if at is None else outer[at][depth]), least_of[v], depth, parent, parent_node, n, children, leaves, saved, ends


def _prefix_digests(key: bytes, depth: int) -> list[bytes]:
    """A shared node is told by the digest of its string: one for each depth up to the one given."""
    running = hashlib.blake2b(digest_size=16)
    out = [running.digest()]
    for k in range(depth):
        running.update(key[DIGEST * k:DIGEST * k + DIGEST])
        out.append(running.digest())
    return out


def _least(forest: Forest, made: list[int], least: list[int]) -> dict[int, int]:
    """Least identifier below each node: nodes from the deepest to the highest hand theirs on."""
    out = {v: least[forest.first[v]] for v in made}
    for v in sorted(made, key=lambda v: -forest.depth[v]):
        p = forest.parent[v]
        if p >= 0:
            out[p] = min(out[p], out[v])
    return out


_NODE = ("node binary, conv_id bigint, depth bigint, parent_conv_id bigint, parent_node binary, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string, part int, piece int, ends binary")
_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last string of a range; nothing of an empty one."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            column = batch.column("key")
            first = column[0].as_py() if first is None else first
            last = column[batch.num_rows - 1].as_py()
    if first is not None:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())],
                              names=["part", "first", "last"])


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCP of each range's first string with the last one before it."""
    last = None
    for batch in batches:
        for part, first, end in zip(*(batch.column(c) for c in ("part", "first", "last")), strict=True):
            x = first.as_py()
            yield pa.record_batch([pa.array([part.as_py()], pa.int32()), pa.array([-1 if last is None else common(last, x)], pa.int64())], names=["part", "before"])
            last = end.as_py()


def prefix_trie(turns: DataFrame, strings: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per node of the
    trie of the rebuilt conversations in ``turns`` (conv_id, turn, role, text; other columns go), or of ``strings``
    as ``rebuilt`` gives them.

    A node is named by its smallest member and its depth. The root is a row as soon as there is a conversation; an
    empty table gives an empty one. Equal rows of a conversation are turns of their own. Two turns are equal if
    the 128-bit digests of role and text are. A conversation is one row of 24 bytes a turn, so a task has
    to hold the longest one; copies of one conversation, however many, are cut over ranges.
    """
    strings = settled(rebuilt(turn_strings(turns)) if strings is None else strings)
    total = strings.agg(F.sum(F.length("key") * F.lit(1.5) + F.lit(16)).alias("b")).first()["b"] or 0
    ranges = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // RANGE_BYTES) + 1)
    ordered = settled(strings.repartitionByRange(ranges, "key", "conv").sortWithinPartitions("key", "conv"))
    ends = ordered.mapInArrow(_boundaries, "part int, first binary, last binary")
    crossed = ends.repartition(1).sortWithinPartitions("part").mapInArrow(_crossings, "part int, before bigint").collect()   # two numbers a range
    before = {r["part"]: r["before"] for r in crossed}
    parts = sorted(before)
    after = {a: before[b] for a, b in zip(parts, parts[1:])}

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys: list[bytes] = []
        words: list[np.ndarray] = []
        convs: list[list[np.ndarray]] = []
        for batch in batches:
            ids, lists = np.array(batch.column("conv").to_numpy()), batch.column("words")
            start = 0
            here = batch.column("key").to_pylist()
            for k in range(batch.num_rows):
                if not keys or here[k] != keys[-1]:
                    if k > start:
                        convs[-1].append(ids[start:k])
                    start = k
                    keys.append(here[k])
                    words.append(np.array(lists[k].values.to_numpy()))
                    convs.append([])
            if batch.num_rows > start:
                convs[-1].append(ids[start:])
        if not keys:
            return
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

        for *row, at_end in _part_nodes(keys, [np.concatenate(c) for c in convs], words, before[part], after.get(part, -1)):
            if row[0] is None:
                listed = b"" if at_end is None else _decimal(at_end)
                rows.append((*row, hashlib.sha256(listed).hexdigest(), part, 0, None))
            else:
                rows.append((*row, None, part, 0, None))
                if at_end is not None:
                    step = PIECE // 20
                    rows += [(row[0], *[None] * 9, part, k + 1, _decimal(at_end[a:a + step])) for k, a in enumerate(range(0, len(at_end), step))]
            if len(rows) >= NODES:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    made = settled(ordered.mapInArrow(nodes, _NODE))
    shared = made.filter("node IS NOT NULL")
    lists = shared.filter("piece > 0").select("node", "part", "piece", "ends").repartition("node").sortWithinPartitions("node", "part", "piece").mapInArrow(
        _listed, "node binary, ends_sha256 string")
    merged = shared.filter("piece = 0").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_node").alias("parent_node"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = settled(merged.join(lists, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = made.filter("node IS NULL")
    asking = own.filter("parent_node IS NOT NULL").select(*columns, "parent_node").unionByName(merged.select(*columns, "parent_node"))
    parents = merged.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    told = hot_lookup(asking, parents, "parent_node", "weight")
    return own.filter("parent_node IS NULL").select(*columns, "parent_conv_id").unionByName(told.select(*columns, "parent_conv_id"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each node's list, whose pieces come in order: one piece is held at a time."""
    node, digest = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for x, piece in zip(batch.column("node"), batch.column("ends"), strict=True):
            if x.as_py() != node:
                if node is not None:
                    yield done()
                node, digest = x.as_py(), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py())
    if node is not None:
        yield done()
