"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified.

1. Documents of the same words are one node; of all blocks that have a node, the first one owns it.
   Blocks ask hash buckets in how many nodes each distinct shingle of the nodes they own is, so
   copies of a text change no weight. Above COMMON nodes a frequency counts as that many, so a
   large group of near copies takes no more weight from its own shingles than a small one.
2. A node can have a partner of similarity T only if shingles that some other node
   has, too, make up T of its weight; others are done.
3. Improved consistent weighted sampling draws one shingle per hash with a chance
   in proportion to the minimum of the weights; bands of these are bucket keys.
4. In each bucket every node is compared with a pivot by weighted Jaccard similarity. A bucket that
   this leaves in several components is cut into blocks of a few hundred nodes, and two blocks at a time
   meet in a task, which compares what isn't connected yet and answers with links that connect it. So
   no bucket is listed as pairs and none is gathered, whatever its size.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm.blocks import Stored, answers_of, packed, replies, shuffle_partitions
from quern.llm.fingerprints import mixed
from quern.llm.scratch import FEW_ROWS, hot_lookup, lean, new_path, settled
from quern.llm.words import shingles, word_hashes

WIDTH = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8 ** 4) ** 20 > 0.9999.
BANDS, ROWS = 20, 4
BLOCK_BYTES = 4_000_000
#: Nodes of a block, two of which meet in a task.
BLOCK_NODES = 256
#: A pair is compared if so many of its 80 samples agree; at a similarity of 0.8 fewer do with a chance of 1e-6.
LEAST_AGREEING = 46
#: A shingle of more nodes weighs as one of so many. Else what a group's near copies share would weigh less the more of them
#: there are, and one edit would part them.
COMMON = 16


@lru_cache(1)
def _gamma_table() -> np.ndarray:
    """65,536 quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + g) exp(-g)."""
    want = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < want
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return high


def weighted_samples(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n consistent samples of a weighted set: equal sets give equal samples, two sets
    agree in one with a chance of their weighted Jaccard similarity."""
    gamma = _gamma_table()
    log_gamma, log_w = np.log(gamma), np.log(weights)
    turns = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)
    low, chosen, step = np.full(n, np.inf), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for at in range(0, len(keys), 1024):        # all hashes of some keys at once
        part = keys[at:at + 1024]
        u = mixed(part[None, :] + turns[:, None])
        r = gamma[(u & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (u >> np.uint64(32)).astype(np.float64)
        beta *= 2.0 ** -32
        t = np.floor(log_w[None, at:at + 1024] / r + beta)
        score = log_gamma[(u >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)]
        score -= r * (t - beta + 1)
        best = np.argmin(score, axis=1)
        rows = np.arange(n)
        better = score[rows, best] < low
        low[better] = score[rows, best][better]
        chosen[better], step[better] = part[best][better], t[rows, best][better]
    return chosen * np.uint64(31) + step.astype(np.uint64)


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = samples.reshape(bands, -1)
    odd = np.arange(3, 3 + 2 * rows.shape[1], 2, dtype=np.uint64)
    return mixed((mixed(rows) * odd).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def short_vector(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 32 bits of the keys of a text, sorted, and their weights. Keys of a long text that agree in these bits are one key
    with the sum of their weights: the comparisons take each key once."""
    short, at = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
    return short, np.bincount(at, weights, len(short)).astype(np.float32)


def weighted_jaccard(a_keys: np.ndarray, a: np.ndarray, b_keys: np.ndarray, b: np.ndarray) -> float:
    _, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    low = float(np.minimum(a[i], b[j]).sum())
    return low / (float(a.sum()) + float(b.sum()) - low)


# ------------------------------------------------------------------ document frequencies
class _Block:
    """Words and distinct shingles of the nodes that a block owns."""

    def __init__(self, row: dict, buckets: int):
        self.nodes, sizes, data = row["nodes"].as_py(), row["sizes"].as_py(), row["data"].as_py()
        ends, owned = np.cumsum(sizes).tolist(), _owned(self.nodes, answers_of(row["owners"]), buckets)
        #: places in the block of the documents that stand for the nodes
        self.docs = [d for d, own in enumerate(owned) if own]
        self.words, self.counts = word_hashes([data[ends[d] - sizes[d]:ends[d]] for d in self.docs] or [b""])
        keys, text = shingles(self.words, self.counts, WIDTH)
        order = np.lexsort((keys, text))
        keys, text = keys[order], text[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        #: one entry for each shingle of a text: its key, text and frequency there
        self.keys, self.text, self.tf = keys[starts], text[starts], np.diff(starts, append=len(keys))
        bucket = (self.keys >> np.uint64(40)) % np.uint64(buckets)
        # within its bucket a key has 40 bits: two of them agree by chance once in a million
        asked = bucket << np.uint64(40) | self.keys & np.uint64((1 << 40) - 1)
        self.asked, self.which, self.here = np.unique(asked, return_inverse=True, return_counts=True)
        self.buckets = (self.asked >> np.uint64(40)).astype(np.int64)

    def parts(self) -> list[tuple[int, int, int]]:
        names, starts = np.unique(self.buckets, return_index=True)
        return list(zip(names.tolist(), starts.tolist(), [*starts.tolist(), len(self.asked)][1:], strict=True))

    def ask(self) -> tuple[list[int], list[bytes]]:
        parts = self.parts()
        return [b for b, _, _ in parts], [_pack_keys(self.asked[a:z], self.here[a:z]) for _, a, z in parts]

    def document_frequency(self, answers: dict[int, bytes]) -> np.ndarray:
        df = self.here.copy()
        for b, a, z in self.parts():
            n = z - a
            bits = np.unpackbits(np.frombuffer(answers[b], np.uint8, (n + 7) // 8), count=n).astype(bool)
            df[a:z][bits] = np.frombuffer(answers[b], np.uint32, offset=(n + 7) // 8)
        return df[self.which]


def _pack_keys(keys: np.ndarray, here: np.ndarray) -> bytes:
    """Number of keys, low 32 and next 8 bits of each, then places and counts of those above 1."""
    more = np.flatnonzero(here > 1).astype(np.uint32)
    return b"".join([np.array([len(keys), len(more)], np.uint32).tobytes(), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                     (keys >> np.uint64(32)).astype(np.uint8).tobytes(), more.tobytes(), here[more].astype(np.uint32).tobytes()])


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, np.uint32, 2).tolist()
    keys = np.frombuffer(data, np.uint32, n, 8).astype(np.uint64) | np.frombuffer(data, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32)
    here = np.ones(n, np.int64)
    at = 8 + 5 * n
    here[np.frombuffer(data, np.uint32, m, at)] = np.frombuffer(data, np.uint32, m, at + 4 * m)
    return keys, here


def _frequencies(asked: list[bytes]) -> list[bytes]:
    """For each block: a bit for keys that other blocks have, too, then their frequency in all."""
    lists = [_unpack_keys(x) for x in asked]
    every = np.sort(np.concatenate([k for k, _ in lists]))
    tied = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    total, found = np.zeros(len(tied), np.int64), []
    for keys, here in lists:
        at = np.minimum(np.searchsorted(tied, keys), max(len(tied) - 1, 0))
        is_tied = tied[at] == keys if len(tied) else np.zeros(len(keys), bool)
        found.append((is_tied, at[is_tied]))
        total[at[is_tied]] += here[is_tied]     # a block names a key once
    return [np.packbits(bits).tobytes() + total[at].astype(np.uint32).tobytes() for bits, at in found]


def _digests(texts: list[bytes]) -> list[bytes | None]:
    """The node of each text: the digest of its words, None without words."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [hashlib.blake2b(words[e - n:e].tobytes(), digest_size=16).digest() if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _make(texts: list[bytes]) -> dict[str, pa.Array]:
    return {"sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "data": pa.array([b"".join(texts)], pa.binary()),
            "nodes": pa.array([_digests(texts)], pa.list_(pa.binary()))}


# ------------------------------------------------------------------ owners of nodes
def _by_bucket(nodes: list[bytes | None], buckets: int) -> dict[int, list[bytes]]:
    """The distinct nodes of a block in the order of their first documents, by bucket."""
    out: dict[int, list[bytes]] = {}
    for node in dict.fromkeys(n for n in nodes if n is not None):
        out.setdefault(int.from_bytes(node[:4], "little") % buckets, []).append(node)
    return out


def _ask_owners(row: dict, buckets: int) -> tuple[list[int], list[bytes]]:
    parts, block = _by_bucket(row["nodes"].as_py(), buckets), row["block"].as_py().to_bytes(8, "little")
    return list(parts), [block + b"".join(p) for p in parts.values()]


def _owners(asked: list[bytes]) -> list[bytes]:
    """For each block, a bit for the nodes that no block of a lower number has."""
    out, seen = [b""] * len(asked), set()
    for k in sorted(range(len(asked)), key=lambda k: int.from_bytes(asked[k][:8], "little")):
        nodes = [asked[k][at:at + 16] for at in range(8, len(asked[k]), 16)]
        out[k] = np.packbits(np.array([n not in seen for n in nodes], bool)).tobytes()
        seen.update(nodes)
    return out


def _owned(nodes: list[bytes | None], answers: dict[int, bytes], buckets: int) -> list[bool]:
    """Whether a document is the first one of a node that its block owns."""
    own = set()
    for b, part in _by_bucket(nodes, buckets).items():
        bits = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(part))
        own.update(n for n, bit in zip(part, bits, strict=True) if bit)
    out = []
    for n in nodes:
        out.append(n in own)
        own.discard(n)
    return out


def weighted_nodes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, node, keys, weights, bands, samples), written to the shared folder. A node is the digest of
    a text's words, null without words. Only one document of a node, and only if
    the node can have a partner, has the last four columns."""
    spark, kind, buckets = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), 2 * shuffle_partitions(docs)
    stored = Stored(packed(docs, _make, "sizes array<bigint>, data binary, nodes array<binary>", id_col, text_col, BLOCK_BYTES))
    total = stored.table.select(F.explode("nodes").alias("node")).agg(F.count_distinct("node")).first()[0]
    owners = settled(replies(stored.table.select("block", "nodes"), lambda row: _ask_owners(row, buckets), _owners, "owners"))
    blocks = stored.table.join(owners, "block", "left")
    told = replies(blocks, lambda row: _Block(row, buckets).ask(), _frequencies, "answers")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                block = _Block(row, buckets)
                df = block.document_frequency(answers_of(row["answers"]))
                weights = block.tf * (np.log((1 + total) / (1 + np.minimum(df, COMMON))) + 1)
                n = len(block.counts)
                mass = np.bincount(block.text, weights, n)
                shared = np.bincount(block.text, weights * (df > 1), n)
                likely = (shared >= threshold * mass * (1 - 1e-9)) & (mass > 0)
                cut = np.searchsorted(block.text, np.arange(n + 1))
                vectors = [(None, None, None, None)] * len(block.nodes)
                for d in np.flatnonzero(likely).tolist():
                    keys, w = block.keys[cut[d]:cut[d + 1]], weights[cut[d]:cut[d + 1]]
                    samples = weighted_samples(keys, w, BANDS * ROWS)
                    bands = band_keys(samples, BANDS)
                    short, short_w = short_vector(keys, w)
                    vectors[block.docs[d]] = (short.tobytes(), short_w.tobytes(), bands.tolist(), mixed(samples).astype(np.uint16).tobytes())
                columns = list(zip(*vectors, strict=True))
                yield pa.record_batch([batch.column("ids")[k].values, pa.array(block.nodes, pa.binary()), pa.array(columns[0], pa.binary()),
                                       pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.binary())],
                                      names=["id", "node", "keys", "weights", "bands", "samples"])

    path = new_path(spark, "nodes")
    made = blocks.join(told, "block", "left").select("ids", "sizes", "data", "nodes", "owners", "answers").mapInArrow(
        lean(finish), f"id {kind}, node binary, keys binary, weights binary, bands array<bigint>, samples binary")
    made.write.option("compression", "zstd").parquet(path)
    stored.drop()
    return spark.read.schema(made.schema).parquet(path)


# ------------------------------------------------------------------ links and classes
def _similar(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = []
            for ka, wa, kb, wb in zip(*(batch.column(c) for c in ("ka", "wa", "kb", "wb")), strict=True):
                s = weighted_jaccard(np.frombuffer(ka.as_py(), np.uint32), np.frombuffer(wa.as_py(), np.float32).astype(np.float64),
                                     np.frombuffer(kb.as_py(), np.uint32), np.frombuffer(wb.as_py(), np.float32).astype(np.float64))
                use.append(s >= threshold - 1e-6)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(use, pa.bool_()))
    a = vectors.select(F.col("node").alias("a"), F.col("keys").alias("ka"), F.col("weights").alias("wa"))
    b = vectors.select(F.col("node").alias("b"), F.col("keys").alias("kb"), F.col("weights").alias("wb"))
    # the shuffles of both joins can be split where one pivot has many partners
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ka", "wa", "kb", "wb").mapInArrow(lean(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in links (a, b), comp the smallest node of each component.

    Each round takes the least label among a node's neighbours and then that label's own
    label, so chains shorten by halves. Labels of few nodes (counted once) are broadcast."""
    both = settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(both.groupBy("a").agg(F.min("b").alias("near"), F.count("*").alias("degree"))
                     .select(F.col("a").alias("node"), F.least("a", "near").alias("comp"), "degree"))
    few = labels.count() <= FEW_ROWS

    def label_of(rows: DataFrame, column: str, into: str) -> DataFrame:
        table = labels.select(F.col("node").alias(column), F.col("comp").alias(into))
        if few:
            return rows.join(F.broadcast(table), column)
        held = rows.groupBy(column).agg(F.count("*").alias("held"))
        return hot_lookup(rows, settled(held.join(table, column)), column, "held").drop("held")

    while True:
        near = label_of(both, "a", "new").groupBy(F.col("b").alias("node")).agg(F.min("new").alias("new"))
        step = labels.join(near, "node").select("node", "degree", "comp", F.least("comp", "new").alias("low"))
        step = step if few else settled(step)
        after = settled(label_of(step, "low", "lower").select("node", "degree", F.least("low", "lower").alias("comp"),
                                                               (F.least("low", "lower") != F.col("comp")).alias("moved")))
        labels = after.drop("moved")
        if after.filter("moved").isEmpty():
            return labels.select("node", "comp")


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node that links lead to in two steps. Nodes of one label are connected."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    one = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    return both.join(one.withColumnRenamed("a", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m")).select(
        "node", F.least("node", "m").alias("label"))


class _Members:
    """The nodes of one block of a bucket."""

    def __init__(self, rows: list[dict]):
        self.nodes = [r["node"] for r in rows]
        self.labels = [r["label"] for r in rows]
        self.band = rows[0]["band"] if rows else 0
        self.bands = np.array([r["bands"] for r in rows], np.int64).reshape(len(rows), -1)
        self.samples = np.array([np.frombuffer(r["samples"], np.uint16) for r in rows]).reshape(len(rows), -1)
        self.keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        self.weights = [np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in rows]
        self.mass = np.array([w.sum() for w in self.weights])


def _similarities(keys: np.ndarray, weights: np.ndarray, many: _Members, which: list[int]) -> np.ndarray:
    """Weighted Jaccard similarity of one set with each of several."""
    sizes = [len(many.keys[j]) for j in which]
    every, w = np.concatenate([many.keys[j] for j in which]), np.concatenate([many.weights[j] for j in which])
    at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
    low = np.where(keys[at] == every, np.minimum(weights[at], w), 0.0)
    low = np.add.reduceat(low, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return low / (weights.sum() + many.mass[which] - low)


def _connecting(a: _Members, b: _Members, same: bool, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between two blocks of a bucket (or within one) that connect all that its similar pairs connect. Pairs that share an
    earlier band, too, are left to that band's bucket; those of one label are connected already."""
    up: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for i, (node, label) in enumerate(zip(a.nodes, a.labels, strict=True)):
        agree = (b.samples == a.samples[i]).sum(axis=1) >= LEAST_AGREEING
        if same:
            agree[:i + 1] = False
        if a.band:
            agree &= ~(b.bands[:, :a.band] == a.bands[i, :a.band]).any(axis=1)
        which = [j for j in np.flatnonzero(agree).tolist() if find(b.labels[j]) != find(label)]
        if not which:
            continue
        for j, s in zip(which, _similarities(a.keys[i], a.weights[i], b, which).tolist(), strict=True):
            if s >= threshold - 1e-6 and find(b.labels[j]) != find(label):
                up[find(b.labels[j])] = find(label)
                out.append((node, b.nodes[j]))
    return out


def _block_links(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Links within the buckets of ``members`` (key, band, n, node, label). A row of a node for each block that its own meets."""
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    full = members.join(vectors.select("node", "keys", "weights", "bands", "samples"), "node").withColumn("own", own)
    rows = (full.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
            .select("key", "i", "j", "own", "band", "label", "node", "keys", "weights", "bands", "samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def answer() -> pa.RecordBatch | None:
            same = at[1] == at[2]
            if not held[0] or not (same or held[1]):
                return None
            first = _Members(held[0])
            found = _connecting(first, first if same else _Members(held[1]), same, threshold)
            return pa.record_batch([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["a", "b"]) if found else None

        for batch in batches:
            for row in batch.to_pylist():
                if (row["key"], row["i"], row["j"]) != at:
                    if at is not None and (found := answer()) is not None:
                        yield found
                    at, held = (row["key"], row["i"], row["j"]), ([], [])
                held[row["own"] != row["i"]].append(row)
        if at is not None and (found := answer()) is not None:
            yield found
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(run), "a binary, b binary")


def _links(vectors: DataFrame, threshold: float) -> DataFrame | None:
    """Links that connect, within each bucket, all nodes that similarities connect: every pair of a
    bucket is tested unless both are known to be connected."""
    rows = vectors.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = settled(rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"))
    members = settled(hot_lookup(rows, sizes, "key", "n").filter("n IS NOT NULL"))
    if sizes.isEmpty():
        return None
    tested = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = settled(_similar(tested, vectors, threshold))
    left = settled(members.filter("n > 2").select("key", "band", "n", "node").join(_near_labels(links), "node", "left")
                   .withColumn("label", F.coalesce("label", "node")))
    several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    return settled(links.unionByName(_block_links(left.join(several, "key", "left_semi"), vectors, threshold)))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, class_size, kept): one row per row of ``docs``.

    Texts of the same words are one class, and so are texts connected by links of at least
    ``threshold`` weighted Jaccard similarity of their TF-IDF five-word shingles. class_id is the
    smallest identifier of the class and its row is kept. A text of fewer than five words has one
    shingle of all its words. Null, empty and wordless texts are classes of their own. A null
    identifier is never the class's unless all are null; rows that repeat the
    kept identifier are kept with it. An empty table gives no rows.
    """
    made = weighted_nodes(docs, id_col, text_col, threshold)
    vectors = settled(made.filter("keys IS NOT NULL").groupBy("node").agg(*(F.first(c).alias(c) for c in ("keys", "weights", "bands", "samples"))))
    links = _links(vectors.filter(F.size("bands") > 0), threshold)
    rows = made.select("id", "node")
    if links is None:
        rows = rows.withColumn("comp", F.col("node"))
    else:
        comps = settled(components(links).join(rows.groupBy("node").agg(F.count("*").alias("held")), "node"))
        rows = hot_lookup(rows, comps, "node", "held").select("id", "node", F.coalesce("comp", "node").alias("comp"))
    rows = settled(rows.select("id", "comp"))
    classes = settled(rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("held")).filter("held > 1"))
    found = hot_lookup(rows, classes, "comp", "held")
    alone = F.col("held").isNull()
    return found.select("id", F.when(alone, F.col("id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("held", F.lit(1)).alias("class_size"),
                        (alone | F.col("id").eqNullSafe(F.col("least"))).alias("kept"))
