"""Byte-level BPE of whole texts by replaying the merges over the corpus's words.

Blocks number the words of their documents; each distinct word goes once per block to the
bucket of its hash, where the merges of the vocabulary are applied to all of the
bucket's words at once, in rank order: an inverted index leads from a merge to the places
where its pair stands, and a merge touches only the neighbours of these places.
"""
from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.blocks import Stored, answers_of, gathered, pack_bytes, packed, replies, shuffle_partitions, unpack_bytes
from quern.llm.scratch import lean


#: A larger block names fewer words twice.
BLOCK_BYTES = 16_000_000
#: Words of a bucket whose merges are replayed at once: the index takes some hundred bytes for each byte of them.
WORDS = 20_000


@lru_cache(4)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, int], list[bytes]]:
    """Ranks of the tokens, rank of the merge of two ranks (left << 32 | right), and the bytes of each rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    merges = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                merges[left << 32 | right] = rank
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return ranks, merges, table


def id_kind(path: str) -> type:
    """The narrowest kind of integer that holds the ids of a vocabulary."""
    return np.uint16 if len(vocabulary(path)[2]) <= 1 << 16 else np.uint32


class Splitter:
    """Matches of a pattern; texts of ASCII alone take the same pattern in the faster engine."""

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern, regex.V0)
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self._ascii = None if r"\p" in plain else re.compile(plain, re.ASCII)

    def words(self, text: str) -> list[str]:
        if self._ascii and text.isascii():
            return self._ascii.findall(text)
        return self._any.findall(text)


def replay(words: list[bytes], ranks: dict[bytes, int], merges: dict[int, int]) -> list[list[int]]:
    """Token ids of each word. A word that is a token itself is that token."""
    found: list[list[int] | None] = [[ranks[w]] if w in ranks else [] if not w else None for w in words]
    todo = [k for k, ids in enumerate(found) if ids is None]
    byte = [ranks[bytes([b])] for b in range(256)]
    token: list[int] = []       # of all words, one after the other; -1 is between words or merged away
    ends: list[int] = []
    for k in todo:
        token += [byte[b] for b in words[k]]
        token.append(-1)
        ends.append(len(token) - 1)
    after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
    index: dict[int, list[int]] = {}    # merge -> places of its pair, as a heap
    pending: list[int] = []             # merges with places, as a heap

    def note(left: int, right: int) -> None:
        if left < 0 or token[left] < 0 or token[right] < 0:
            return
        rank = merges.get(token[left] << 32 | token[right])
        if rank is None:
            return
        places = index.get(rank)
        if places is None:
            index[rank] = [left]
            heapq.heappush(pending, rank)
        else:
            heapq.heappush(places, left)

    for left in range(len(token) - 1):
        note(left, left + 1)
    while pending:
        rank = pending[0]
        places = index[rank]
        if not places:
            heapq.heappop(pending)
            del index[rank]
            continue
        left = heapq.heappop(places)
        right = after[left] if token[left] >= 0 else -1
        if right < 0 or token[right] < 0 or merges.get(token[left] << 32 | token[right]) != rank:
            continue                    # merged meanwhile
        token[left], token[right] = rank, -2
        after[left] = after[right]
        if after[right] < len(token):
            before[after[right]] = left
        note(before[left], left)        # a lower rank than this one comes next
        note(left, after[left])
    start = 0
    for k, end in zip(todo, ends, strict=True):
        found[k] = [t for t in token[start:end] if t >= 0]
        start = end + 1
    return found


def by_weight(numbers: np.ndarray) -> bytes:
    """32-bit integers as all their lowest bytes, then all the next ones, and so on."""
    return np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def from_weights(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _numbered(splitter: Splitter):
    class Numbers(dict):
        def __missing__(self, word):
            number = self[word] = len(self)
            return number

    def make(texts: list[bytes]) -> dict[str, pa.Array]:
        numbers = Numbers()
        counts, parts = [], []
        for data in texts:
            words = splitter.words(data.decode())
            counts.append(len(words))
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        places = np.concatenate(parts)
        # the commonest words get the smallest numbers, and bytes of like weight lie together: both compress well
        order = np.argsort(-np.bincount(places, minlength=len(numbers)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        words = list(numbers)
        return {"counts": pa.array([counts], pa.list_(pa.int32())), "places": pa.array([by_weight(number[places])], pa.binary()),
                "words": pa.array([pack_bytes([words[k].encode() for k in order.tolist()])], pa.binary())}
    return make


def _ask(buckets: int):
    def run(row: dict) -> tuple[list[int], list[bytes]]:
        asked: dict[int, list[bytes]] = {}
        for w in unpack_bytes(row["words"].as_py()):
            asked.setdefault(zlib.crc32(w) % buckets, []).append(w)
        return list(asked), [pack_bytes(ws) for ws in asked.values()]
    return run


def _answer(path: str):
    def run(asked: list[bytes]) -> list[bytes]:
        ranks, merges, _ = vocabulary(path)
        lists = [unpack_bytes(x) for x in asked]
        kind = id_kind(path)
        distinct = list(dict.fromkeys(w for ws in lists for w in ws))
        ids: dict[bytes, bytes] = {}
        for at in range(0, len(distinct), WORDS):
            part = distinct[at:at + WORDS]
            ids.update(zip(part, (np.array(x, kind).tobytes() for x in replay(part, ranks, merges)), strict=True))
        return [pack_bytes([ids[w] for w in ws]) for ws in lists]
    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in one binary.

    Every match of ``pattern`` is encoded on its own by the ranks in the file ``path``
    (which each executor has), without special tokens. Null and empty texts have no
    tokens. Rows stay as they are, repeated and null identifiers too; other columns
    go. An empty table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    stored = Stored(packed(docs, _numbered(Splitter(pattern)), "counts array<int>, places binary, words binary", id_col, text_col, BLOCK_BYTES))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = unpack_bytes(batch.column("words")[k].as_py())
                replies = {b: iter(unpack_bytes(a)) for b, a in answers_of(batch.column("answers")[k]).items()}
                by_word = [next(replies[zlib.crc32(w) % buckets]) for w in words]
                kind = id_kind(path)
                table = np.frombuffer(b"".join(by_word), kind).astype(np.uint32)
                size = np.fromiter(map(len, by_word), np.int64, len(by_word)) // np.dtype(kind).itemsize
                start = np.cumsum(size) - size
                places = from_weights(batch.column("places")[k].as_py())
                ids, at = batch.column("ids")[k].values, 0
                made, n_tokens = [], []
                for count in batch.column("counts")[k].as_py():
                    here = places[at:at + count]
                    at += count
                    tokens = table[gathered(size[here], start[here])]
                    n_tokens.append(len(tokens))
                    made.append(tokens.tobytes())
                for i in range(0, len(made), 1000):
                    yield pa.record_batch([ids.slice(i, 1000), pa.array(n_tokens[i:i + 1000], pa.int64()), pa.array(made[i:i + 1000], pa.binary())],
                                          names=["id", "n_tokens", "ids"])

    buckets = 2 * shuffle_partitions(docs)
    told = replies(stored.table, _ask(buckets), _answer(path), "answers")
    return stored.table.join(told, "block", "left").select("ids", "counts", "places", "words", "answers").mapInArrow(
        lean(finish), f"id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids; null where the ids are null."""
    others = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)[2]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, np.uint32).tolist()))
                        for x in (v.as_py() for v in part.column(ids_col))]
                yield pa.record_batch([*(part.column(c) for c in others), pa.array(made, pa.binary())], names=[*others, "decoded"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(lean(run), f"{fields}, decoded binary")
