"""Repeated passages: bytes covered by a substring that also starts elsewhere.

Suffixes need to be told apart up to ``LENGTH`` bytes only. A difference cover names a
few residues of all places such that any two places have, within one period, a common shift
after which both are in the sample. The samples' classes (equal bytes up to where a match
must reach) are computed first; a suffix none of whose samples has a tie can have no
long tie and goes no further. What is left is dealt into buckets by the first bytes of the
suffix; a task takes one bucket at a time, sorts its suffixes and calls neighbours that tie to full depth repeats.

Blocks of documents ask buckets (see blocks.py): each distinct key once per block, so the
commonest passage or a run of one byte weighs no more than one key per block. What is sorted are 64-bit
fingerprints of the suffixes' first LENGTH bytes, not the bytes: they tell equal from different and
have no order of their own, which repeats don't need. The README says where that leaves the method.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.blocks import Stored, answers_of, packed, replies, shuffle_partitions
from quern.llm.fingerprints import fingerprints
from quern.llm.scratch import settled

LENGTH = 400
#: The sample's period is ORDER * ORDER + ORDER + 1 with ORDER + 1 residues.
ORDER = 13
#: Bytes that suffixes of one bucket share.
PREFIX = 64
BLOCK_BYTES = 3_000_000


@lru_cache(4)
def difference_cover(order: int) -> tuple[int, tuple[int, ...]]:
    """Period and residues of a perfect difference set for a prime ``order``: the zeros of
    a linear recurrence of length three modulo the order, where its zeros
    show every difference exactly once."""
    period = order * order + order + 1
    for a in range(order):
        for b in range(order):
            for c in range(1, order):
                s = [0, 0, 1]
                while len(s) < period:
                    s.append((a * s[-1] + b * s[-2] + c * s[-3]) % order)
                found = [i for i, x in enumerate(s) if x == 0]
                if len(found) == order + 1 and len({(x - y) % period for x in found for y in found}) == period:
                    return period, tuple(found)
    raise ValueError(f"{order} is no prime")


class Block:
    """Places of a block's texts that lie one after the other."""

    def __init__(self, row: dict, length: int, order: int):
        self.data = np.frombuffer(row["data"].as_py(), np.uint8)
        self.sizes = np.array(row["sizes"].as_py(), np.int64)
        self.ends = np.cumsum(self.sizes)
        self.digests = np.frombuffer(row["digests"].as_py(), "V16")
        self.length = length
        self.period, self.residues = difference_cover(order)

    def room(self, depth: int) -> np.ndarray:
        """Whether ``depth`` bytes of the same text start at each place."""
        ok = np.ones(len(self.data), bool)
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            ok[max(end - size, end - depth + 1):end] = False
        return ok

    def samples(self, live: np.ndarray) -> np.ndarray:
        depth = self.length - self.period + 1
        places = np.concatenate([np.arange(r, max(r, len(self.data)), self.period) for r in self.residues]) if len(self.data) else np.zeros(0, np.int64)
        places = places[places < len(self.data)]
        places.sort()
        return places[(self.room(depth) & live)[places]]

    def live(self, states: np.ndarray) -> np.ndarray:
        return np.repeat(states != 2, self.sizes)

    def candidates(self, samples: np.ndarray, tied: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Places with a tied sample within a period."""
        step = np.zeros(len(self.data) + 1, np.int32)
        p = samples[tied]
        np.add.at(step, np.maximum(p - self.period + 1, 0), 1)
        np.add.at(step, p + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & self.room(self.length) & live)


class Keys:
    """Distinct keys of some places, ordered by bucket, and which place has which."""

    def __init__(self, key: np.ndarray, bucket: np.ndarray):
        distinct, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(bucket[first], kind="stable")
        self.keys, self.buckets = distinct[order], bucket[first][order]
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        self.which, self.twice = place_of[which], count[order] > 1

    def asked(self) -> tuple[list[int], list[bytes]]:
        cuts = np.flatnonzero(np.diff(self.buckets)) + 1
        parts = np.split(self.keys, cuts) if len(self.keys) else []
        return [int(self.buckets[c]) for c in [0, *cuts.tolist()]] if parts else [], [p.tobytes() for p in parts]

    def flags(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each place, whether its key is anywhere else."""
        out = self.twice.copy()
        names, starts = np.unique(self.buckets, return_index=True)
        for b, a, z in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.keys)], strict=True):
            out[a:z] |= np.unpackbits(np.frombuffer(answers[b], np.uint8), count=z - a).astype(bool)
        return out[self.which]


def _sample_keys(block: Block, places: np.ndarray, buckets: int) -> Keys:
    (h,) = fingerprints(block.data, places, block.length - block.period + 1)
    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
    # a bucket's keys need 32 bits: a chance tie only makes a suffix a candidate
    return _narrow(Keys(bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF), bucket.astype(np.int64)))


def _narrow(keys: Keys) -> Keys:
    keys.keys = keys.keys.astype(np.uint32)
    return keys


def _suffix_keys(block: Block, places: np.ndarray, buckets: int) -> Keys:
    start, whole = fingerprints(block.data, places, min(PREFIX, block.length), block.length)
    return Keys(whole, (start % np.uint64(buckets)).astype(np.int64))


def _shared(kind: type):
    """A bit for each key of each block: whether another block has it, too."""
    def answer(asked: list[bytes]) -> list[bytes]:
        lists = [np.frombuffer(x, kind) for x in asked]
        every = np.sort(np.concatenate(lists))      # each block names a key once: ties are between blocks
        tied = np.unique(every[1:][every[1:] == every[:-1]])
        return [np.packbits(_among(x, tied)).tobytes() for x in lists]
    return answer


def _among(keys: np.ndarray, tied: np.ndarray) -> np.ndarray:
    if not len(tied):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(tied, keys), len(tied) - 1)
    return tied[at] == keys


def _copies(asked: list[bytes]) -> list[bytes]:
    """0: this block alone has the text, 1: it is the first of several, 2: a later one."""
    owners: dict[bytes, list[int]] = {}
    lists = [[x[i:i + 16] for i in range(0, len(x), 16)] for x in asked]
    for n, keys in enumerate(lists):
        for k in keys:
            owners.setdefault(k, []).append(n)
    return [bytes(0 if len(owners[k]) == 1 else 1 if owners[k][0] == n else 2 for k in keys) for n, keys in enumerate(lists)]


def _make(texts: list[bytes]) -> dict[str, pa.Array]:
    digests = b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts)
    return {"sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "digests": pa.array([digests], pa.binary()),
            "data": pa.array([b"".join(texts)], pa.binary())}


def _text_keys(block: Block) -> dict[bytes, list[int]]:
    held: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(block.sizes >= block.length).tolist():
        held.setdefault(block.digests[k].tobytes(), []).append(k)
    return held


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, order: int = ORDER) -> DataFrame:
    """(id, n_bytes, spans, kept): spans are the maximal removed runs [start, end) of bytes
    of the text in UTF-8, kept is what is left.

    A byte goes if some ``length`` bytes of its text that cover it also start at another
    place, in this or any other text; matches don't cross texts, and are judged on the
    input. Null is the empty text. Texts shorter than ``length`` stay whole. Rows
    that repeat an identifier count as texts of their own. Rows stay as they are; other
    columns go. ``length`` must be above the sample's period.
    """
    period, _ = difference_cover(order)
    if length <= period:
        raise ValueError(f"length must be above {period}")
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = 2 * shuffle_partitions(docs)
    stored = Stored(packed(docs, _make, "sizes array<bigint>, digests binary, data binary", id_col, text_col, BLOCK_BYTES))

    def states_of(block: Block, answers: dict[int, bytes]) -> np.ndarray:
        held = _text_keys(block)
        told = {k: s for b, ks in _dealt(held, buckets).items() for k, s in zip(ks, answers[b], strict=True)}
        states = np.zeros(len(block.sizes), np.int64)
        for key, rows in held.items():
            if told[key] or len(rows) > 1:
                states[rows] = 2
                if told[key] < 2:
                    states[rows[0]] = 1
        return states

    def ask_texts(row: dict) -> tuple[list[int], list[bytes]]:
        dealt = _dealt(_text_keys(Block(row, length, order)), buckets)
        return list(dealt), [b"".join(ks) for ks in dealt.values()]

    def sampled(row: dict) -> tuple[Block, np.ndarray, np.ndarray, Keys]:
        block = Block(row, length, order)
        states = states_of(block, answers_of(row["texts"]))
        places = block.samples(block.live(states))
        return block, states, places, _sample_keys(block, places, buckets)

    def suffixes(row: dict) -> tuple[Block, np.ndarray, np.ndarray, Keys]:
        block, states, samples, keys = sampled(row)
        places = block.candidates(samples, keys.flags(answers_of(row["samples"])), block.live(states))
        return block, states, places, _suffix_keys(block, places, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                block, states, places, keys = suffixes(row)
                step = np.zeros(len(block.data) + 1, np.int32)
                hits = places[keys.flags(answers_of(row["suffixes"]))]
                step[hits] += 1
                step[hits + length] -= 1        # places are distinct
                gone = (np.cumsum(step[:-1]) > 0) | np.repeat(states > 0, block.sizes)
                ids, spans, kept = batch.column("ids")[k].values, [], []
                for end, size in zip(block.ends.tolist(), block.sizes.tolist(), strict=True):
                    mask = gone[end - size:end]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans.append([{"start": a, "end": z} for a, z in turns.reshape(-1, 2).tolist()])
                    kept.append(block.data[end - size:end][~mask].tobytes())
                yield pa.record_batch([ids, pa.array(block.sizes), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                                      names=["id", "n_bytes", "spans", "kept"])

    blocks = stored.table
    for name, ask, answer in (("texts", ask_texts, _copies), ("samples", lambda row: sampled(row)[3].asked(), _shared(np.uint32)),
                              ("suffixes", lambda row: suffixes(row)[3].asked(), _shared(np.uint64))):
        blocks = blocks.join(settled(replies(blocks, ask, answer, name)), "block", "left")
    return blocks.select("ids", "sizes", "digests", "data", "texts", "samples", "suffixes").mapInArrow(
        finish, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _dealt(held: dict[bytes, list[int]], buckets: int) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for key in held:
        out.setdefault(int.from_bytes(key[:8], "little") % buckets, []).append(key)
    return out
