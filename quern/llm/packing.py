"""Documents packed into windows of tokens by the sum-of-squares rule.

Whole windows are cut off a document first. The rest is placed online: of all fill levels where
it fits, and a new window, the one is taken that leaves the smallest sum of squared
numbers of partly filled windows per level. A level array holds these numbers and, for
each level, its windows. Windows that are still open at the end of a task, or beyond a stated number,
are filled by cutting what the emptiest one holds, so a task pads nothing.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.scratch import text_of

WINDOW, END_ID = 2048, 1
#: Open windows of a task: a bound of its memory (8 KB each). Beyond it the fullest one is filled up by a cut.
MOST_OPEN = 2048
#: Bytes of ids that leave a task at once.
ANSWER_BYTES = 8_000_000
#: A longer run of white space overflows the stack of the faster library.
LONG_SPACE = 1000


class Encoder:
    """Ids of a text as the tokenizers library gives them for a tokenizer file, special tokens' strings included. The same
    vocabulary as ranks in the tiktoken library gives the same ids at a quarter of the time (the tests compare
    them on every character); texts that it can't take, or that hold a special token's string, go to tokenizers."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        with open(path, encoding="utf-8") as f:
            special = [x["content"] for x in json.load(f)["added_tokens"]]
        self._odd = re.compile("|".join([*map(re.escape, special), rf"\s{{{LONG_SPACE}}}"]))
        self._path, self._whole = path, None

    def ids(self, text: str) -> list[int]:
        if not self._odd.search(text):
            return self._fast.encode_ordinary(text)
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self._path)
        return self._whole.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    return Encoder(path, ranks, pattern)


class Piece:
    """Tokens ``start`` to ``start + len(ids)`` of a document of ``total`` tokens."""
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


class Levels:
    """Partly filled windows by their fill level."""

    def __init__(self, window: int, most_open: int):
        self.window, self.most_open = window, most_open
        self.number = np.zeros(window + 1)
        # Placing x at level h changes the sum by 2 * (number[h + x] - number[h]) + 2; with these two, also for new and for full windows
        self.number[0], self.number[window] = 0.5, -0.5
        self.at: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = 0

    def best(self, size: int) -> int:
        """The level to place ``size`` tokens on; among equals the fullest."""
        held = self.number[:self.window - size + 1]
        change = np.where(held > 0, self.number[size:] - held, np.inf)[::-1]
        return self.window - size - int(np.argmin(change))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Yields windows that got full."""
        level = self.best(len(piece.ids))
        window = self._take(level) if level else []
        window.append(piece)
        if level + len(piece.ids) == self.window:
            yield window
        else:
            self._put(level + len(piece.ids), window)
        while self.open > self.most_open:
            yield from self._top_up()

    def rest(self) -> Iterator[list[Piece]]:
        """What is still open, all filled; the last window's tokens go into sequences whose lengths are powers of two."""
        while self.open > 1:
            yield from self._top_up()
        if self.open:
            level = int(np.flatnonzero(self.number[1:self.window] > 0)[0]) + 1
            window = self._take(level)
            for bit in range(level.bit_length() - 1, -1, -1):
                if level >> bit & 1:
                    yield list(self._moved(window, 1 << bit))

    def _take(self, level: int) -> list[Piece]:
        self.number[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.number[level] += 1
        self.open += 1
        self.at[level].append(window)

    def _top_up(self) -> Iterator[list[Piece]]:
        """Moves what the emptiest window holds to the fullest, as far as there is room."""
        held = np.flatnonzero(self.number[1:self.window] > 0) + 1
        low, high = int(held[0]), int(held[-1])
        target, source = self._take(high), self._take(low)
        room = min(self.window - high, low)
        target.extend(self._moved(source, room))
        if low > room:
            self._put(low - room, source)
        if high + room == self.window:
            yield target
        else:
            self._put(high + room, target)

    @staticmethod
    def _moved(window: list[Piece], n: int) -> Iterator[Piece]:
        """Takes the last n tokens off a window."""
        while n:
            piece = window.pop()
            if len(piece.ids) > n:
                kept, piece = piece.cut(len(piece.ids) - n)
                window.append(kept)
            n -= len(piece.ids)
            yield piece


_KINDS = {"start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence": pa.int64(), "offset": pa.int64()}


def packed_windows(docs: DataFrame, path: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int | None = END_ID, most_open: int = MOST_OPEN) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence, offset) of every piece; ids are little-endian unsigned 32-bit integers.

    A document is its tokens by the tokenizer file ``path`` (its vocabulary as ranks: ``ranks``), then ``end_id``; null and empty
    texts have that one only. Each token lies in one piece. A sequence is ``window`` tokens long, but for the last ones of a
    task, whose lengths are powers of two: nothing is padded. Rows stay as they are, repeated and null identifiers too,
    and are packed in their task, without a shuffle; other columns go. Sequence numbers are those of the task and of its
    windows, so a repeated task gives the same. An empty table gives an empty one.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two above 1")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, ranks, pattern).ids
        first = TaskContext.get().partitionId() << 32
        levels, made, size, n, id_type = Levels(window, most_open), [], 0, 0, None
        last = [] if end_id is None else [end_id]

        def note(sequence: list[Piece]) -> None:
            nonlocal size, n
            offset = 0
            for p in sequence:
                made.append((p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, first + n, offset))
                offset += len(p.ids)
            size += 4 * offset
            n += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*made, strict=True))
            made.clear()
            size = 0
            return pa.record_batch([pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], _KINDS.values(), strict=True))],
                                   names=["id", *_KINDS])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                tokens = np.array(ids_of(text.as_py()) + last, "<u4")
                doc, total = doc.as_py(), len(tokens)
                whole = total - total % window
                for start in range(0, whole, window):
                    note([Piece(doc, start, tokens[start:start + window], total)])
                    if size >= ANSWER_BYTES:
                        yield flush()
                if whole < total:
                    for full in levels.place(Piece(doc, whole, tokens[whole:].copy(), total)):
                        note(full)
                if size >= ANSWER_BYTES:
                    yield flush()
        for sequence in levels.rest():
            note(sequence)
        if made:
            yield flush()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence bigint, offset bigint")
