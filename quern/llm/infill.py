"""Fill-in-middle: texts cut at two line ranks and put together in another order.

The lines of a text stand in an indexable skip list. Every link of a lane carries how many
lines and how many code points it passes over, so descending from the top lane by
accumulated widths reaches the two cut ranks exactly, and their places in the text with them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.scratch import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Percent of the texts that are cut, and of those the percent whose suffix comes first.
CUT_PERCENT, SPM_PERCENT = 100, 50
#: One node in so many of a lane stands in the next lane, too.
FAN_OUT = 4
#: Bytes of answers that leave a task at once.
ANSWER_BYTES = 8_000_000


class SkipList:
    """Units in order, each with its number of code points. Lane 0 has a node per unit; the
    heights are drawn, from the same numbers for every text."""

    _heights = np.zeros(0, np.int64)

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        heights = self._drawn(self.n)
        starts = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        nodes = np.arange(self.n)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []     # units and code points of a link, node below
        below = nodes
        while len(nodes):
            ends = np.append(nodes[1:], self.n)
            self.lanes.append((ends - nodes, starts[ends] - starts[nodes], np.searchsorted(below, nodes)))
            below, nodes = nodes, nodes[(heights[nodes] > len(self.lanes)) | (nodes == 0)]
            if len(nodes) == len(below):
                break

    @classmethod
    def _drawn(cls, n: int) -> np.ndarray:
        """The height of the k-th node is the same in every list and every process."""
        if len(cls._heights) < n:
            cls._heights = np.random.default_rng(SEED).geometric(1 - 1 / FAN_OUT, max(n, 2 * len(cls._heights), 1024))
        return cls._heights

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to n)."""
        at = units = points = 0
        for lane in reversed(range(len(self.lanes))):
            unit_width, point_width, below = self.lanes[lane]
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                points += int(point_width[at])
                at += 1
            if units == rank:
                return points
            at = int(below[at])
        return points


def line_widths(text: str) -> np.ndarray:
    """Code points of each line with its line feed."""
    parts = text.split("\n")
    widths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def _draws(id_col: str, seed: int) -> list[Column]:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _cut(text: str, h: list[int], cut_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    widths = line_widths(text)
    n = len(widths)
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= cut_percent:
        return n, "plain", None, None, text
    units = SkipList(widths)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = units.reach(low), units.reach(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_KINDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
             cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    n is the number of lines; form is plain (the text as it is), psm or spm. Texts that are
    empty, null (as empty) or contain one of the three marks are plain, with null lengths.
    The draws come from ``seed`` and the identifier (null as no digits), so rows that repeat an
    identifier are cut alike. Rows stay as they are; other columns go; an empty table
    gives an empty one. A text is cut in its row: nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = list(zip(*(batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True))
            texts, start, size = batch.column("text"), 0, 0
            made: list[tuple] = []
            for k, h in enumerate(draws):
                made.append(_cut(texts[k].as_py(), h, cut_percent, spm_percent))
                size += len(made[-1][-1])
                if size >= ANSWER_BYTES or k + 1 == len(draws):
                    columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), _KINDS.values(), strict=True)]
                    yield pa.record_batch([batch.column("id").slice(start, len(made)), *columns], names=["id", *_KINDS])
                    made, start, size = [], k + 1, 0
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *_draws(id_col, seed))
    return rows.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; null where the form or output is null. The parts hold
    none of the marks, and no mark can begin inside another, so the first one found is the right one."""
    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return text.substr(F.length(before(text, mark)) + F.lit(len(mark) + 1), F.length(text))
    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
