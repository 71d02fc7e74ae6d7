"""Documents in blocks, and questions that blocks ask the corpus.

Some operators need, for each of very many small keys of a document (words, shingles,
substrings), something that only the whole corpus knows. A row per key would shuffle many
times the input. Here a block of documents packs its keys into one binary per hash
bucket, a bucket's task sees the keys of all blocks and answers each block in the
order asked, and the answers meet the block again. The block table is bucketed by
block in the shared folder, so its texts are never shuffled.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quern.llm.scratch import discard, give_back, lean, new_path, text_of

#: UTF-8 bytes of a block, unless one document is longer.
BLOCK_BYTES = 8_000_000


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(docs: DataFrame, make: Callable[[list[bytes]], dict[str, pa.Array]], columns: str,
           id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block: block number, the documents' identifiers and what ``make``
    gives for their texts, as one-row arrays for ``columns``. Null texts are empty;
    rows are kept as they are, so repeated and null identifiers stay apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            all_ids = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids)
            made = make(texts)
            return pa.record_batch([pa.array([part << 32 | n], pa.int64()), listed, *made.values()], names=["block", "ids", *made])

        for batch in batches:
            column, start = batch.column("data"), 0
            for k in range(batch.num_rows):
                texts.append(column[k].as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    ids.append(batch.column("id").slice(start, k + 1 - start))
                    yield block()
                    ids, texts, size, n, start = [], [], 0, n + 1, k + 1
            if start < batch.num_rows:
                ids.append(batch.column("id").slice(start))
        if texts:
            yield block()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(lean(run), f"block bigint, ids array<{kind}>, {columns}")


class Stored:
    """A block table in the shared folder, bucketed by block; ``drop`` deletes it."""

    def __init__(self, blocks: DataFrame):
        self._spark = blocks.sparkSession
        self._path = new_path(self._spark, "blocks")
        self._name = f"llm_blocks_{uuid.uuid4().hex}"
        (blocks.write.format("parquet").option("path", self._path).option("compression", "zstd")
         .option("parquet.block.size", 16 << 20).bucketBy(shuffle_partitions(blocks), "block").saveAsTable(self._name))
        self.table = self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        discard(self._spark, self._path)


ASKED = "block bigint, bucket int, asked binary"
ANSWERED = "block bigint, bucket int, answer binary"


def asked_batch(block: int, buckets: list[int], asked: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block] * len(buckets), pa.int64()), pa.array(buckets, pa.int32()), pa.array(asked, pa.binary())],
                           names=["block", "bucket", "asked"])


def replies(blocks: DataFrame, ask: Callable[[dict], tuple[list[int], list[bytes]]], answer: Callable[[list[bytes]], list[bytes]],
            name: str) -> DataFrame:
    """(block, ``name``: array of (bucket, answer)) for a block table.

    ``ask(row)`` gives bucket numbers and packed keys of a block's row; a key always
    falls to the same bucket. ``answer`` gets what all blocks asked one bucket and gives
    an answer to each.
    """
    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                yield asked_batch(row["block"].as_py(), *ask(row))

    def answering(table: pa.Table) -> pa.Table:
        made = pa.array(answer(table.column("asked").to_pylist()), pa.binary())
        give_back()
        return pa.table([table.column("block"), table.column("bucket"), made], names=["block", "bucket", "answer"])

    told = blocks.mapInArrow(lean(asking), ASKED).groupBy("bucket").applyInArrow(answering, ANSWERED)
    return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))


def answers_of(row_answers: pa.Scalar) -> dict[int, bytes]:
    return {x["bucket"]: x["answer"] for x in row_answers.as_py() or []}


# ------------------------------------------------------------------ packed arrays
def pack_bytes(items: list[bytes]) -> bytes:
    """Byte strings as one: their number, the width of a length, the lengths and the contents."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    kind = np.uint8 if not len(items) or lengths.max() < 256 else np.uint32
    return np.array([len(items), np.dtype(kind).itemsize], np.uint32).tobytes() + lengths.astype(kind).tobytes() + b"".join(items)


def unpack_bytes(data: bytes) -> list[bytes]:
    n, width = np.frombuffer(data, np.uint32, 2).tolist()
    at = 8 + width * n
    ends = np.cumsum(np.frombuffer(data, np.uint8 if width == 1 else np.uint32, n, 8), dtype=np.int64) + at
    out = []
    for end in ends.tolist():
        out.append(data[at:end])
        at = end
    return out


def gathered(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
