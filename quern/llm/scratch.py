"""Where intermediate tables go, and lookups that hold when one key is hot."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local
    session without one (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = "file://" + tempfile.mkdtemp(prefix="quern-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own for every run: nothing is overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Computed once, kept in the shared folder: later readers survive the loss
    of any executor, and nothing upstream runs twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a working table of this run once nothing reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers stay for later tasks and stages, and
    what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, whose worker gives its memory back after each task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of a lookup table that go to every executor: some tens of MB at most.
FEW_ROWS = 100_000


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """Left join of ``rows`` to ``table``, a settled table of small rows, with one row
    per ``key`` and, in ``weight``, how many of the rows hold it.

    A table of up to FEW_ROWS rows (counted here) is broadcast. Beyond that, a key
    with over a ``most``-th of these rows is hot: there are fewer than ``most``
    such keys, so only these are broadcast and their rows stay where they are; all
    other rows meet by a shuffle in which no key is large.
    """
    counted = table.agg(F.sum(weight).alias("w"), F.count("*").alias("n")).first()
    if counted["n"] <= FEW_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    hot = F.col(weight) > (counted["w"] or 0) / most
    few = F.broadcast(table.filter(hot))
    is_hot = rows.join(few.select(key), key, "left_semi").join(few, key, "left")
    rest = rows.join(few.select(key), key, "left_anti").join(table.filter(~hot), key, "left")
    return is_hot.unionByName(rest)
