"""Exact duplicates by sorting contents.

Sampled splitters cut the order of normalised texts into ranges, each range is
sorted (Spark's external sort, which spills), and one pass over a range compares
every text with its neighbour. The order is (first bytes, digest, identifier):
equal texts are adjacent in it, and as the identifier is a part of it, a group of
copies with any share of the rows is cut over as many ranges as it needs.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm.scratch import lean, settled, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text in a splitter; the digest tells longer common beginnings apart.
SPLITTER_CHARS = 32


def normalised(text_col: str) -> Column:
    """Null is empty; only A-Z are lower-cased."""
    return F.translate(text_of(text_col), UPPER, LOWER)


def _compare_neighbours(schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []          # of the current run of equal texts: identifiers only
        text = digest = None
        first_run = True
        out: list[tuple] = []

        def close(last: bool) -> None:
            keep = ids[0]       # the order has the largest identifier first
            edge = first_run or last
            for i, x in enumerate(ids):
                out.append((x, digest, part, keep, len(ids), i == 0, edge))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            keys, digests, texts = (batch.column(n) for n in ("id", "digest", "norm"))
            for k in range(batch.num_rows):
                d = digests[k].as_py()
                same = d == digest and texts[k].as_py() == text
                if not same:
                    if ids:
                        close(False)
                        first_run = False
                    ids, digest, text = [], d, texts[k].as_py()
                ids.append(keys[k].as_py())
                if len(out) >= 20_000:
                    yield flush()
        if ids:
            close(True)
        if out:
            yield flush()
    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, digest, keep_id, group_size, kept).

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the
    row with the largest identifier stays. Null texts are empty texts and equal to
    them; a null identifier is smaller than any other. Of rows that agree in text and
    identifier one stays. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    norm = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    keyed = norm.select("id", "norm", F.substring("norm", 1, SPLITTER_CHARS).alias("head"), F.sha2("norm", 256).alias("digest"))
    order = [F.col("head"), F.col("digest"), F.col("id").desc_nulls_last()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order[:2], "norm", order[2]).select("id", "digest", "norm")
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("digest", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("keep", kind), T.StructField("size", T.LongType()), T.StructField("first", T.BooleanType()),
        T.StructField("edge", T.BooleanType())])
    runs = settled(ordered.mapInArrow(lean(_compare_neighbours(schema)), schema))
    # Runs at the ends of a range may go on in the next one: two such runs a range at most.
    edges = (runs.filter("edge AND first").groupBy("digest")
             .agg(F.sum("size").alias("whole"), F.min("part").alias("first_part"), F.min_by("keep", "part").alias("largest")))
    joined = runs.join(F.broadcast(edges), "digest", "left")
    at_edge = F.col("edge")
    return joined.select(
        F.col("id"), "digest",
        F.when(at_edge, F.col("largest")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(at_edge, F.col("whole")).otherwise(F.col("size")).alias("group_size"),
        (F.col("first") & (~at_edge | (F.col("part") == F.col("first_part")))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the later copies, with their own columns."""
    groups = settled(exact_groups(docs, id_col, text_col))
    gone = groups.groupBy("id", "digest").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    # rows that agree in identifier and text can't be told apart by a join; they are rare
    marks = gone.filter("NOT stays OR rows > 1").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "stays")
    names = docs.columns
    row = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_key"), F.sha2(normalised(text_col), 256).alias("_sha"))
    marked = row.join(marks, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_sha")), "left")
    single = marked.filter("stays IS NULL").select("_row.*")
    again = marked.filter("stays").groupBy("_key", "_sha").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(again)
