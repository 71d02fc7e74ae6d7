"""Hashed word n-grams of texts, counted by class and scored."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.fingerprints import mixed
from quern.llm.scratch import lean
from quern.llm.words import token_hashes

#: Hash buckets of a model: its size, whatever the corpus.
BUCKETS = 16_384


def ngram_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every token and pair of neighbouring tokens, and the tokens of each text."""
    one, counts = token_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    both = text[1:] == text[:-1]
    two = mixed(one[:-1] * np.uint64(3) + one[1:] * np.uint64(5))[both]
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[1:][both]]), counts


def counted(rows: DataFrame, classes: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """N-gram counts by class and bucket of all ``rows``: columns ``data`` and a boolean for
    each class. A task sends one row per bucket that it met; what comes to the driver
    is the model, of ``buckets`` rows."""
    fields = ", ".join(f"c{k} bigint" for k in range(len(classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(classes), buckets), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bucket, text, _ = ngram_buckets(part.column("data").to_pylist(), buckets)
                for k, c in enumerate(classes):
                    mine = np.array(part.column(c).to_pylist(), bool)
                    if mine.any():
                        total[k] += np.bincount(bucket if mine.all() else bucket[mine[text]], minlength=buckets)
        met = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(met), *(pa.array(t[met]) for t in total)], names=["bucket", *(f"c{k}" for k in range(len(classes)))])

    sums = rows.select("data", *classes).mapInArrow(lean(run), f"bucket bigint, {fields}").groupBy("bucket").agg(
        *(F.sum(f"c{k}").alias(f"c{k}") for k in range(len(classes))))
    out = np.zeros((len(classes), buckets), np.int64)
    for r in sums.toLocalIterator():
        out[:, r["bucket"]] = r[1:]
    return out


def log_shares(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log of each bucket's share of a class, smoothed."""
    c = counts + smoothing
    return np.log(c) - np.log(c.sum(axis=-1, keepdims=True))


def sums_by_text(texts: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each table over the n-grams of each text (texts x tables), and the texts' tokens."""
    bucket, text, counts = ngram_buckets(texts, tables.shape[1])
    return np.stack([np.bincount(text, t[bucket], len(texts)) for t in tables], axis=1), counts


def rows_with(docs: DataFrame, text_col: str, fields: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """``row``, a struct of all columns of ``docs`` (so no name of theirs can clash), and further
    columns: ``make`` gives one array per field for a list of texts. A null text counts as empty."""
    schema = ", ".join(["row " + docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType.simpleString(),
                        *(f"{n} {k}" for n, k, _ in fields)])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                row = batch.column("row").slice(at, 500)
                made = make([(t or "").encode() for t in row.field(place).to_pylist()])
                yield pa.record_batch([row, *(pa.array(m, k) for m, (_, _, k) in zip(made, fields, strict=True))], names=["row", *(n for n, _, _ in fields)])
    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(lean(run), schema)
