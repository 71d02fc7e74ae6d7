"""Quality by importance resampling.

Two generative models of hashed n-grams, one of texts labelled good, one of all texts, give each
document the log ratio of its chances in both. Gumbel noise makes a top-k of these a
sample without replacement in proportion to the ratios. The k-th key is found by
histograms of all keys, each within one bin of the one before.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.ngrams import counted, log_shares, rows_with, sums_by_text
from quern.llm.scratch import settled, text_of

#: Bound of the labelled texts that the target model is counted on.
TARGET_TEXTS = 20_000
#: A sample leaves out this part of the share that is labelled 0; the rest is the margin of good texts.
LEFT_OUT = 0.8
BINS = 4_096


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
               target_texts: int = TARGET_TEXTS) -> np.ndarray:
    """Log ratio of each n-gram bucket's shares in target and raw text. The target is at most
    ``target_texts`` texts labelled 1, by a hash of the identifier; raw is every text.
    Without labels all ratios are 0."""
    few = settled(labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(target_texts))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("data")).join(
        F.broadcast(few.withColumn("_in", F.lit(True))), "_id", "left")
    counts = counted(rows.select("data", F.coalesce("_in", F.lit(False)).alias("target"), F.lit(True).alias("raw")), ["target", "raw"])
    if not counts[0].any():
        return np.zeros(counts.shape[1])
    # the smoothing of the target is a text's worth of the raw model, so a bucket that few good texts met says little
    raw = log_shares(counts[1])
    target = counts[0] + 1_000 * np.exp(raw)
    return np.log(target) - np.log(target.sum()) - raw


def keep_share(labels: DataFrame, label_col: str = "quality", left_out: float = LEFT_OUT) -> float:
    """Share of the documents to take, from all labels: 1 without any."""
    bad, n = labels.filter(F.col(label_col).isin(0, 1)).agg(F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)), F.count("*")).first()
    return 1 - left_out * bad / n if n else 1.0


def with_log_weight(docs: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, log_weight): the log importance weight of each whole text; an empty or null one has 0."""
    def make(texts: list[bytes]) -> list[np.ndarray]:
        sums, _ = sums_by_text(texts, ratios[None, :])
        return [np.round(sums[:, 0], 6)]
    return rows_with(docs, text_col, [("log_weight", "double", pa.float64())], make)


def gumbel(*columns: str) -> Column:
    """Gumbel noise that depends on the row's values alone: a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = BINS) -> float | None:
    """The k-th largest value of the column ``key``, or None if there are fewer. Each round
    counts the values of one bin of the last round in ``bins`` finer bins."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k > n or k < 1:
        return None
    while low < high:
        width = (high - low) / bins
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        found = (keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("bin"))
                 .agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("bin")).collect())  # ``bins`` rows at most
        for r in found:
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def resampled(docs: DataFrame, ratios: np.ndarray, keep: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, log_weight, key, kept), where row is a struct of all columns: the Gumbel top-k
    for k = ``keep`` of all rows, rounded up; rows whose key equals the k-th one stay, too. An
    empty table gives an empty one. The texts are scored once for the keys and once for the result."""
    def scored(part: DataFrame) -> DataFrame:
        noise = gumbel(f"row.{id_col}", f"row.{text_col}")
        return with_log_weight(part, ratios, text_col).withColumn("key", F.round(F.col("log_weight") + noise, 9))
    keys = settled(scored(docs.select(id_col, text_col)).select("key"))
    threshold = kth_largest(keys, int(np.ceil(keep * keys.count())))
    return scored(docs).withColumn("kept", F.col("key") >= F.lit(threshold if threshold is not None else 0.0))
