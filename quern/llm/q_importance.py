"""Query of the quality sample; it has no SQL (hashed models)."""
from pyspark.sql import functions as F

from quern.llm.importance import keep_share, log_ratios, resampled

NAME = "op4_importance_resampling"


def run(spark, path):
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    found = resampled(docs.select("doc_id", "text"), log_ratios(docs, labels), keep_share(labels))
    return found.select("row.doc_id", "log_weight", F.col("key").alias("gumbel_key"), "kept")


SQL = None
