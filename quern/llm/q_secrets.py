"""Query of the secrets; it has no SQL (case rules and code points of regular expressions)."""
from pyspark.sql import functions as F

from quern.llm.credentials import BASE, secret_spans, span_text

NAME = "op1_secret_scan"


def run(spark, path):
    found = secret_spans(spark.read.parquet(f"{path}/documents.parquet"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


SQL = None
