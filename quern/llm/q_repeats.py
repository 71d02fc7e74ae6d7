"""Query of the repeated passages; its SQL would list every substring, so there is none."""
from pyspark.sql import functions as F

from quern.llm.repeats import repeated_passages

NAME = "op7_repeated_passages"


def run(spark, path):
    found = repeated_passages(spark.read.parquet(f"{path}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        "spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept"))


SQL = None
