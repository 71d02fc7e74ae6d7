"""Query of the near duplicates; it has no SQL (sampled candidates)."""
from quern.llm.minhash import near_classes

NAME = "op5_minhash_near_dedup"


def run(spark, path):
    return near_classes(spark.read.parquet(f"{path}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = None
