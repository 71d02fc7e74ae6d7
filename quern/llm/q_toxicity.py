"""Query of the toxicity scores; it has no SQL (a trained model)."""
from pyspark.sql import functions as F

from quern.llm.toxicity import fit, labelled_sample, score_texts

NAME = "op6_toxicity"


def run(spark, path):
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scores = score_texts(docs, fit(labelled_sample(docs, labels)))
    return scores.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL = None
