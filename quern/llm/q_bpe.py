"""Query of the tokens; it has no SQL (merges in rank order)."""
from pyspark.sql import functions as F

from quern.llm.bpe import decode, encode

NAME = "op3_byte_bpe"


def run(spark, path):
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = decode(encode(spark.read.parquet(f"{path}/documents.parquet"), ranks, public_tokenizers.PATTERN), ranks)
    return made.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SQL = None
