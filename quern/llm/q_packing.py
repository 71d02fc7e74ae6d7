"""Query of the packed windows; it has no SQL (tokens, and an online rule)."""
from pyspark.sql import functions as F

from quern.llm.packing import packed_windows

NAME = "op13_packing"


def run(spark, path):
    import public_tokenizers
    made = packed_windows(spark.read.parquet(f"{path}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                       F.col("sequence").alias("sequence_id"), "offset")


SQL = None
