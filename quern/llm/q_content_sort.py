"""Query and SQL of the exact duplicates."""
from quern.llm.content_sort import exact_groups

NAME = "op8_exact_dedup"


def run(spark, path):
    return exact_groups(spark.read.parquet(f"{path}/documents.parquet")).selectExpr(
        "id AS doc_id", "keep_id", "group_size", "kept", "digest AS text_sha256")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
