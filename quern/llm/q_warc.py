"""Query and SQL of the archives."""
from quern.llm.scratch import id_type, new_path
from quern.llm.warc import read_archives, write_archives

NAME = "op9_warc"


def run(spark, path):
    pages = spark.read.parquet(f"{path}/pages.parquet")
    to = new_path(spark, "warc")
    write_archives(pages, to)
    return read_archives(spark, to, id_type(pages, "page_id")).drop("url", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, strlen(t) AS n, sha1(t) AS s, min(page_id) OVER (PARTITION BY t) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(s, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT)) AS five FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> b) & 31) AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
