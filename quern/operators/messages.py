"""Message intake rules: senders, candidates, reasons."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F


def allowed_senders(text: str) -> list[str]:
    """Entries of an allow-list setting; a bare domain means "@domain"."""
    parts = [p for p in re.split(r"[,;\s]+", (text or "").lower()) if p]
    return [p if "@" in p else "@" + p for p in parts]


def sender_allowed(messages: DataFrame, column: str, entries: list[str]) -> DataFrame:
    """Rows whose address is listed, or whose domain is; an empty list lets all in."""
    addr = F.lower(F.coalesce(F.nullif(F.regexp_extract(column, "<([^>]*)>", 1), F.lit("")), F.trim(column)))
    m = messages.withColumn("addr", addr)
    if not entries:
        return m
    exact = [e for e in entries if not e.startswith("@")]
    domains = [e[1:] for e in entries if e.startswith("@")]
    at = F.substring_index("addr", "@", -1)
    return m.filter((F.col("addr") != "") & (F.col("addr").isin(exact) | (F.col("addr").contains("@") & at.isin(domains))))
