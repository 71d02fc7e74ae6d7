"""Rollups that keep child rows in order."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ordered_text(children: DataFrame, key: str, order: str, value: str, sep: str) -> DataFrame:
    """One text per record from its child rows in order. The result is one cell
    per record, so a record's rows (a few hundred at most) meet by nature."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return children.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["v"]), sep).alias("text"))
