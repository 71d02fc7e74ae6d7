"""Joins and ordered scans that hold when one key has a third of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 8


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins ``left`` (any skew) to ``right`` (one row per key): rows of a hot key
    spread over ``salts`` tasks, the one matching row is repeated that often.
    The salt hashes the row, so a rerun of a lost task gives the same rows."""
    spread = [c for c in left.columns if c not in on]
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)) if spread else F.lit(0)
    l = left.withColumn("_salt", salt.cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "_salt"], how).drop("_salt")


def running_totals(df: DataFrame, keys: list[str], order: Column, grid: Column, sums: dict[str, Column]) -> DataFrame:
    """Running sums per key in ``order`` with no task holding a whole key.

    ``grid`` is a cell number that never decreases along ``order`` (a time or
    score bucket). Inside a cell an ordinary window runs; cell totals (a partial
    aggregate: one row per key and cell) give each cell its starting offset."""
    d = df.withColumn("_cell", grid).withColumns({f"_v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_in_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (df.withColumn("_cell", grid).groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
             .select(*keys, "_cell", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums]))
    out = d.join(cells, [*keys, "_cell"])
    return (out.withColumns({n: F.col(f"_in_{n}") + F.col(f"_off_{n}") for n in sums})
            .drop("_cell", *[p + n for n in sums for p in ("_v_", "_in_", "_off_")]))
