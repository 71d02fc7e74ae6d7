"""Regression scoring of a case corpus."""
from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from quern.functions import amounts as A, text as T, words as W

TIME_FIELDS = ["prep_time", "cook_time", "total_time"]


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of unequal texts (Ratcliff and Obershelp 1988)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def norm(c: Column) -> Column:
    t = F.translate(F.coalesce(c, F.lit("")), "‘’“”  ", "''\"\"  ")
    return T.squeeze(F.lower(t))


def norm_list(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), norm), lambda x: x != ""), "\n")


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(case_id, field, got, want) of texts (lists joined by new lines) -> score.
    Equal texts and times are settled natively; only the rest go to Python."""
    p = pairs.withColumns({"g": norm(F.col("got")), "w": norm(F.col("want"))})
    lists = F.col("field").isin("ingredients", "steps")
    as_list = lambda c: norm_list(F.split(F.col(c), "\n"))
    p = p.withColumns({"g": F.when(lists, as_list("got")).otherwise(F.col("g")), "w": F.when(lists, as_list("want")).otherwise(F.col("w"))})
    gi, wi = A.iso_duration(F.col("got")), A.iso_duration(F.col("want"))
    timed = F.col("field").isin(TIME_FIELDS) & gi.isNotNull() & wi.isNotNull()
    p = p.withColumn("sure", F.when(timed, (gi == wi).cast("double")).when(F.col("g") == F.col("w"), 1.0).when((F.col("g") == "") | (F.col("w") == ""), 0.0))
    done = p.filter("sure IS NOT NULL").select("case_id", "field", F.col("sure").alias("score"))
    rest = p.filter("sure IS NULL").select("case_id", "field", F.round(_ratio("g", "w"), 4).alias("score"))
    return done.unionByName(rest)


def against_baseline(scores: DataFrame, baseline: DataFrame, tolerance: float = W.TOLERANCE) -> DataFrame:
    """(case_id, field, score, was, status): ok, dropped or new."""
    b = baseline.select("case_id", "field", F.col("score").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("score") < F.col("was") - tolerance, "dropped").otherwise("ok")
    return scores.join(b, ["case_id", "field"], "left").withColumn("status", status)


def report(scores: DataFrame) -> DataFrame:
    """scores(case_id, type, lang, field, score) -> mean and exact share per type,
    language and field, with roll-up rows (null = all)."""
    return scores.rollup("type", "lang", "field").agg(F.avg("score").alias("mean"), F.count_if(F.col("score") == 1).alias("exact"), F.count(F.lit(1)).alias("n"))


def whole_cases(scores: DataFrame) -> DataFrame:
    per = scores.groupBy("case_id").agg(F.min("score").alias("lowest"))
    return per.agg(F.count_if(F.col("lowest") == 1).alias("whole"), F.count(F.lit(1)).alias("cases"))
