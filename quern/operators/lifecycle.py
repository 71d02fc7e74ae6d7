"""Soft delete, retention, file housekeeping, limits, redaction, manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import words as W

RETENTION_DAYS = 30


def recently_deleted(records: DataFrame, now: Column) -> DataFrame:
    left = F.expr(f"deleted_at + INTERVAL '{RETENTION_DAYS}' DAY")
    seconds = F.unix_micros(left.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return records.filter("deleted_at IS NOT NULL").select(
        "id", "title", F.greatest(F.lit(0), F.ceil(seconds / 86400000000)).cast("bigint").alias("days_left"))


def expired(records: DataFrame, now: Column) -> DataFrame:
    return records.filter(F.col("deleted_at").isNotNull() & (F.expr(f"deleted_at + INTERVAL '{RETENTION_DAYS}' DAY") < now))


def purge(records: DataFrame, children: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The tables without expired records and their child rows, to be written
    as a new snapshot."""
    gone = expired(records, now).select("id")
    out = {name: df.join(gone.select(F.col("id").alias("recipe_id")), "recipe_id", "left_anti") for name, df in children.items()}
    out["records"] = records.join(gone, "id", "left_anti")
    return out


def restore(records: DataFrame, ids: DataFrame) -> DataFrame:
    back = ids.select("id").distinct().withColumn("back", F.lit(True))
    return records.join(back, "id", "left").withColumn("deleted_at", F.when(F.col("back").isNull(), F.col("deleted_at"))).drop("back")


def fit_limits(records: DataFrame) -> DataFrame:
    """Cut a record (with items and steps arrays) to the storage limits."""
    cols = {c: F.substring(c, 1, n) for c, n in W.FIELD_LIMITS.items() if c in records.columns}
    if "source_url" in records.columns:
        cols["source_url"] = F.when(F.length("source_url") <= W.MAX_URL_CHARS, F.col("source_url"))
    if "items" in records.columns:
        cols["items"] = F.transform(F.slice("items", 1, W.MAX_ITEMS), lambda l: F.substring(l, 1, W.ITEM_LIMITS["raw_line"]))
    if "steps" in records.columns:
        cols["steps"] = F.transform(F.slice("steps", 1, W.MAX_ITEMS), lambda s: F.substring(s, 1, W.MAX_STEP_CHARS))
    return records.withColumns(cols)


def redact(df: DataFrame, policy: dict) -> DataFrame:
    """Columns of the policy replaced by fixed values, with a marker."""
    values = {c: F.lit(v).cast(df.schema[c].dataType) for c, v in policy.items() if c in df.columns}
    return df.withColumns({**values, "redacted": F.lit(True)})


def manifest(records: DataFrame, files: DataFrame) -> DataFrame:
    """One row: live records, referenced and present files, bytes, missing,
    unreferenced. Names are reduced before the one full outer join."""
    want = records.filter("image_path IS NOT NULL").select(F.col("image_path").alias("name")).distinct().withColumn("wanted", F.lit(1))
    have = files.groupBy("name").agg(F.max("bytes").alias("bytes")).withColumn("present", F.lit(1))
    n_live = records.filter("deleted_at IS NULL").agg(F.count(F.lit(1))).scalar()
    both = F.col("wanted").isNotNull() & F.col("present").isNotNull()
    return want.join(have, "name", "full").agg(
        F.count_if(both).alias("files"), F.coalesce(F.sum(F.when(both, F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("present").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unreferenced")
    ).select(n_live.alias("records"), "files", "total_bytes", "missing", "unreferenced")


def validate_snapshot(tables: dict[str, DataFrame], required: dict[str, list[str]], files: DataFrame, safe_name: str) -> DataFrame:
    """(item, value) report rows of a snapshot folder: which required tables lack
    columns, live records and photos, files kept and left out."""
    spark = files.sparkSession
    rows = [(f"table {t}", "ok" if t in tables and set(cols) <= set(tables[t].columns) else "damaged") for t, cols in sorted(required.items())]
    schema_rows = spark.createDataFrame(rows, "item string, value string")
    live = tables["records"].filter("deleted_at IS NULL").agg(F.count(F.lit(1)).alias("live records"), F.count("image_path").alias("photos"))
    kept = files.agg(F.count_if(F.col("name").rlike(safe_name)).alias("files"), F.count_if(~F.col("name").rlike(safe_name)).alias("files left out"))
    flat = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in df.columns])))
    return schema_rows.unionByName(flat(live)).unionByName(flat(kept))


def orphan_files(files: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Files no record (deleted ones included) names and older than a day."""
    named = records.filter("image_path IS NOT NULL").select(F.col("image_path").alias("name")).distinct()
    return files.filter(F.col("modified") < F.expr("INTERVAL '-24' HOUR") + now).join(named, "name", "left_anti")
