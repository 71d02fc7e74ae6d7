"""Tag set operations, merges and copies."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.functions import words as W


def batch_tag(records: DataFrame, bridge: DataFrame, ids: DataFrame, tag: str, category: str, action: str = "add",
              max_tags: int = W.MAX_TAGS) -> tuple[DataFrame, DataFrame]:
    """(report, new bridge) of adding or removing one tag on many records.
    report: (id, status) with changed, unchanged, full or missing."""
    is_tag = (F.col("tag_name") == tag) & (F.col("category") == category)
    state = (bridge.groupBy(F.col("recipe_id").alias("id"))
             .agg(F.count(F.lit(1)).alias("n"), F.max(is_tag).alias("has")))
    live = records.select("id", F.lit(True).alias("here"))
    r = ids.select("id").distinct().join(live, "id", "left").join(state, "id", "left")
    has, n = F.coalesce("has", F.lit(False)), F.coalesce("n", F.lit(0))
    if action == "add":
        status = F.when(has, "unchanged").when(n >= max_tags, "full").otherwise("changed")
    else:
        status = F.when(has, "changed").otherwise("unchanged")
    report = r.select("id", F.when(F.col("here").isNull(), "missing").otherwise(status).alias("status"))
    changed = report.filter("status = 'changed'").select(F.col("id").alias("recipe_id"))
    row = changed.select("recipe_id", F.lit(tag).alias("tag_name"), F.lit(category).alias("category"))
    new = bridge.unionByName(row) if action == "add" else bridge.join(row, ["recipe_id", "tag_name", "category"], "left_anti")
    return report, new


def auto_apply(records: DataFrame, bridge: DataFrame, suggested: DataFrame, meats: list[str],
               picks: DataFrame | None = None) -> DataFrame:
    """Suggested tags a record lacks: (recipe_id, tag_name, category). Ignored
    records take none; "Vegetarian" not where a meat tag is; picks (recipe_id,
    tag_name) keep only what was ticked."""
    open_ids = records.filter(~F.coalesce("autotag_ignored", F.lit(False))).select(F.col("id").alias("recipe_id"))
    meat = (bridge.filter((F.col("category") == "main_ingredient") & F.col("tag_name").isin(meats)).select("recipe_id").distinct()
            .withColumn("has_meat", F.lit(True)))
    new = (suggested.select("recipe_id", "tag_name", "category").join(open_ids, "recipe_id", "left_semi")
           .join(bridge, ["recipe_id", "tag_name", "category"], "left_anti").join(meat, "recipe_id", "left")
           .filter(~((F.col("tag_name") == "Vegetarian") & F.coalesce("has_meat", F.lit(False)))).drop("has_meat"))
    return new if picks is None else new.join(picks, ["recipe_id", "tag_name"], "left_semi")


def combine_suggestions(keyword: DataFrame, learned: DataFrame, known: DataFrame, meats: list[str]) -> DataFrame:
    """keyword and learned: (doc_id, tag_name, category, why). Learned tags must
    exist and be new; a meat withdraws "Vegetarian", learned or not. One aggregate
    per record carries the meat flags; no record is gathered."""
    fresh = (learned.join(known, ["tag_name", "category"], "left_semi")
             .join(keyword.select("doc_id", "tag_name", "category"), ["doc_id", "tag_name", "category"], "left_anti"))
    both = keyword.withColumn("learned", F.lit(False)).unionByName(fresh.withColumn("learned", F.lit(True)))
    veg = (F.col("tag_name") == "Vegetarian") & (F.col("category") == "main_ingredient")
    meat = F.col("tag_name").isin(meats)
    flags = both.groupBy("doc_id").agg(F.max(meat).alias("any_meat"), F.max(veg & ~F.col("learned")).alias("keyword_veg"))
    return (both.join(flags, "doc_id")
            .filter(~(veg & F.col("any_meat")) & ~(veg & F.col("learned") & ~F.col("keyword_veg")))
            .select("doc_id", "tag_name", "category", "why"))


def remove_tags(bridge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridge without the tags, number of records touched)."""
    touched = bridge.join(gone, ["tag_name", "category"], "left_semi").agg(F.count_distinct("recipe_id").alias("touched"))
    return bridge.join(gone, ["tag_name", "category"], "left_anti"), touched


def repair_categories(bridge: DataFrame, known: list[str]) -> DataFrame:
    """Tags of an unknown category move to "custom", folding with one there."""
    return bridge.withColumn("category", F.when(F.col("category").isin(known), F.col("category")).otherwise("custom")).distinct()


def copy_records(records: DataFrame, picked) -> DataFrame:
    """Copies of the picked records with new ids and cleared marks."""
    suffix = " (copy)"
    top = records.agg(F.max("id")).scalar()
    return records.filter(picked).select(
        (F.col("id") + top + 1).alias("id"), F.col("id").alias("copied_from"),
        F.concat(F.substring("title", 1, 500 - len(suffix)), F.lit(suffix)).alias("title"), "source_url", "tastiness_rating",
        F.lit(False).alias("favorite"), F.lit(False).alias("needs_review"))


def merge_pairs(pairs: DataFrame, records: DataFrame, bridge: DataFrame, take: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """pairs(keep_id, other_id) -> (merged, refused). ``take`` names per part whose
    it is: title, photo, content, source, ratings: keep / other; notes also both."""
    side = lambda p: records.select(*[F.col(c).alias(f"{p}_{c}") for c in records.columns])
    j = pairs.join(side("keep"), "keep_id").join(side("other"), "other_id")
    got = lambda part, c: F.col(f"{'other' if take.get(part) == 'other' else 'keep'}_{c}")
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    notes = (F.concat_ws("\n\n", clean("keep_notes"), clean("other_notes")) if take.get("notes") == "both"
             else got("notes", "notes"))
    # tag lists of the pairs only: both sides in one pass over the bridge
    ids = pairs.select("keep_id", F.explode(F.array("keep_id", "other_id")).alias("recipe_id"))
    tags = (bridge.join(ids, "recipe_id").select("keep_id", "tag_name", "category").distinct().groupBy("keep_id")
            .agg(F.count(F.lit(1)).alias("n_tags"), F.array_join(F.array_sort(F.collect_list("tag_name")), " ").alias("tags_text")))
    photo = F.lit(None).cast("string") if take.get("photo") == "none" else got("photo", "image_path")
    link, kind = got("source", "source_url"), got("content", "source_type")
    m = j.join(tags, "keep_id", "left").select(
        F.col("keep_id").alias("id"), "other_id", got("title", "title").alias("title"), photo.alias("image_path"), kind.alias("source_type"),
        F.when(link.isNull() & (kind == "url"), got("content", "source_url")).otherwise(link).alias("source_url"),
        got("ratings", "favorite").alias("favorite"), got("ratings", "tastiness_rating").alias("tastiness_rating"),
        F.nullif(notes, F.lit("")).alias("notes"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"),
        F.coalesce("tags_text", F.lit("")).alias("tags_text"), F.lit(False).alias("needs_review"))
    over = F.when(F.length(F.coalesce("notes", F.lit(""))) > W.NOTES_MAX, "notes too long").when(F.col("n_tags") > W.MAX_TAGS, "too many tags")
    m = m.withColumn("refused", over)
    return m.filter("refused IS NULL").drop("refused"), m.filter("refused IS NOT NULL").select("id", "other_id", "refused")


def match_labels(labels: DataFrame, tags: DataFrame, keep_unknown: bool) -> DataFrame:
    """labels(doc_id, label) -> (doc_id, tag_name, category): an existing tag by
    name in any case (first by tag order wins), else a custom tag if kept."""
    known = (tags.groupBy(F.lower("tag_name").alias("lname"))
             .agg(F.min_by(F.struct("tag_name", "category"), F.struct("category", "tag_name")).alias("t")))
    j = labels.withColumn("lname", F.lower("label")).join(known, "lname", "left")
    if not keep_unknown:
        j = j.filter("t IS NOT NULL")
    return j.select("doc_id", F.coalesce("t.tag_name", "label").alias("tag_name"), F.coalesce("t.category", F.lit("custom")).alias("category")).distinct()


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Latest state: a field present in the change log overwrites, null included;
    an absent one keeps the snapshot's value. changes: (key, field, value), one
    row per field (see dedupe.latest)."""
    sent = changes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("sent"))
    j = snapshot.join(sent, key, "left")
    pick = lambda f: F.when(F.coalesce(F.map_contains_key("sent", F.lit(f)), F.lit(False)), F.try_element_at("sent", F.lit(f))["value"]).otherwise(F.col(f))
    return j.select(key, *[pick(f).alias(f) for f in fields])
