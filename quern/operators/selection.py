"""Filters, semi and anti joins, sorts and facets over a record table.

``bridge`` is (recipe_id, tag_name, category): at most one row per record and
tag. Every tag predicate first reduces the bridge to one row per record, so a
tag or a record holding much of the bridge never meets a join unaggregated.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import words as W


def live(records: DataFrame, include_deleted: bool = False) -> DataFrame:
    return records if include_deleted else records.filter(F.col("deleted_at").isNull())


def to_review(records: DataFrame, value: bool | None) -> DataFrame:
    """None: all; true: marked; false: not marked, null counting as not."""
    if value is None:
        return records
    mark = F.coalesce(F.col("needs_review"), F.lit(False))
    return records.filter(mark if value else ~mark)


def pace(records: DataFrame, wanted=(), left_out=()) -> DataFrame:
    c = F.col("cook_time_rating")
    if wanted:
        records = records.filter(c.isin(list(wanted)))
    if left_out:
        records = records.filter(c.isNull() | ~c.isin(list(left_out)))
    return records


def within_minutes(records: DataFrame, minutes: int, leave_out: bool = False) -> DataFrame:
    """Records with a time of at most n minutes; leaving those out keeps the
    ones without a time (0 minutes is no time)."""
    c = F.nullif(F.col("actual_cook_time_minutes"), F.lit(0))
    hit = c.isNotNull() & (c <= minutes)
    return records.filter(~hit if leave_out else hit)


def with_all_tags(records: DataFrame, bridge: DataFrame, names: list[str]) -> DataFrame:
    """Relational division: one aggregate, one semi join."""
    names = list(dict.fromkeys(names))
    full = (bridge.filter(F.col("tag_name").isin(names)).groupBy("recipe_id")
            .agg(F.count_distinct("tag_name").alias("n")).filter(F.col("n") == len(names)))
    return records.join(full, records["id"] == full["recipe_id"], "left_semi")


def without_tags(records: DataFrame, bridge: DataFrame, names: list[str]) -> DataFrame:
    hit = bridge.filter(F.col("tag_name").isin(list(names))).select("recipe_id").distinct()
    return records.join(hit, records["id"] == hit["recipe_id"], "left_anti")


def pick(records: DataFrame, bridge: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """OR inside a category, AND across them; an empty choice restricts nothing."""
    chosen = {c: names for c, names in chosen.items() if names}
    if not chosen:
        return records
    hit = reduce(lambda a, b: a | b, [(F.col("category") == c) & F.col("tag_name").isin(n) for c, n in chosen.items()])
    full = (bridge.filter(hit).groupBy("recipe_id").agg(F.count_distinct("category").alias("n"))
            .filter(F.col("n") == len(chosen)))
    return records.join(full, records["id"] == full["recipe_id"], "left_semi")


def is_forbidden(name: Column, category: Column, subgroup: Column, meal: str, group: str) -> Column:
    return (((category == "meal_type") & (F.lower(F.trim(name)) == meal))
            | ((category == "cooking_style") & (F.coalesce(subgroup, F.lit("")) == group)))


def forbidden_records(bridge: DataFrame, tags: DataFrame, meal: str = "cocktails", group: str = "cocktail") -> DataFrame:
    """Ids of records carrying a tag of the class that is never offered."""
    bad = tags.filter(is_forbidden(F.col("tag_name"), F.col("category"), F.col("subgroup"), meal, group))
    return (bridge.join(bad.select("tag_name", "category"), ["tag_name", "category"], "left_semi")
            .select("recipe_id").distinct())


def without_forbidden(records: DataFrame, forbidden: DataFrame) -> DataFrame:
    return records.join(forbidden, records["id"] == forbidden["recipe_id"], "left_anti")


def check_choices(choices: DataFrame, tags: DataFrame) -> DataFrame:
    """choices(tag_name, sent_as) -> status ok / unknown / wrong_category."""
    known = tags.groupBy("tag_name").agg(F.collect_set("category").alias("cats"))
    return (choices.join(known, "tag_name", "left")
            .select("tag_name", "sent_as",
                    F.when(F.col("cats").isNull(), "unknown")
                    .when(F.array_contains("cats", F.col("sent_as")), "ok")
                    .otherwise("wrong_category").alias("status")))


def sort_keys(sort: str = "created", direction: str = "desc") -> list[Column]:
    """Order-by columns: nulls last in both directions, then id."""
    c = {
        "created": F.col("created_at"), "title": F.lower("title"), "rating": F.col("tastiness_rating"),
        "cook_time": F.nullif(F.col("actual_cook_time_minutes"), F.lit(0)),
        "difficulty": F.when(F.col("difficulty_rating") == "easy", 1).when(F.col("difficulty_rating") == "medium", 2)
                       .when(F.col("difficulty_rating") == "hard", 3),
    }[sort]
    return [c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last(), F.col("id").asc()]


def summary(records: DataFrame) -> DataFrame:
    return records.select("id", "title", "tastiness_rating", (F.length(F.trim(F.coalesce("notes", F.lit("")))) > 0).alias("has_notes"),
                          F.substring(F.trim(F.coalesce("notes", F.lit(""))), 1, 300).alias("snippet"))


def web_link(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^https?://[^/?#]+"), c)


def one_of(c: Column, allowed: list) -> Column:
    return F.when(c.isin(allowed), c)


def facet_counts(records: DataFrame, bridge: DataFrame, tags: DataFrame, forbidden: DataFrame,
                 contents: DataFrame, language: Column, meal: str, group: str) -> DataFrame:
    """(facet, value, n): tags per category, pace, language and the total, over
    records outside the forbidden class. contents: (id, content_text)."""
    offered = without_forbidden(records, forbidden)
    good = tags.filter(~is_forbidden(F.col("tag_name"), F.col("category"), F.col("subgroup"), meal, group))
    tag_facets = (bridge.join(offered.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi")
                  .groupBy(F.col("category").alias("facet"), F.col("tag_name").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                  .join(good.select(F.col("category").alias("facet"), F.col("tag_name").alias("value")),
                        ["facet", "value"], "left_semi"))
    rec_facets = (offered.join(contents, "id", "left")
                  .select(F.inline(F.array(
                      F.struct(F.lit("total").alias("facet"), F.lit("all").alias("value")),
                      F.struct(F.lit("language").alias("facet"), language.alias("value")),
                      F.struct(F.lit("pace").alias("facet"), one_of(F.col("cook_time_rating"), W.PACES).alias("value")))))
                  .filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))
    return tag_facets.unionByName(rec_facets)


def facet_order(facets: DataFrame, seed: list[tuple]) -> DataFrame:
    """Seeded values first in their order, the others alphabetical after them."""
    place = F.create_map(*[F.lit(x) for i, (name, cat, _s) in enumerate(seed) for x in (f"{cat}/{name}", i)])
    rank = F.try_element_at(place, F.concat_ws("/", "facet", "value"))
    return facets.withColumn("seed_rank", F.coalesce(rank, F.lit(len(seed))).cast("bigint")).filter("n > 0")


def minute_buckets(records: DataFrame) -> DataFrame:
    """(minutes, label, hour_group): 20-minute steps to a day, days to a week,
    weeks, then the longest time in whole days. Only the maximum is aggregated."""
    from quern.functions.amounts import minutes_label
    day = 1440
    top = records.agg(F.max("actual_cook_time_minutes").alias("m")).filter("m IS NOT NULL").select(
        F.least(F.greatest(F.ceil(F.col("m") / 20) * 20, F.lit(20)), F.lit(W.MAX_COOK_MINUTES)).cast("bigint").alias("ceiling"))
    c = F.col("ceiling")
    days = F.ceil(c / day).cast("bigint")
    none = F.array().cast("array<bigint>")
    fine = F.sequence(F.lit(20).cast("bigint"), F.least(c, F.lit(day).cast("bigint")), F.lit(20).cast("bigint"))
    daily = F.sequence(F.lit(2).cast("bigint"), F.least(days, F.lit(7).cast("bigint")))
    weekly = F.when(days > 14, F.sequence(F.lit(14).cast("bigint"), days - 1, F.lit(7).cast("bigint"))).otherwise(none)
    coarse = F.when(c > day, F.transform(F.array_union(F.array_union(daily, weekly), F.array(days)), lambda d: d * day)).otherwise(none)
    return top.select(F.explode(F.concat(fine, coarse)).alias("minutes")).select(
        "minutes", minutes_label(F.col("minutes")).alias("label"),
        F.floor((F.col("minutes") - 1) / 60).cast("bigint").alias("hour_group"))


def grouped_listing(records: DataFrame, bridge: DataFrame, tags: DataFrame, category: str) -> DataFrame:
    """One row per (section, group, record); records without a tag of the
    category come last under "Uncategorized"."""
    mine = (bridge.filter(F.col("category") == category)
            .join(tags.filter(F.col("category") == category).select("tag_name", "subgroup"), "tag_name", "left")
            .select(F.col("recipe_id").alias("id"), "tag_name", "subgroup"))
    return (records.select("id", "title").join(mine, "id", "left")
            .select("id", "title", F.coalesce("tag_name", F.lit("Uncategorized")).alias("group_name"),
                    F.when(F.col("tag_name").isNull(), 2).when(F.col("subgroup").isNotNull(), 1).otherwise(0)
                    .cast("bigint").alias("section")))


def library_check(records: DataFrame, items: DataFrame, steps: DataFrame, bridge: DataFrame, files: DataFrame) -> DataFrame:
    """(check_name, id, title) of every record that lacks something. Child tables
    are reduced to their ids before the joins."""
    ids = lambda df, flag: df.select(F.col("recipe_id").alias("id")).distinct().withColumn(flag, F.lit(True))
    names = files.select(F.col("name").alias("image_path")).distinct().withColumn("on_disk", F.lit(True))
    r = (records.select("id", "title", "image_path", "needs_review")
         .join(ids(items, "has_items"), "id", "left").join(ids(steps, "has_steps"), "id", "left")
         .join(ids(bridge, "has_tags"), "id", "left").join(names, "image_path", "left"))
    miss = lambda name, cond: F.when(cond, F.lit(name))
    return r.select("id", "title", F.explode(F.array_compact(F.array(
        miss("no_ingredients", F.col("has_items").isNull()), miss("no_steps", F.col("has_steps").isNull()),
        miss("no_tags", F.col("has_tags").isNull()), miss("no_photo", F.col("image_path").isNull()),
        miss("photo_missing", F.col("image_path").isNotNull() & F.col("on_disk").isNull()),
        miss("to_review", F.col("needs_review"))))).alias("check_name"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """k first rows per key. Spark prunes each partition to k rows per key
    before the shuffle (window group limit), so a hot key is cut down early."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_per_key(df: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """The row with the lowest ``order`` per key, by a partial aggregate."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min_by(F.struct(*payload), F.col(order)).alias("first")).select(key, "first.*"))


def unit_hash(seed: str, c: Column) -> Column:
    """A repeatable number in (0, 1) per id, the same in any engine."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), c.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h + 1) / F.lit(4294967297.0)


def weighted_draw(candidates: DataFrame, shown: DataFrame, seed: str, others: int = 8) -> DataFrame:
    """One record drawn with its rating's weight (exponential keys: the smallest
    -ln(u)/w wins), and up to ``others`` more titles. Two top-k sorts: the
    candidates never gather in one task. (role, id, title, match_count, remaining)."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in W.TASTE_WEIGHTS.items() for x in kv]),
                                         F.col("tastiness_rating").cast("int")), F.lit(1.0))
    left = candidates.join(shown, candidates["id"] == shown["shown_id"], "left_anti")
    drawn = left.orderBy(-F.ln(unit_hash(seed, F.col("id"))) / weight, "id").limit(1)
    rest = (candidates.join(drawn.select(F.col("id").alias("drawn_id")), F.col("id") == F.col("drawn_id"), "left_anti")
            .orderBy(unit_hash(seed + "/others", F.col("id")), "id").limit(others))
    rows = drawn.select(F.lit("drawn").alias("role"), "id", "title").unionAll(rest.select(F.lit("other"), "id", "title"))
    n_left = left.agg(F.count(F.lit(1))).scalar()
    return rows.select("role", "id", "title", candidates.agg(F.count(F.lit(1))).scalar().alias("match_count"),
                       F.greatest(n_left - 1, F.lit(0)).alias("remaining"))
