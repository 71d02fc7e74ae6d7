"""Enrichment jobs over item lines, texts and messages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import amounts as A, text as T, words as W
from quern.operators import lexicon as LX
from quern.plans.skew import salted_lookup


def per_distinct(df: DataFrame, key: str, enrich) -> DataFrame:
    """Runs ``enrich`` (DataFrame of distinct keys -> key + new columns) once per
    distinct value and brings the columns back to every row. Repeated lines are
    folded by a partial aggregate; the way back is a salted lookup."""
    return salted_lookup(df, enrich(df.select(key).distinct()), [key], "left")


def structured_lines(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Adds quantity, unit, name parsed from the raw line."""
    return A.with_parsed(lines, raw)


def backfill_lines(lines: DataFrame) -> DataFrame:
    """Parses only rows stored unparsed: no quantity, no unit, name = raw line."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    todo = blank("quantity") & blank("unit") & (blank("name") | (F.trim("name") == F.trim("raw_line"))) & (F.trim("raw_line") != "")
    stored = lines.withColumns({"_todo": todo, **{f"_s_{c}": F.col(c) for c in ("quantity", "unit", "name")}})
    return A.with_parsed(stored, "raw_line").withColumns(
        {c: F.when(F.col("_todo"), F.col(c)).otherwise(F.col(f"_s_{c}")) for c in ("quantity", "unit", "name")}).drop(
        "_todo", "_s_quantity", "_s_unit", "_s_name")


# --- keyword tags ----------------------------------------------------------------

def tag_lexicon(spark, extra: DataFrame | None = None) -> DataFrame:
    """(tag_name, category, ord, keyword, rules_out_veg): the built-in keywords, then the
    rows of ``extra`` (same columns, in the order of ``ord`` where it has one), as a user adds them."""
    rows = [(t, c, i, k, t in W.MEAT_TAGS) for c, t, ks in W.TAG_KEYWORDS for i, k in enumerate(ks)]
    base = spark.createDataFrame(rows, "tag_name string, category string, ord int, keyword string, rules_out_veg boolean")
    if extra is None:
        return base
    # rows without an order of their own come after those with one, by a hash and then by keyword
    order = F.col("ord") + 1_000_000 if "ord" in extra.columns else F.pmod(F.xxhash64("keyword"), F.lit(1_000_000)) + 1_000_000_000
    added = extra.select("tag_name", "category", order.cast("int").alias("ord"), "keyword", "rules_out_veg")
    return base.unionByName(added)


def keyword_tags(docs: DataFrame, lexicon: DataFrame, flavouring: str = W.FLAVOURING, tin: str = W.BAKING_TIN,
                 not_vegetarian: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, tag_name, category, keyword); one row per tag
    with the keyword that found it; "Vegetarian" where nothing rules it out."""
    spark = docs.sparkSession
    hay = docs.select("doc_id", T.fold(F.col("text")).alias("hay"))
    main = hay.select("doc_id", F.regexp_replace(F.regexp_replace("hay", flavouring, " "), tin, " ").alias("hay"))
    is_main = F.col("category") == "main_ingredient"
    hits = (LX.keyword_hits(main, "doc_id", "hay", lexicon.filter(is_main))
            .unionByName(LX.keyword_hits(hay, "doc_id", "hay", lexicon.filter(~is_main))))
    meat = lexicon.filter("rules_out_veg").select("tag_name", "category").distinct()
    extra = spark.createDataFrame([("-", "-", i, k) for i, k in enumerate(W.NOT_VEGETARIAN if not_vegetarian is None else not_vegetarian)],
                                  "tag_name string, category string, ord int, keyword string")
    ruled_out = (hits.join(meat, ["tag_name", "category"], "left_semi").select("doc_id")
                 .unionByName(LX.keyword_hits(hay, "doc_id", "hay", extra).select("doc_id"))
                 .unionByName(hay.filter(F.col("hay").rlike(flavouring)).select("doc_id")).distinct())
    veg = docs.select("doc_id").distinct().join(ruled_out, "doc_id", "left_anti").select(
        "doc_id", F.lit("Vegetarian").alias("tag_name"), F.lit("main_ingredient").alias("category"), F.lit(None).cast("string").alias("keyword"))
    return hits.unionByName(veg)


# --- seasons -----------------------------------------------------------------------

def produce_calendar(spark, rows=None) -> DataFrame:
    """(name, mask): bit m-1 set when the produce is in season in month m."""
    rows = W.PRODUCE if rows is None else rows
    return spark.createDataFrame([(n, sum(1 << (m - 1) for m in months)) for n, months in rows], "name string, mask int")


def season_masks(names: DataFrame, key: str, calendar: DataFrame, preserved: str = W.PRESERVED) -> DataFrame:
    """Distinct lines -> (key, mask) for those that name produce."""
    fresh = names.filter(~T.fold(F.col(key)).rlike(preserved))
    bare = F.regexp_replace(F.regexp_replace(key, r"\([^)]*\)|\[[^\]]*\]", " "), r"^[\s\d.,/¼-¾⅐-⅞-]+", " ")
    part = F.element_at(F.split(bare, W.NAME_END, 2), 1)
    return LX.annotate(fresh, key, T.fold(part), calendar, "name", ["mask"])


def record_masks(lines: DataFrame, rec: str, line: str, calendar: DataFrame, preserved: str = W.PRESERVED) -> DataFrame:
    """(rec, mask): months any line of the record is in season."""
    masked = per_distinct(lines.select(rec, line), line, lambda d: season_masks(d, line, calendar, preserved))
    return masked.groupBy(rec).agg(F.bit_or(F.coalesce("mask", F.lit(0))).alias("mask"))


def season_records(masks: DataFrame, rec: str, month: int) -> DataFrame:
    return masks.filter(F.getbit("mask", F.lit(month - 1)) == 1).select(rec)


def in_season(records: DataFrame, masks: DataFrame, rec: str, month: int, keep: bool = True) -> DataFrame:
    hit = season_records(masks, rec, month).withColumnRenamed(rec, "_rec")
    return records.join(hit, records["id"] == hit["_rec"], "left_semi" if keep else "left_anti")


# --- volumes and masses ---------------------------------------------------------------

def densities(spark, rows=None) -> DataFrame:
    rows = W.GRAMS_PER_CUP if rows is None else rows
    return spark.createDataFrame(rows, "name string, grams_per_cup double")


def _with_density(lines: DataFrame, line: str, with_unit, table: DataFrame) -> DataFrame:
    d = with_unit(A.with_leading(lines, line))
    # distributive "each" has no single name
    part = F.when(~F.col("_after").rlike(r"(?i)^\s*(?:each|chacun|chacune)\b"), A.name_part(F.col("_after")))
    d = d.withColumn("_name", T.fold(F.coalesce(part, F.lit(""))))
    # no filter on _name: pushed down, it would repeat the expressions above it
    names = d.select("_name").distinct()
    hit = LX.annotate(names, "_name", F.col("_name"), table, "name", ["name", "grams_per_cup"])
    changed = F.col("_name").rlike(r"(?:^|[^a-z0-9])(?<!non[\s-])(?:cooked|cuite?s?|whipped|fouettee?s?|substitutes?|substitut|succedane)(?![a-z0-9])")
    hit = hit.withColumn("grams_per_cup", F.when(~(changed & ~F.col("name").rlike("cooked|whipped")), F.col("grams_per_cup")))
    d = salted_lookup(d, hit.withColumnRenamed("name", "ingredient"), ["_name"], "left")
    return d.withColumn("_ok", F.coalesce(F.col("_factor").isNotNull() & F.col("grams_per_cup").isNotNull() & ~F.col("_odd") & ~F.col("_second"), F.lit(False)))


_SCRATCH = [*A.LEADING_COLUMNS, "_factor", "_after", "_name", "_ok"]


def to_grams(lines: DataFrame, line: str, table: DataFrame) -> DataFrame:
    """Adds ingredient, grams_low, grams_high and kept (a volume that cannot be weighed)."""
    d = _with_density(lines, line, A.with_volume_unit, table)
    g = lambda v: F.when(F.col("_ok"), F.col(v) * F.col("_factor") * F.col("grams_per_cup"))
    return d.withColumns({"grams_low": g("_low"), "grams_high": g("_high"), "kept": F.col("_factor").isNotNull() & ~F.col("_ok")}).drop(*_SCRATCH)


def to_volume(lines: DataFrame, line: str, table: DataFrame, lang: str = "en") -> DataFrame:
    """Adds cups, kitchen_unit, kitchen_amount and kept (a weight without density)."""
    d = _with_density(lines, line, A.with_weight_unit, table)
    cups = F.when(F.col("_ok") & (F.col("_low") > 0), F.col("_low") * F.col("_factor") / F.col("grams_per_cup"))
    d = d.withColumns({"cups": cups, "_w": F.col("_factor").isNotNull()}).drop(*_SCRATCH)
    d = d.withColumns({"kept": F.col("_w") & F.col("cups").isNull(), "kitchen_unit": F.when(F.col("cups").isNotNull(), A.kitchen_unit(F.col("cups"), lang))})
    return d.withColumn("kitchen_amount", F.when(F.col("cups").isNotNull(), A.kitchen_amount(F.col("cups"), F.col("kitchen_unit"), lang))).drop("_w")


def scaled(lines: DataFrame, line: str, factor: float) -> DataFrame:
    """Adds low, high (times the factor), shown and kept (left as written)."""
    d = A.with_leading(lines, line)
    kept = F.col("_rest").isNotNull() & (F.col("_odd") | (~F.col("_times") & F.col("_second")))
    d = d.withColumn("kept", F.coalesce(kept, F.lit(False)))
    ok = F.col("_rest").isNotNull() & ~F.col("kept")
    d = d.withColumns({"low": F.when(ok, F.col("_low") * factor), "high": F.when(ok, F.col("_high") * factor)})
    d = d.withColumns({"_a": A.show_amount(F.col("low"), F.col("_low_text")), "_b": A.show_amount(F.col("high"), F.col("_high_text"))})
    shown = F.concat("_lead", "_a", F.when(F.col("high").isNotNull(), F.concat("_sep", "_b")).otherwise(""), "_rest")
    return d.withColumn("shown", F.coalesce(F.when(F.col("low").isNotNull(), shown), F.col(line))).drop(*A.LEADING_COLUMNS, "_a", "_b")


# --- quality -----------------------------------------------------------------------------

def findings(items: DataFrame, steps: DataFrame, records: DataFrame, uncertain: DataFrame | None = None) -> DataFrame:
    """(id, kind, idx, reason) of everything worth a look. items(id, idx, line,
    quantity), steps(id, idx, text), records(id, servings, confidence, raw_text,
    from_text); uncertain(id, line) marks lines a model was unsure of."""
    marked = lambda df, c: (df.withColumn("unsure", F.lit(False)) if uncertain is None else
                            df.join(uncertain.select("id", F.col("line").alias(c)).distinct().withColumn("u", F.lit(True)), ["id", c], "left")
                            .withColumn("unsure", F.coalesce("u", F.lit(False))))
    i = marked(items, "line").filter(~T.is_part_name(F.col("line")))
    no_amount = (F.coalesce(F.col("quantity"), F.lit("")) == "") & ~F.col("line").rlike(W.HAS_AMOUNT) & ~F.col("line").rlike(W.NO_AMOUNT_OK)
    item_rows = i.select("id", F.lit("item").alias("kind"), "idx", F.when(no_amount, "no_amount").when(F.col("unsure"), "uncertain").alias("reason"))
    s = marked(steps, "text").filter(~T.is_part_name(F.col("text")))
    step_rows = s.select("id", F.lit("step").alias("kind"), "idx",
                         F.when(F.length(F.trim("text")) < 12, "short").when(F.length("text") > 700, "long").when(F.col("unsure"), "uncertain").alias("reason"))
    r = records.select("id", F.explode(F.array_compact(F.array(
        F.when(F.trim(F.coalesce("servings", F.lit(""))) == "", "servings_missing"),
        F.when(F.col("confidence") < 80, "low_confidence"),
        F.when(F.col("from_text") & T.text_was_cut(F.col("raw_text")), "text_cut"),
        F.when(F.col("from_text"), "title_guessed")))).alias("reason"))
    rec_rows = r.select("id", F.lit("record").alias("kind"), F.lit(None).cast("bigint").alias("idx"), "reason")
    return item_rows.unionByName(step_rows).filter("reason IS NOT NULL").unionByName(rec_rows)


def missing_parts(items: Column, steps: Column) -> Column:
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return F.array_compact(F.array(F.when(empty(items), "ingredients"), F.when(empty(steps), "steps")))


def steps_only(raw: Column, steps: Column) -> Column:
    """The text is nothing but the record's own steps."""
    norm = lambda c: T.squeeze(F.lower(c))
    full = lambda a: F.filter(F.transform(a, norm), lambda x: x != "")
    lines, saved = full(F.split(raw, "\n")), full(steps)
    return (F.size(lines) > 0) & (F.size(saved) > 0) & F.forall(lines, lambda l: F.array_contains(saved, l))


def scan_confidence(pages: DataFrame, doc: str, conf: str) -> DataFrame:
    """Mean confidence per document over the pages that have one, whether all
    have, and whether a message import would refuse it."""
    return pages.groupBy(doc).agg(F.avg(conf).alias("mean_conf"), (F.count(conf) == F.count(F.lit(1))).alias("fully_scanned")).withColumn(
        "too_poor", F.coalesce(F.col("mean_conf") < W.MIN_MESSAGE_CONFIDENCE, F.lit(False)))


# --- coercions of imported values -----------------------------------------------------------

def rating(c: Column) -> Column:
    n = F.rint(c.try_cast("double")).try_cast("int")
    return F.when(n.between(1, 5), n)


def difficulty(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in W.DIFFICULTY_WORDS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.trim(c)))


def import_date(c: Column, now: Column) -> Column:
    """ISO dates as UTC timestamps, not before 1990 and not after ``now``."""
    t = F.try_to_timestamp(F.when(F.trim(c).rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.trim(c)))
    return F.when((t >= F.lit("1990-01-01").cast("timestamp")) & (t <= now), t)
