"""Imports and exports: schema.org JSON, foreign exports, CSV, evaluation cases."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.functions import amounts as A, text as T
from quern.operators import enrich as E
from quern.sources import pages as PG

EXT = "x-library"      # key of the object that holds a library's own fields
FOREIGN = ("name string, ingredients string, directions string, servings string, prep_time string, cook_time string, total_time string, rating string, "
           "on_favorites string, difficulty string, categories array<string>, notes string, source_url string, created string, _bad string")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(origin, body): one row per file; gzip is read as it is."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("body"))


def from_schema_org(docs: DataFrame, key: str, column: str, now: Column, ext: str = EXT) -> DataFrame:
    return schema_org(docs, key, column, now, ext)[0]


def schema_org(docs: DataFrame, key: str, column: str, now: Column, ext: str = EXT, most_depth: int = PG.MOST_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(records, problems): every Recipe object of the JSON texts as a record; a library's own export gives
    its fields back from the extension object. Problems are (key, problem): what could not be read."""
    v = F.col("v")
    own = lambda f, kind="string": PG.get(v, f"$['{ext}'].{f}", kind)
    has_own = PG.get(v, f"$['{ext}'].version", "string").isNotNull()
    lines = lambda p: F.coalesce(PG.get(v, p, "array<string>"), F.split(PG.get(v, p, "string"), "\n"))
    full = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    full_text = lambda c: F.nullif(F.trim(c), F.lit(""))
    words = F.flatten(F.array_compact(F.array(lines("$.recipeCategory"), lines("$.recipeCuisine"), F.coalesce(PG.get(v, "$.keywords", "array<string>"), F.split(PG.get(v, "$.keywords", "string"), ",")))))
    single = PG.get(v, "$.aggregateRating.ratingCount", "string").isNull()
    found, bad = PG.recipe_objects(docs, key, column, most_depth)
    records = found.select(
        key, F.coalesce(full_text(PG.get(v, "$.name", "string")), F.lit("Untitled Recipe")).alias("title"),
        full(F.coalesce(lines("$.recipeIngredient"), lines("$.ingredients"), F.array().cast("array<string>"))).alias("ingredients"),
        PG.get(v, "$.recipeInstructions", "variant").alias("_steps"), full_text(PG.text_at(v, "$.recipeYield")).alias("servings"),
        *[full_text(F.coalesce(own(c), PG.get(v, p, "string"))).alias(c) for c, p in (("prep_time", "$.prepTime"), ("cook_time", "$.cookTime"), ("total_time", "$.totalTime"))],
        full_text(PG.get(v, "$.url", "string")).alias("source_url"), E.import_date(PG.get(v, "$.dateCreated", "string"), now).alias("created_at"),
        F.coalesce(own("favorite", "boolean"), F.lit(False)).alias("favorite"), F.when(has_own, full_text(own("notes"))).alias("notes"),
        F.when(has_own, E.rating(own("tastiness_rating"))).when(single, E.rating(PG.get(v, "$.aggregateRating.ratingValue", "string"))).alias("tastiness_rating"),
        F.when(~has_own, F.array_distinct(full(words))).alias("labels"))
    made, deep = PG.flat_steps(records, "_steps", "steps", most_depth)
    order = ["steps" if c == "_steps" else c for c in records.columns]
    return made.select(*order), bad.select(key, "problem").unionByName(deep.select(key, "problem"))


def read_foreign(raw: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(good, problems) of JSON lines: a broken record becomes a problem row."""
    d = raw.withColumn("_r", F.from_json(column, FOREIGN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return d.filter(~broken), d.filter(broken).select(*[c for c in raw.columns if c != column], F.lit("not a readable record").alias("problem"))


def from_foreign(good: DataFrame, keep: list[str], now: Column) -> DataFrame:
    """Fields of another app's records: text lines to lists, numbers off the steps."""
    r = lambda f: F.col(f"_r.{f}")
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    full_text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return good.select(
        *keep, F.coalesce(full_text(r("name")), F.lit("Untitled Recipe")).alias("title"), lines(r("ingredients")).alias("ingredients"),
        F.transform(lines(r("directions")), lambda s: F.regexp_replace(s, r"^\s*\d+[.)]\s+", "")).alias("steps"), full_text(r("servings")).alias("servings"),
        *[full_text(r(c)).alias(c) for c in ("prep_time", "cook_time", "total_time")], full_text(r("source_url")).alias("source_url"), full_text(r("notes")).alias("notes"),
        (F.lower(F.coalesce(r("on_favorites"), F.lit(""))).isin("true", "1")).alias("favorite"), E.rating(r("rating")).alias("tastiness_rating"),
        E.difficulty(r("difficulty")).alias("difficulty_rating"), F.transform(F.coalesce(r("categories"), F.array().cast("array<string>")), lambda c: F.trim(c)).alias("categories"),
        E.import_date(r("created"), now).alias("created_at"))


def _sections(steps: Column) -> Column:
    """array<struct<name, steps>>: steps under the part name before them."""
    start = F.array(F.struct(F.lit("").alias("name"), F.array().cast("array<string>").alias("steps")))

    def add(acc, s):
        last = F.element_at(acc, -1)
        more = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["name"].alias("name"), F.array_append(last["steps"], s).alias("steps"))))
        return F.when(T.is_part_name(s), F.array_append(acc, F.struct(F.trim(F.rtrim(F.trim(s), F.lit(":"))).alias("name"), F.array().cast("array<string>").alias("steps")))).otherwise(more)
    full = F.filter(F.transform(steps, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.aggregate(full, start.cast("array<struct<name:string,steps:array<string>>>"), add), lambda x: F.size(x["steps"]) > 0)


def to_schema_org(records: DataFrame, ext: str = EXT) -> DataFrame:
    """records(id, title, ingredients, steps, servings, prep_time, cook_time, total_time,
    source_url, notes, favorite, tastiness_rating, tags, created_at) -> (id, file, body)."""
    parts = F.flatten(F.transform(_sections(F.col("steps")), lambda s: F.when(s["name"] == "", F.transform(s["steps"], lambda t: F.to_json(F.struct(F.lit("HowToStep").alias("@type"), t.alias("text"))))).otherwise(
        F.array(F.to_json(F.struct(F.lit("HowToSection").alias("@type"), s["name"].alias("name"), F.transform(s["steps"], lambda t: F.struct(F.lit("HowToStep").alias("@type"), t.alias("text"))).alias("itemListElement")))))))
    head = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Recipe").alias("@type"), F.col("title").alias("name"), F.col("ingredients").alias("recipeIngredient"),
        F.nullif("servings", F.lit("")).alias("recipeYield"), A.iso_duration(F.col("prep_time")).alias("prepTime"), A.iso_duration(F.col("cook_time")).alias("cookTime"),
        A.iso_duration(F.col("total_time")).alias("totalTime"), F.when(F.size("tags") > 0, F.array_join("tags", ", ")).alias("keywords"),
        F.when(F.col("source_url").rlike("(?i)^https?://"), F.col("source_url")).alias("url"), F.col("notes").alias("description"),
        F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("dateCreated"),
        F.struct(F.lit(1).alias("version"), "notes", "favorite", "tastiness_rating", "prep_time", "cook_time", "total_time").alias(ext)))
    # the closing brace goes by a pattern: cutting by the length would make the object twice
    body = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"recipeInstructions":['), F.array_join(parts, ","), F.lit("]}"))
    return records.select("id", F.concat(T.file_stem(F.col("title"), F.col("id")), F.lit(".json")).alias("file"), body.alias("body"))


def write_export(exported: DataFrame, path: str) -> None:
    """JSON lines in as many part files as tasks; nothing passes the driver."""
    exported.write.mode("overwrite").json(path)


def csv_rows(records: DataFrame, columns: list[str]) -> DataFrame:
    """Cells a spreadsheet would run as formulas are shown as text."""
    return records.select(*[T.safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in records.select(*columns).dtypes])


def write_csv(records: DataFrame, columns: list[str], path: str) -> None:
    csv_rows(records, columns).write.mode("overwrite").option("header", True).csv(path)


def case_rows(records: DataFrame) -> DataFrame:
    """records(id, title, source_type, source_url, raw_text, steps, needs_review,
    deleted_at) -> (id, kind, skipped, case_id): checked live records as evaluation
    cases, or why not."""
    live = records.filter(F.col("deleted_at").isNull() & ~F.coalesce("needs_review", F.lit(False)))
    kind = (F.when(F.col("source_url").isNotNull() & F.col("source_type").isin("url", "email"), "url")
            .when(F.col("source_type").isin("pdf", "document", "screenshot", "email") & (F.trim(F.coalesce("raw_text", F.lit(""))) != ""), "text"))
    d = live.withColumn("kind", kind)
    only = F.coalesce(E.steps_only(F.col("raw_text"), F.col("steps")), F.lit(False))
    skipped = F.when(F.col("kind").isNull(), "no original input kept").when((F.col("kind") == "text") & only, "its text is only its steps")
    return d.select("id", "kind", skipped.alias("skipped"), F.concat(F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("-"), T.slug(F.col("title"))).alias("case_id"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, type, lang, checked, input, expected): case folders of input / expected / meta."""
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("case_id"), F.regexp_extract("_metadata.file_name", r"^(input|expected|meta)\.", 1).alias("part"), "value")
    g = f.filter("part <> ''").groupBy("case_id").agg(*[F.max(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in ("input", "expected", "meta")])
    meta = F.from_json("meta", "type string, language string, checked boolean")
    return g.withColumn("m", meta).filter("m.type IS NOT NULL").select("case_id", "m.type", F.col("m.language").alias("lang"), "m.checked", "input", "expected")
