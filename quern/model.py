"""The tables the operators read: a recipe library laid over the given parquet
tables, and the same views as SQL text for the DuckDB twin of each query."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# one expression per column, valid in Spark SQL and in DuckDB
RECIPE_COLUMNS = {
    "id": "o_orderkey",
    "title": "c_mktsegment || ' no. ' || CAST(o_orderkey - o_orderkey % 3 AS STRING)",
    "source_url": """CASE WHEN o_orderkey % 5 = 0 THEN
   CASE WHEN o_orderkey % 10 = 0 THEN 'https://www.example.com/r/' ELSE 'http://example.com/r/' END
   || CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) AS STRING)
   || CASE WHEN o_orderkey % 15 = 0 THEN '/?utm_source=mail' ELSE '' END END""",
    "source_type": """CASE o_orderkey % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'pdf' WHEN 2 THEN 'screenshot'
   WHEN 3 THEN 'manual' ELSE 'email' END""",
    "favorite": "o_orderkey % 7 = 0",
    "needs_review": "CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus = 'P' END",
    "deleted_at": "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '20' DAY END",
    "tastiness_rating": "NULLIF(o_orderkey % 6, 0)",
    "cook_time_rating": """CASE o_orderpriority WHEN '1-URGENT' THEN 'quick' WHEN '2-HIGH' THEN 'moderate'
   WHEN '3-MEDIUM' THEN 'moderate' WHEN '5-LOW' THEN 'long' END""",
    "difficulty_rating": "CASE o_orderkey % 4 WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' WHEN 3 THEN 'hard' END",
    "actual_cook_time_minutes":
        "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(FLOOR(o_totalprice) AS BIGINT) % 2880 END",
    "image_path": "CASE WHEN o_orderkey % 4 = 1 THEN 'photo-' || CAST(o_orderkey AS STRING) || '.jpg' END",
    "notes": """CASE o_orderkey % 9 WHEN 1 THEN ' keep ' || CAST(o_orderkey AS STRING)
   WHEN 2 THEN '  ' END""",
    "created_at": "o_orderdate",
}
_RECIPE = ("SELECT " + ",\n ".join(f"{e} AS {n}" for n, e in RECIPE_COLUMNS.items())
           + "\nFROM orders JOIN customer ON c_custkey = o_custkey")

_INGREDIENT = """
SELECT l_orderkey AS recipe_id,
 CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) - 1 AS position,
 CAST(l_quantity AS BIGINT) AS quantity,
 CASE l_partkey % 8 WHEN 0 THEN 'cup' WHEN 1 THEN 'tbsp' WHEN 2 THEN 'tsp' WHEN 3 THEN 'g' WHEN 4 THEN 'kg' WHEN 5 THEN 'oz' WHEN 6 THEN 'lb' ELSE 'ml' END AS unit,
 p_name AS name
FROM lineitem JOIN part ON p_partkey = l_partkey"""

VIEWS: dict[str, str] = {
    "v_recipe": _RECIPE,
    "v_live": "SELECT * FROM v_recipe WHERE deleted_at IS NULL",
    "v_ingredient": _INGREDIENT,
    "v_line": """
SELECT recipe_id, position, name, CAST(quantity AS STRING) || ' ' || unit || ' ' || name AS raw_line FROM v_ingredient""",
    "v_recipe_tag": """
SELECT DISTINCT l_orderkey AS recipe_id, p_type AS tag_name, 'meal_type' AS category FROM lineitem JOIN part ON p_partkey = l_partkey
UNION SELECT DISTINCT l_orderkey, p_brand, 'main_ingredient' FROM lineitem JOIN part ON p_partkey = l_partkey
UNION SELECT DISTINCT l_orderkey, l_returnflag, 'cooking_style' FROM lineitem""",
    "v_tag": """
SELECT tag_name, category, CASE WHEN category = 'cooking_style' AND tag_name = 'A' THEN 'cocktail' END AS subgroup
FROM (SELECT DISTINCT tag_name, category FROM v_recipe_tag)""",
    "v_forbidden": """
SELECT DISTINCT recipe_id FROM v_recipe_tag JOIN v_tag USING (tag_name, category)
WHERE (category = 'meal_type' AND lower(trim(tag_name)) = 'promo') OR (category = 'cooking_style' AND subgroup = 'cocktail')""",
    "v_step": "SELECT conv_id AS recipe_id, turn AS position, text FROM conversations",
    "v_change": "SELECT event_id, ts, user_id AS entity_id, event_type AS kind, value FROM events",
    "v_file": """
SELECT 'photo-' || CAST(o_orderkey AS STRING) || '.jpg' AS name, CAST(FLOOR(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS modified
FROM orders WHERE o_orderkey % 8 IN (1, 3)""",
}


def _used(sql: str, seen: list[str]) -> list[str]:
    for name, text in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _used(text, seen)
            seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """An oracle query with the views it names as opening CTEs."""
    names = _used(sql, [])
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


CHILD_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


class Library:
    """DataFrames of one library folder. Nothing is read until an action."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def recipes(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
        return joined.select(*[F.expr(e).alias(n) for n, e in RECIPE_COLUMNS.items()])

    def live(self) -> DataFrame:
        return self.recipes().filter("deleted_at IS NULL")

    def lines(self) -> DataFrame:
        """Ingredient rows without their position: no window, no extra shuffle.
        ``ord`` sorts them inside a record."""
        li, part = self.table("lineitem"), self.table("part")
        unit = F.element_at(F.array(*map(F.lit, ["cup", "tbsp", "tsp", "g", "kg", "oz", "lb", "ml"])),
                            (F.col("l_partkey") % 8 + 1).cast("int"))
        q = F.col("l_quantity").cast("bigint")
        return (li.join(part, F.col("p_partkey") == F.col("l_partkey"))
                .select(F.col("l_orderkey").alias("recipe_id"), F.struct(*CHILD_ORDER).alias("ord"),
                        q.alias("quantity"), unit.alias("unit"), F.col("p_name").alias("name"),
                        F.concat_ws(" ", q.cast("string"), unit, "p_name").alias("raw_line")))

    def ingredients(self) -> DataFrame:
        """Ingredient rows with their 0-based position. A record holds at most
        a few hundred rows (the item limit), so its window is small."""
        w = Window.partitionBy("recipe_id").orderBy("ord")
        return self.lines().select("recipe_id", (F.row_number().over(w).cast("bigint") - 1).alias("position"),
                                   "quantity", "unit", "name", "raw_line")

    def recipe_tags(self) -> DataFrame:
        """One pass over the items instead of a union of three."""
        li, part = self.table("lineitem"), self.table("part")
        pair = lambda c, cat: F.struct(F.col(c).alias("tag_name"), F.lit(cat).alias("category"))
        return (li.join(part, F.col("p_partkey") == F.col("l_partkey"))
                .select(F.col("l_orderkey").alias("recipe_id"), F.inline(F.array(
                    pair("p_type", "meal_type"), pair("p_brand", "main_ingredient"),
                    pair("l_returnflag", "cooking_style"))))
                .distinct())

    def tags(self) -> DataFrame:
        sub = F.when((F.col("category") == "cooking_style") & (F.col("tag_name") == "A"), "cocktail")
        return self.recipe_tags().select("tag_name", "category").distinct().withColumn("subgroup", sub)

    def steps(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("recipe_id"),
                                                  F.col("turn").alias("position"), "text")

    def changes(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", F.col("user_id").alias("entity_id"),
                                           F.col("event_type").alias("kind"), "value")

    def files(self) -> DataFrame:
        return (self.table("orders").filter(F.col("o_orderkey") % 8 % 2 == 1).filter(F.col("o_orderkey") % 8 <= 3)
                .select(F.concat(F.lit("photo-"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("name"),
                        F.floor("o_totalprice").cast("bigint").alias("bytes"), F.col("o_orderdate").alias("modified")))

    def documents(self) -> DataFrame:
        return self.table("documents")

    def pages(self) -> DataFrame:
        return self.table("pages")
