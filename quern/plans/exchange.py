"""Pages, imports and exports."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.library import now
from quern.plans.registry import plan
from quern.session import checkpoint_dir
from quern.sources import cases as CS, exchange as X, pages as PG

_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def dressed(lib):
    """Pages with a recipe added: structured data on every second, headings on the next."""
    k = F.col("page_id")
    q = F.lit('"')
    name = F.concat(F.lit("Dish "), k.cast("string"))
    step = lambda t: F.struct(F.lit("HowToStep").alias("@type"), t.alias("text"))
    recipe = F.to_json(F.struct(F.lit("Recipe").alias("@type"), name.alias("name"), F.array(F.lit("2 cups <b>flour</b>"), F.concat(k.cast("string"), F.lit(" g salt"))).alias("recipeIngredient"),
                                F.array(F.struct(F.lit("HowToSection").alias("@type"), F.lit("Dough").alias("name"), F.array(step(F.lit("Mix &amp; rest.")), step(F.lit("Bake."))).alias("itemListElement"))).alias("recipeInstructions"),
                                F.array(F.lit("4 loaves")).alias("recipeYield")))
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage","name":'), q, F.lit("x"), q, F.lit('},'), recipe, F.lit("]}"))
    data = F.concat(F.lit('<script type="application/ld+json">'), F.when(k % 4 == 0, recipe).otherwise(graph), F.lit("</script>"))
    heads = F.concat(F.lit("<h2>Ingr&eacute;dients</h2>".replace("&eacute;", "é")), F.lit("<ul><li>1 egg</li><li>2 cups rice</li></ul><h3>Preparation time 5 min</h3><p>no</p><h2>Directions</h2><p>Cook the rice.</p><p>Add the egg.</p><h2>More</h2>"))
    body = F.when(k % 2 == 0, data).when(k % 4 == 1, heads).otherwise("")
    return lib.pages().select("page_id", F.concat(F.regexp_replace("html", "(?s)<body>.*", ""), F.lit("<body>"), body, F.regexp_replace("html", "(?s)^.*<body>", "")).alias("html"))


@plan("src2_structured_pages", "SELECT page_id, 'Dish ' || page_id AS title, '2 cups flour|' || page_id || ' g salt' AS ingredients, 'Dough:|Mix & rest.|Bake.' AS steps, '4 loaves' AS servings FROM pages WHERE page_id % 2 = 0")
def _(lib):
    return PG.from_structured(dressed(lib)).select("page_id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), "servings")


@plan("src3_heading_pages", "SELECT page_id, '1 egg|2 cups rice' AS ingredients, 'Cook the rice.|Add the egg.' AS steps FROM pages WHERE page_id % 4 = 1")
def _(lib):
    return PG.from_headings(dressed(lib)).filter(F.size("ingredients") > 0).select("page_id", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"))


@plan("src4_tier_fallback", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'structured' ELSE 'headings' END AS method FROM pages WHERE page_id % 4 <> 3")
def _(lib):
    return PG.records(dressed(lib)).select("page_id", "method")


@plan("src5_flat_instructions", "SELECT conv_id, turn, 'Part ' || turn || ':|' || role || '|Stir.|Serve.' AS steps FROM conversations")
def _(lib):
    step = lambda t: F.struct(F.lit("HowToStep").alias("@type"), t.alias("text"))
    sec = F.to_json(F.struct(F.concat(F.lit("Part "), F.col("turn").cast("string"), F.lit(":")).alias("name"), F.array(step(F.col("role")), step(F.lit("Stir."))).alias("itemListElement")))
    v = F.parse_json(F.concat(F.lit("["), sec, F.lit(',"Serve."]')))
    return PG.flat_steps(lib.table("conversations").select("conv_id", "turn", v.alias("v")), "v")[0].select("conv_id", "turn", F.array_join("steps", "|").alias("steps"))


def nested_turns(lib):
    """(conv_id, json): a conversation as instructions; each turn is a section inside the section of the turn before it, the first one
    inside as many lists as the number modulo 40, and every fifth one holds a single object in place of a list."""
    c = lib.table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text")), asc=False).alias("ts"))
    step = F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), F.to_json(F.struct(F.lit("HowToStep").alias("@type"), t["text"].alias("text"))).alias("step"),
                                                F.to_json(F.struct(F.concat(t["role"], F.lit(" "), t["turn"].cast("string"), F.lit(":")).alias("n"))).alias("head")))

    def around(acc, t):
        inner = F.when(acc == "", F.when(t["turn"] % 5 == 0, t["step"]).otherwise(F.concat(F.lit("["), t["step"], F.lit("]")))).otherwise(
            F.concat(F.lit("["), t["step"], F.lit(","), acc, F.lit("]")))
        return F.concat(F.lit('{"@type":["HowToSection"],"name":'), F.expr("''"), F.regexp_replace(t["head"], r'^\{"n":(.*)\}$', "$1"), F.lit(',"itemListElement":'), inner, F.lit("}"))
    k = (F.col("conv_id") % 40).cast("int")
    return c.withColumn("steps", step).select("conv_id", F.concat(F.repeat(F.lit("["), k), F.aggregate("steps", F.lit(""), around), F.repeat(F.lit("]"), k)).alias("json"))


_NESTED = r"""
WITH t AS (SELECT conv_id, turn, [role || ' ' || turn || ':'] || list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM conversations)"""


@plan("src5_deep_sections", _NESTED + " SELECT conv_id, array_to_string(flatten(list(lines ORDER BY turn)), '|') AS steps FROM t GROUP BY conv_id")
def _(lib):
    made, _bad = PG.flat_steps(nested_turns(lib).select("conv_id", F.try_parse_json("json").alias("v")), "v")
    return made.select("conv_id", F.array_join("steps", "|").alias("steps"))


@plan("src5_too_deep", """
SELECT conv_id, 'lists or sections inside each other beyond 30' AS problem FROM conversations GROUP BY conv_id
HAVING conv_id % 40 + count(*) > 30""")
def _(lib):
    return PG.flat_steps(nested_turns(lib).select("conv_id", F.try_parse_json("json").alias("v")), "v", most_depth=30)[1]


def nested_pages(lib):
    """Pages with one recipe of the page's title, inside as many lists, graphs and main entities as the number modulo 25."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    recipe = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.concat(title, F.lit(" "), k.cast("string")).alias("name"), F.array(F.concat(k.cast("string"), F.lit(" g salt"))).alias("recipeIngredient"),
                                F.array(F.array(F.col("url"))).alias("recipeInstructions")))

    def around(acc, i):
        return (F.when(i % 3 == 0, F.concat(F.lit("["), acc, F.lit("]"))).when(i % 3 == 1, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), acc, F.lit("]}")))
                .otherwise(F.concat(F.lit('{"@type":"WebPage","mainEntity":'), acc, F.lit("}"))))
    depth = (k % 25).cast("int")
    nested = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(24)), F.lit(1), depth), recipe, around)
    data = F.concat(F.lit('<script type="application/ld+json">'), F.when(k % 50 == 7, F.lit('{"@type":"Recipe", broken')).otherwise(nested), F.lit("</script>"))
    return lib.pages().select("page_id", F.concat("html", data).alias("html"))


_PAGE_LINES = r"""
WITH p AS (SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') || ' ' || page_id, '\s+', ' ', 'g')) AS title, url FROM pages)"""


@plan("src2_nested_objects", _PAGE_LINES + " SELECT page_id, title, page_id || ' g salt' AS ingredients, url AS steps FROM p WHERE page_id % 50 <> 7")
def _(lib):
    return PG.from_structured(nested_pages(lib)).select("page_id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"))


@plan("src2_problems", """
SELECT page_id, CASE WHEN page_id % 50 = 7 THEN 'not readable as JSON' ELSE 'lists or graphs inside each other beyond 20' END AS problem FROM pages
WHERE page_id % 50 = 7 OR page_id % 25 > 20""")
def _(lib):
    return PG.structured(nested_pages(lib), most_depth=20)[1].distinct()


@plan("src6_schema_org_import", """
SELECT o_orderkey AS id, 'Dish ' || o_orderkey AS title, '1 egg|2 cups ' || o_orderpriority AS ingredients, 'Mix.|Bake.' AS steps, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 5 THEN o_orderkey % 7 END AS rating, 'Lunch|quick' AS labels FROM orders""")
def _(lib):
    k = F.col("o_orderkey")
    obj = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("Recipe")).alias("@type"), F.concat(F.lit("Dish "), k.cast("string")).alias("name"),
                             F.concat(F.lit("1 egg\n2 cups "), "o_orderpriority", F.lit("\n")).alias("recipeIngredient"), F.lit("Mix.\nBake.").alias("recipeInstructions"),
                             F.lit("Lunch").alias("recipeCategory"), F.lit("quick, Lunch").alias("keywords"), F.struct((k % 7).alias("ratingValue")).alias("aggregateRating")))
    docs = lib.table("orders").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("["), obj, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"@graph":[[{"@type":"Person"}],'), obj, F.lit("]}"))).otherwise(obj).alias("body"))
    r = X.from_schema_org(docs, "id", "body", F.current_timestamp())
    return r.select("id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), F.col("tastiness_rating").cast("bigint").alias("rating"), F.array_join("labels", "|").alias("labels"))


def _foreign(lib):
    k = F.col("o_orderkey")
    obj = F.to_json(F.struct(F.concat(F.lit("Dish "), k.cast("string")).alias("name"), F.lit("1 egg\n\n 2 cups rice ").alias("ingredients"), F.lit("1. Mix.\n2) Bake.").alias("directions"),
                             (k % 7).cast("string").alias("rating"), (k % 2 == 0).alias("on_favorites"), F.lit("Facile").alias("difficulty"), F.array("o_orderpriority").alias("categories"),
                             F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created")))
    return lib.table("orders").select(k.alias("id"), F.when(k % 10 == 9, F.substring(obj, 1, 30)).otherwise(obj).alias("body"))


@plan("src7_foreign_import", """
SELECT o_orderkey AS id, 'Dish ' || o_orderkey AS title, '1 egg|2 cups rice' AS ingredients, 'Mix.|Bake.' AS steps, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 5 THEN o_orderkey % 7 END AS rating,
 o_orderkey % 2 = 0 AS favorite, 'easy' AS difficulty, o_orderpriority AS categories, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders WHERE o_orderkey % 10 <> 9""")
def _(lib):
    good, _bad = X.read_foreign(_foreign(lib), "body")
    r = X.from_foreign(good, ["id"], F.current_timestamp())
    return r.select("id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), F.col("tastiness_rating").cast("bigint").alias("rating"), "favorite",
                    F.col("difficulty_rating").alias("difficulty"), F.array_join("categories", "|").alias("categories"), F.unix_seconds("created_at").alias("created"))


@plan("src8_bad_records", "SELECT o_orderkey AS id, 'not a readable record' AS problem FROM orders WHERE o_orderkey % 10 = 9")
def _(lib):
    return X.read_foreign(_foreign(lib), "body")[1]


def exportable(lib):
    kids = lib.lines().groupBy(F.col("recipe_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "raw_line"))), lambda x: x["raw_line"]).alias("ingredients"))
    tags = lib.recipe_tags().groupBy(F.col("recipe_id").alias("id")).agg(F.array_sort(F.collect_list("tag_name")).alias("tags"))
    r = lib.live().join(kids, "id", "left").join(tags, "id", "left")
    none = F.array().cast("array<string>")
    return r.select("id", "title", F.coalesce("ingredients", none).alias("ingredients"), F.array(F.lit("Mix."), F.lit("For the top:"), F.lit("Bake."), F.lit("Serve.")).alias("steps"), F.lit("4").alias("servings"),
                    F.concat(F.col("actual_cook_time_minutes").cast("string"), F.lit(" min")).alias("prep_time"), F.lit(None).cast("string").alias("cook_time"), F.lit("1 h 30").alias("total_time"),
                    "source_url", "notes", "favorite", "tastiness_rating", F.coalesce("tags", none).alias("tags"), "created_at")


@plan("src12_export_round_trip", """
SELECT id, title, coalesce((SELECT string_agg(raw_line, '|' ORDER BY position) FROM v_line l WHERE l.recipe_id = id), '') AS ingredients, 'Mix.|For the top:|Bake.|Serve.' AS steps, favorite, tastiness_rating AS rating,
 nullif(trim(coalesce(notes, '')), '') AS notes, source_url, actual_cook_time_minutes || ' min' AS prep_time FROM v_live""")
def _(lib):
    back = X.from_schema_org(X.to_schema_org(exportable(lib)), "id", "body", F.current_timestamp())
    return back.select("id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), "favorite", F.col("tastiness_rating").cast("bigint").alias("rating"), "notes", "source_url", "prep_time")


@plan("src13_csv_index", """
SELECT id, CASE WHEN id % 3 = 0 THEN '''=' || title WHEN id % 3 = 1 THEN '''  @' || title ELSE title END AS title, source_url FROM v_live""")
def _(lib):
    t = F.when(F.col("id") % 3 == 0, F.concat(F.lit("="), "title")).when(F.col("id") % 3 == 1, F.concat(F.lit("  @"), "title")).otherwise(F.col("title"))
    return X.csv_rows(lib.live().withColumn("title", t), ["id", "title", "source_url"])


@plan("src20_case_export", r"""
WITH r AS (SELECT *, CASE WHEN source_url IS NOT NULL AND source_type IN ('url', 'email') THEN 'url' WHEN source_type IN ('pdf', 'screenshot', 'email') THEN 'text' END AS kind FROM v_live WHERE NOT coalesce(needs_review, false))
SELECT id, kind, CASE WHEN kind IS NULL THEN 'no original input kept' WHEN kind = 'text' AND id % 2 = 0 THEN 'its text is only its steps' END AS skipped,
 CASE WHEN length(CAST(id AS VARCHAR)) < 5 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE substr(CAST(id AS VARCHAR), 1, 5) END || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS case_id FROM r""")
def _(lib):
    r = lib.recipes().withColumn("steps", F.array(F.lit("Mix."), F.lit("Bake."))).withColumn("raw_text", F.when(F.col("id") % 2 == 0, "mix.\n\n Bake.").otherwise("Name\nMix."))
    return X.case_rows(r)


@plan("src19_case_folders", """
SELECT lpad(doc_id::VARCHAR, 7, '0') || '-' || lang AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'url' ELSE 'text' END AS type, lang, doc_id % 2 = 0 AS checked, md5(coalesce(text, '')) AS input, n_chars AS expected
FROM documents WHERE doc_id % 5 > 0""")
def _(lib):
    CS.register(lib.spark)
    k = F.col("doc_id")
    d = lib.documents().filter(k % 5 > 0).select(
        F.concat(F.lpad(k.cast("string"), 7, "0"), F.lit("-"), "lang").alias("case_id"), F.when(k % 3 == 0, "url").otherwise("text").alias("type"), "lang", (k % 2 == 0).alias("checked"),
        F.coalesce("text", F.lit("")).alias("input"), F.to_json(F.struct("n_chars")).alias("expected"))
    root = f"{checkpoint_dir(lib.spark).rstrip('/')}/cases-{uuid.uuid4().hex}"
    d.write.format("case_folders").mode("append").save(root)
    back = lib.spark.read.format("case_folders").load(root)
    return back.select("case_id", "type", "lang", "checked", F.md5("input").alias("input"), F.get_json_object("expected", "$.n_chars").cast("bigint").alias("expected"))
