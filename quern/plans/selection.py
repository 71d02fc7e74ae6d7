"""Scans, filters, sorts and facets."""
from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T, words as W
from quern.operators import selection as S
from quern.plans.registry import plan

TAGS2, NOT_TAG = ["PROMO", "LARGE"], "SMALL"

# token list of a text, and its language, in DuckDB
DUCK_TOKENS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def duck_language(c: str) -> str:
    words = lambda ws: ", ".join("'" + w + "'" for w in ws)
    fr = [w for w in W.FRENCH_WORDS if w.isalpha()]
    en = "and the of with cup cups tablespoon tablespoons teaspoon teaspoons tbsp tsp pinch add mix stir bake oven until".split()
    t = DUCK_TOKENS.format(c=c)
    return (f"CASE WHEN len(list_filter({t}, lambda w: w IN ({words(fr)}))) > "
            f"len(list_filter({t}, lambda w: w IN ({words(en)}))) THEN 'fr' ELSE 'en' END")


@plan("flagship", """
WITH good AS (SELECT recipe_id FROM v_recipe_tag WHERE tag_name IN ('PROMO', 'LARGE') GROUP BY recipe_id HAVING count(DISTINCT tag_name) = 2),
bad AS (SELECT recipe_id FROM v_recipe_tag WHERE tag_name = 'SMALL')
SELECT id, title, tastiness_rating, actual_cook_time_minutes,
 (SELECT string_agg(tag_name, ' ' ORDER BY category, tag_name) FROM v_recipe_tag t WHERE t.recipe_id = id) AS tags_text
FROM v_live WHERE id IN (SELECT recipe_id FROM good) AND id NOT IN (SELECT recipe_id FROM bad)
 AND actual_cook_time_minutes > 0 AND actual_cook_time_minutes <= 1440
ORDER BY tastiness_rating DESC NULLS LAST, id""")
def flagship(lib):
    bridge = lib.recipe_tags()
    hits = S.within_minutes(S.without_tags(S.with_all_tags(lib.live(), bridge, TAGS2), bridge, [NOT_TAG]), 1440)
    # the rollup only reads the tags of records that passed
    kept = bridge.join(hits.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi")
    rollup = kept.groupBy(F.col("recipe_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "tag_name"))), lambda x: x["tag_name"]), " ").alias("tags_text"))
    return (hits.join(rollup, "id", "left").select("id", "title", "tastiness_rating", "actual_cook_time_minutes", "tags_text")
            .orderBy(*[F.col("tastiness_rating").desc_nulls_last(), F.col("id")]))


@plan("src1_live_scan", "SELECT id, title, CAST(created_at AS STRING) AS created FROM v_live")
def _(lib):
    return S.live(lib.recipes()).select("id", "title", F.col("created_at").cast("string").alias("created"))


@plan("src1_scan_with_deleted", "SELECT count(*) AS n, count(deleted_at) AS gone FROM v_recipe")
def _(lib):
    return S.live(lib.recipes(), include_deleted=True).agg(F.count(F.lit(1)).alias("n"), F.count("deleted_at").alias("gone"))


@plan("flt1_favourite", "SELECT id, title FROM v_live WHERE favorite")
def _(lib):
    return lib.live().filter("favorite").select("id", "title")


@plan("flt2_to_review", """
SELECT 'yes' AS wanted, id FROM v_live WHERE needs_review
UNION ALL SELECT 'no', id FROM v_live WHERE NOT coalesce(needs_review, false)""")
def _(lib):
    part = lambda v, name: S.to_review(lib.live(), v).select(F.lit(name).alias("wanted"), "id")
    return part(True, "yes").unionAll(part(False, "no"))


@plan("flt3_pace_any_of", "SELECT id, cook_time_rating FROM v_live WHERE cook_time_rating IN ('quick', 'long')")
def _(lib):
    return S.pace(lib.live(), wanted=["quick", "long"]).select("id", "cook_time_rating")


@plan("flt4_pace_none_of", """
SELECT id, cook_time_rating FROM v_live WHERE cook_time_rating IS NULL OR cook_time_rating NOT IN ('quick', 'long')""")
def _(lib):
    return S.pace(lib.live(), left_out=["quick", "long"]).select("id", "cook_time_rating")


@plan("flt5_within_minutes", """
SELECT 'in' AS side, id FROM v_live WHERE nullif(actual_cook_time_minutes, 0) <= 600
UNION ALL SELECT 'out', id FROM v_live WHERE nullif(actual_cook_time_minutes, 0) IS NULL OR actual_cook_time_minutes > 600""")
def _(lib):
    side = lambda out, name: S.within_minutes(lib.live(), 600, out).select(F.lit(name).alias("side"), "id")
    return side(False, "in").unionAll(side(True, "out"))


@plan("flt6_all_of_tags", """
SELECT id, title FROM v_live WHERE id IN (SELECT recipe_id FROM v_recipe_tag WHERE tag_name IN ('PROMO', 'LARGE', 'R')
 GROUP BY recipe_id HAVING count(DISTINCT tag_name) = 3)""")
def _(lib):
    return S.with_all_tags(lib.live(), lib.recipe_tags(), ["PROMO", "LARGE", "R"]).select("id", "title")


@plan("flt7_none_of_tags", """
SELECT id, title FROM v_live WHERE id NOT IN (SELECT recipe_id FROM v_recipe_tag WHERE tag_name IN ('PROMO', 'Brand#1'))""")
def _(lib):
    return S.without_tags(lib.live(), lib.recipe_tags(), ["PROMO", "Brand#1"]).select("id", "title")


@plan("flt10_picker_predicate", """
SELECT id FROM v_live
WHERE id IN (SELECT recipe_id FROM v_recipe_tag WHERE category = 'meal_type' AND tag_name IN ('SMALL', 'LARGE'))
 AND id IN (SELECT recipe_id FROM v_recipe_tag WHERE category = 'main_ingredient' AND tag_name IN ('Brand#3', 'Brand#4', 'Brand#5'))
 AND id NOT IN (SELECT recipe_id FROM v_forbidden)""")
def _(lib):
    bridge = lib.recipe_tags()
    forbidden = S.forbidden_records(bridge, lib.tags(), "promo", "cocktail")
    chosen = {"meal_type": ["SMALL", "LARGE"], "main_ingredient": ["Brand#3", "Brand#4", "Brand#5"], "cooking_style": []}
    return S.without_forbidden(S.pick(lib.live(), bridge, chosen), forbidden).select("id")


@plan("flt11_forbidden_class", "SELECT id, title FROM v_live WHERE id NOT IN (SELECT recipe_id FROM v_forbidden)")
def _(lib):
    return S.without_forbidden(lib.live(), S.forbidden_records(lib.recipe_tags(), lib.tags(), "promo", "cocktail")).select("id", "title")


@plan("flt12_choice_check", """
WITH choice AS (SELECT DISTINCT p_type AS tag_name, CASE WHEN p_type < 'M' THEN 'meal_type' ELSE 'cooking_style' END AS sent_as FROM part
 UNION SELECT DISTINCT p_name, 'meal_type' FROM part),
known AS (SELECT tag_name, list(DISTINCT category) AS cats FROM v_tag GROUP BY tag_name)
SELECT tag_name, sent_as, CASE WHEN cats IS NULL THEN 'unknown' WHEN list_contains(cats, sent_as) THEN 'ok' ELSE 'wrong_category' END AS status
FROM choice LEFT JOIN known USING (tag_name)""")
def _(lib):
    part = lib.table("part")
    choices = part.select(F.inline(F.array(
        F.struct(F.col("p_type").alias("tag_name"), F.when(F.col("p_type") < "M", "meal_type").otherwise("cooking_style").alias("sent_as")),
        F.struct(F.col("p_name").alias("tag_name"), F.lit("meal_type").alias("sent_as"))))).distinct()
    return S.check_choices(choices, lib.tags())


@plan("flt13_language_filter", f"""
SELECT doc_id, language FROM (SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE {duck_language("text")} END AS language FROM documents)
WHERE language = 'fr'""")
def _(lib):
    return (lib.documents().select("doc_id", T.record_language(F.col("lang"), F.lit(""), F.col("text")).alias("language"))
            .filter("language = 'fr'"))


@plan("flt14_sender_allow_list", """
WITH m AS (SELECT c_custkey, 'Cook ' || c_custkey || ' <User' || c_custkey || '@Mail' || (c_nationkey) || '.example.com>' AS sender FROM customer),
a AS (SELECT c_custkey, lower(regexp_extract(sender, '<([^>]*)>', 1)) AS addr FROM m)
SELECT c_custkey, addr FROM a WHERE addr IN ('user7@mail7.example.com') OR split_part(addr, '@', 2) IN ('mail3.example.com', 'mail4.example.com')""")
def _(lib):
    from quern.operators.messages import allowed_senders, sender_allowed
    msgs = lib.table("customer").select("c_custkey", F.format_string(
        "Cook %d <User%d@Mail%d.example.com>", "c_custkey", "c_custkey", "c_nationkey").alias("sender"))
    entries = allowed_senders("user7@mail7.example.com, @mail3.example.com; mail4.example.com")
    return sender_allowed(msgs, "sender", entries).select("c_custkey", "addr")


@plan("prj1_summary", """
SELECT id, title, tastiness_rating, length(trim(coalesce(notes, ''))) > 0 AS has_notes, substring(trim(coalesce(notes, '')), 1, 300) AS snippet FROM v_live""")
def _(lib):
    return S.summary(lib.live())


@plan("prj2_detail", """
SELECT id, CASE WHEN tastiness_rating IN (1, 2, 3, 4, 5) THEN tastiness_rating END AS tastiness_rating,
 CASE WHEN difficulty_rating IN ('easy', 'medium', 'hard') THEN difficulty_rating END AS difficulty_rating,
 CASE WHEN regexp_matches(source_url, '(?i)^https?://[^/?#]+') THEN source_url END AS source_url, nullif(trim(coalesce(notes, '')), '') AS notes,
 (SELECT string_agg(raw_line, '|' ORDER BY position) FROM v_line l WHERE l.recipe_id = id) AS ingredients
FROM v_live""")
def _(lib):
    items = lib.lines().groupBy(F.col("recipe_id").alias("id")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", F.coalesce("raw_line", F.concat_ws(" ", "quantity", "unit", "name")).alias("line")))),
        lambda x: x["line"]), "|").alias("ingredients"))
    return lib.live().join(items, "id", "left").select(
        "id", S.one_of(F.col("tastiness_rating"), [1, 2, 3, 4, 5]).alias("tastiness_rating"),
        S.one_of(F.col("difficulty_rating"), W.DIFFICULTIES).alias("difficulty_rating"),
        S.web_link(F.col("source_url")).alias("source_url"),
        F.nullif(F.trim(F.coalesce("notes", F.lit(""))), F.lit("")).alias("notes"), "ingredients")


@plan("prj3_bounded_text", """
SELECT doc_id, md5(b) AS bounded_md5, length(text) > 0 AND b <> text AS was_cut FROM (SELECT doc_id, text,
 array_to_string(list_transform(string_split(substring(text, 1, 400000), chr(10))[1:4000], lambda l: substring(l, 1, 2000)), chr(10)) AS b FROM documents)""")
def _(lib):
    c = F.col("text")
    return lib.documents().select("doc_id", F.md5(T.bounded_text(c)).alias("bounded_md5"), T.text_was_cut(c).alias("was_cut"))


@plan("joi1_recipe_tags", """
SELECT id, title, tag_name, category, subgroup FROM v_live JOIN v_recipe_tag ON recipe_id = id JOIN v_tag USING (tag_name, category)""")
def _(lib):
    return (lib.live().select("id", "title").join(lib.recipe_tags().withColumnRenamed("recipe_id", "id"), "id")
            .join(lib.tags(), ["tag_name", "category"]).select("id", "title", "tag_name", "category", "subgroup"))


@plan("joi2_semi_anti", """
SELECT id FROM v_live WHERE id IN (SELECT recipe_id FROM v_recipe_tag WHERE tag_name = 'Brand#2')
 AND id NOT IN (SELECT recipe_id FROM v_recipe_tag WHERE tag_name = 'STANDARD')""")
def _(lib):
    b = lib.recipe_tags()
    return S.without_tags(S.with_all_tags(lib.live(), b, ["Brand#2"]), b, ["STANDARD"]).select("id")


def _sorted(lib, sort, direction):
    return lib.live().orderBy(*S.sort_keys(sort, direction)).select("id", "title")


for _sort, _dir, _sql in [
        ("created", "desc", "created_at DESC"), ("title", "asc", "lower(title)"), ("rating", "desc", "tastiness_rating DESC NULLS LAST"),
        ("cook_time", "asc", "nullif(actual_cook_time_minutes, 0) ASC NULLS LAST"),
        ("difficulty", "desc", "CASE difficulty_rating WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 END DESC NULLS LAST")]:
    plan(f"srt1_sort_{_sort}", f"SELECT id, title FROM v_live ORDER BY {_sql}, id")(
        lambda lib, s=_sort, d=_dir: _sorted(lib, s, d))


@plan("srt3_top_k_per_group", """
SELECT source_type, id, CAST(rank AS BIGINT) AS rank FROM (SELECT source_type, id, row_number() OVER (PARTITION BY source_type ORDER BY created_at DESC, id) AS rank FROM v_live)
WHERE rank <= 5""")
def _(lib):
    return (S.top_k(lib.live(), ["source_type"], [F.desc("created_at"), F.asc("id")], 5)
            .select("source_type", "id", F.col("rank").cast("bigint").alias("rank")))


_U = "(('0x' || substr(md5('{seed}:' || id), 1, 8))::BIGINT + 1) / 4294967297.0"


@plan("srt4_weighted_draw", f"""
WITH c AS (SELECT id, title, tastiness_rating FROM v_live WHERE cook_time_rating = 'quick'),
lft AS (SELECT * FROM c WHERE id % 10 <> 3),
drawn AS (SELECT id, title FROM lft ORDER BY -ln({_U.format(seed='tonight')}) / CASE tastiness_rating WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 4 THEN 1.1 WHEN 5 THEN 1.2 ELSE 1.0 END, id LIMIT 1),
oth AS (SELECT id, title FROM c WHERE id NOT IN (SELECT id FROM drawn) ORDER BY {_U.format(seed='tonight/others')}, id LIMIT 8)
SELECT role, id, title, (SELECT count(*) FROM c) AS match_count, greatest((SELECT count(*) FROM lft) - 1, 0) AS remaining
FROM (SELECT 'drawn' AS role, * FROM drawn UNION ALL SELECT 'other', * FROM oth)""")
def _(lib):
    cand = lib.live().filter("cook_time_rating = 'quick'").select("id", "title", "tastiness_rating")
    shown = lib.recipes().filter("id % 10 = 3").select(F.col("id").alias("shown_id"))
    return S.weighted_draw(cand, shown, "tonight")


@plan("srt5_sample_of_others", f"SELECT id, title FROM v_live ORDER BY {_U.format(seed='shuffle')}, id LIMIT 8")
def _(lib):
    return lib.live().orderBy(S.unit_hash("shuffle", F.col("id")), "id").limit(8).select("id", "title")


_FACETS = f"""
WITH offered AS (SELECT * FROM v_live WHERE id NOT IN (SELECT recipe_id FROM v_forbidden)),
facets AS (SELECT category AS facet, tag_name AS value, count(*) AS n FROM v_recipe_tag JOIN offered ON id = recipe_id JOIN v_tag USING (tag_name, category)
 WHERE NOT ((category = 'meal_type' AND lower(trim(tag_name)) = 'promo') OR (category = 'cooking_style' AND coalesce(subgroup, '') = 'cocktail')) GROUP BY ALL
UNION ALL SELECT 'pace', cook_time_rating, count(*) FROM offered WHERE cook_time_rating IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'language', l, count(*) FROM (SELECT {duck_language("o.title || ' ' || coalesce(text, '')")} AS l FROM offered o LEFT JOIN documents ON doc_id = id) GROUP BY ALL
UNION ALL SELECT 'total', 'all', count(*) FROM offered)
"""


def _facets(lib):
    bridge, tags = lib.recipe_tags(), lib.tags()
    contents = lib.documents().select(F.col("doc_id").alias("id"), F.col("text").alias("content_text"))
    lang = T.record_language(F.lit(None).cast("string"), F.col("title"), F.col("content_text"))
    return S.facet_counts(lib.live(), bridge, tags, S.forbidden_records(bridge, tags, "promo", "cocktail"),
                          contents, lang, "promo", "cocktail")


@plan("agg1_facet_counts", _FACETS + "SELECT * FROM facets")
def _(lib):
    return _facets(lib)


@plan("agg2_facet_order", _FACETS + """SELECT facet, value, n, CASE value WHEN 'STANDARD' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS seed_rank FROM facets
 WHERE facet = 'meal_type' ORDER BY seed_rank, lower(value)""")
def _(lib):
    seed = [("STANDARD", "meal_type", None), ("ECONOMY", "meal_type", None)]
    return S.facet_order(_facets(lib).filter("facet = 'meal_type'"), seed).orderBy("seed_rank", F.lower("value"))


@plan("agg3_library_check", """
SELECT 'no_ingredients' AS check_name, id, title FROM v_live WHERE id NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'no_steps', id, title FROM v_live WHERE id NOT IN (SELECT conv_id FROM conversations)
UNION ALL SELECT 'no_tags', id, title FROM v_live WHERE id NOT IN (SELECT recipe_id FROM v_recipe_tag)
UNION ALL SELECT 'no_photo', id, title FROM v_live WHERE image_path IS NULL
UNION ALL SELECT 'photo_missing', id, title FROM v_live WHERE image_path IS NOT NULL AND image_path NOT IN (SELECT name FROM v_file)
UNION ALL SELECT 'to_review', id, title FROM v_live WHERE needs_review""")
def _(lib):
    items = lib.table("lineitem").select(F.col("l_orderkey").alias("recipe_id"))
    return S.library_check(lib.live(), items, lib.steps(), lib.recipe_tags(), lib.files())


@plan("agg4_review_queue", "SELECT count(*) AS n FROM v_live WHERE needs_review")
def _(lib):
    return S.to_review(lib.live(), True).agg(F.count(F.lit(1)).alias("n"))


@plan("agg5_time_buckets", """
WITH m AS (SELECT least(greatest(CAST(ceil(max(actual_cook_time_minutes) / 20.0) AS BIGINT) * 20, 20), 86400) AS c FROM v_live),
d AS (SELECT c, CAST(ceil(c / 1440.0) AS BIGINT) AS top FROM m),
steps AS (SELECT unnest(range(20, least(c, 1440) + 1, 20)) AS minutes FROM d
 UNION SELECT unnest(range(2, least(top, 7) + 1)) * 1440 FROM d WHERE c > 1440
 UNION SELECT unnest(range(14, top, 7)) * 1440 FROM d WHERE c > 1440 UNION SELECT top * 1440 FROM d WHERE c > 1440)
SELECT minutes, CASE WHEN minutes >= 1440 THEN (minutes // 1440) || 'd' || CASE WHEN minutes % 1440 // 60 > 0 THEN ' ' || (minutes % 1440 // 60) || 'h' ELSE '' END
 WHEN minutes // 60 > 0 AND minutes % 60 > 0 THEN (minutes // 60) || 'h ' || (minutes % 60) || 'm' WHEN minutes // 60 > 0 THEN (minutes // 60) || 'h' ELSE minutes || 'm' END AS label,
 (minutes - 1) // 60 AS hour_group FROM steps""")
def _(lib):
    return S.minute_buckets(lib.live())


@plan("agg6_content_rollup", """
SELECT recipe_id AS id, string_agg(raw_line, ' ' ORDER BY position) AS content_text FROM v_line GROUP BY recipe_id""")
def _(lib):
    from quern.operators.rollups import ordered_text
    return ordered_text(lib.lines(), "recipe_id", "ord", "raw_line", " ").withColumnsRenamed({"recipe_id": "id", "text": "content_text"})


@plan("agg7_tag_rollup", """
SELECT recipe_id AS id, string_agg(tag_name, ' ' ORDER BY category, tag_name) AS tags_text FROM v_recipe_tag GROUP BY recipe_id""")
def _(lib):
    from quern.operators.rollups import ordered_text
    b = lib.recipe_tags().withColumn("ord", F.struct("category", "tag_name"))
    return ordered_text(b, "recipe_id", "ord", "tag_name", " ").withColumnsRenamed({"recipe_id": "id", "text": "tags_text"})


@plan("agg8_grouped_listing", """
SELECT id, title, coalesce(t.tag_name, 'Uncategorized') AS group_name,
 CASE WHEN t.tag_name IS NULL THEN 2 WHEN t.subgroup IS NOT NULL THEN 1 ELSE 0 END AS section
FROM v_live LEFT JOIN (SELECT recipe_id, tag_name, subgroup FROM v_recipe_tag JOIN v_tag USING (tag_name, category) WHERE category = 'cooking_style') t ON t.recipe_id = id""")
def _(lib):
    return S.grouped_listing(lib.live(), lib.recipe_tags(), lib.tags(), "cooking_style")


@plan("agg16_library_size", "SELECT count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM v_file")
def _(lib):
    return lib.files().agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("total_bytes"))


@plan("agg17_referenced_names", """
SELECT DISTINCT image_path AS name FROM v_live WHERE image_path IS NOT NULL""")
def _(lib):
    return lib.live().filter("image_path IS NOT NULL").select(F.col("image_path").alias("name")).distinct()


@plan("win1_first_per_key", """
SELECT title_key, id, title FROM (SELECT lower(title) AS title_key, id, title, row_number() OVER (PARTITION BY lower(title) ORDER BY id) AS rn FROM v_live) WHERE rn = 1""")
def _(lib):
    return S.first_per_key(lib.live().withColumn("title_key", F.lower("title")), "title_key", "id", ["id", "title"])


@plan("win14_order_keeping_distinct", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5, count(*) AS n FROM f GROUP BY doc_id""")
def _(lib):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))
    return (lib.documents().select("doc_id", words.alias("w")).filter(F.size("w") > 0)
            .select("doc_id", F.md5(F.array_join("w", " ")).alias("words_md5"), F.size("w").cast("bigint").alias("n")))
