"""Enrichment jobs: lines, tags, seasons, units, durations, links, findings."""
from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import amounts as A, text as T, words as W
from quern.operators import enrich as E, lexicon as LX
from quern.plans.registry import plan
from quern.plans.selection import duck_language
from quern.model import VIEWS

VIEWS["v_item"] = """
SELECT l_orderkey AS recipe_id, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS quantity,
 CASE l_partkey % 8 WHEN 0 THEN 'cup' WHEN 1 THEN 'tbsp' WHEN 2 THEN 'tsp' WHEN 3 THEN 'g' WHEN 4 THEN 'kg' WHEN 5 THEN 'oz' WHEN 6 THEN 'lb' ELSE 'ml' END AS unit,
 p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey"""


def items(lib):
    return lib.lines().select("recipe_id", F.col("ord.l_linenumber").alias("n"), "quantity", "unit", "name")


def varied(lib):
    """Item lines in four spellings."""
    q, u, n = F.col("quantity").cast("string"), F.col("unit"), F.col("name")
    raw = (F.when(F.col("n") % 4 == 0, F.concat_ws(" ", q, u, n)).when(F.col("n") % 4 == 1, F.concat(F.lit("- "), q, F.lit(" 1/2 "), u, F.lit(" "), n))
           .when(F.col("n") % 4 == 2, F.concat(q, F.lit(" (15 oz) "), u, F.lit(" "), n)).otherwise(F.concat(n, F.lit(", to taste"))))
    return items(lib).withColumn("raw_line", raw)


_Q = "CASE n % 4 WHEN 0 THEN CAST(quantity AS VARCHAR) WHEN 1 THEN quantity || ' 1/2' WHEN 2 THEN CAST(quantity AS VARCHAR) END"
_N = "CASE n % 4 WHEN 2 THEN name || ' (15 oz)' WHEN 3 THEN name || ', to taste' ELSE name END"


@plan("enr1_line_structure", f"SELECT recipe_id, n, {_Q} AS quantity, CASE WHEN n % 4 < 3 THEN unit END AS unit, {_N} AS name FROM v_item")
def _(lib):
    return E.structured_lines(varied(lib).select("recipe_id", "n", "raw_line")).select("recipe_id", "n", "quantity", "unit", "name")


@plan("enr1_parse_rate", "SELECT coalesce(CASE WHEN n % 4 < 3 THEN unit END, '-') AS unit, count(*) AS lines, count(CASE WHEN n % 4 < 3 THEN 1 END) AS parsed FROM v_item GROUP BY 1")
def _(lib):
    p = E.structured_lines(varied(lib).select("raw_line"))
    return p.groupBy(F.coalesce("unit", F.lit("-")).alias("unit")).agg(F.count(F.lit(1)).alias("lines"), F.count("quantity").alias("parsed"))


@plan("enr2_backfill", f"""
SELECT recipe_id, n, CASE WHEN n % 3 = 0 THEN 'x' ELSE {_Q} END AS quantity, CASE WHEN n % 3 = 0 THEN 'y' WHEN n % 4 < 3 THEN unit END AS unit,
 CASE WHEN n % 3 = 0 THEN 'kept' ELSE {_N} END AS name FROM v_item""")
def _(lib):
    third = F.col("n") % 3 == 0
    stored = varied(lib).select("recipe_id", "n", "raw_line", F.when(third, "x").alias("quantity"), F.when(third, "y").alias("unit"),
                                F.when(third, "kept").otherwise(F.col("raw_line")).alias("name"))
    return E.backfill_lines(stored).select("recipe_id", "n", "quantity", "unit", "name")


_KW = [("LARGE", "meal_type", 0, "new widget"), ("LARGE", "meal_type", 1, "gear"), ("LARGE", "meal_type", 2, "widget"),
       ("PROMO", "meal_type", 0, "red"), ("A", "cooking_style", 0, "cold plate"), ("A", "cooking_style", 1, "hot plate")]


@plan("enr3_keyword_tags", "WITH kw(tag_name, category, ord, keyword) AS (VALUES " + ", ".join(map(str, _KW)) + """)
SELECT recipe_id AS doc_id, tag_name, category, arg_min(keyword, ord) AS keyword FROM v_item JOIN kw ON ' ' || name || ' ' LIKE '% ' || keyword || ' %' GROUP BY ALL""")
def _(lib):
    kw = lib.spark.createDataFrame(_KW, "tag_name string, category string, ord int, keyword string")
    docs = lib.lines().select("recipe_id", "name").distinct()
    return LX.keyword_hits(docs, "recipe_id", "name", kw)


@plan("enr4_main_ingredient", """
WITH t AS (SELECT recipe_id AS doc_id, ' ' || string_agg(name, ' , ') || ' ' AS hay FROM v_item GROUP BY 1),
m AS (SELECT doc_id, hay, regexp_replace(hay, ' (blue|red) (plate|ring) ', ' ', 'g') AS main FROM t),
h AS (SELECT doc_id, 'Beef' AS tag_name, 'plate' AS keyword FROM m WHERE main LIKE '% plate %' UNION ALL SELECT doc_id, 'Fish', 'ring' FROM m WHERE main LIKE '% ring %'
 UNION ALL SELECT doc_id, 'Pork', 'anvil' FROM m WHERE main LIKE '% anvil %')
SELECT doc_id, tag_name, 'main_ingredient' AS category, keyword FROM h
UNION ALL SELECT doc_id, 'Vegetarian', 'main_ingredient', NULL FROM m WHERE doc_id NOT IN (SELECT doc_id FROM h) AND hay NOT LIKE '% gizmo %' AND main = hay""")
def _(lib):
    kw = [("Beef", "main_ingredient", 0, "plate", True), ("Fish", "main_ingredient", 0, "ring", True), ("Pork", "main_ingredient", 0, "anvil", True)]
    lex = lib.spark.createDataFrame(kw, "tag_name string, category string, ord int, keyword string, rules_out_veg boolean")
    docs = lib.lines().groupBy(F.col("recipe_id").alias("doc_id")).agg(F.array_join(F.collect_list("name"), " , ").alias("text"))
    return E.keyword_tags(docs, lex, r"\b(blue|red)\s+(plate|ring)\b", "no such tin", ["gizmo"])


@plan("enr5_language_guess", f"SELECT doc_id, {duck_language('text')} AS language FROM documents")
def _(lib):
    return lib.documents().select("doc_id", T.guess_language(F.col("text")).alias("language"))


_CAL = [("bolt", [1, 2]), ("red bolt", [3]), ("plate", []), ("widget", [5, 6]), ("old", [7]), ("new gear", [1, 12]), ("gizmo", [6])]
_MASKS = ", ".join(f"('{n}', {sum(1 << (m - 1) for m in ms)})" for n, ms in _CAL)
_SEASON = f"""WITH cal(nm, mask) AS (VALUES {_MASKS}),
nm AS (SELECT DISTINCT name, split_part(name, ' ', 1) AS w1, split_part(name, ' ', 2) AS w2 FROM v_item),
m AS (SELECT name, CASE WHEN w1 = 'cold' THEN 0 ELSE coalesce(a.mask, b.mask, c.mask, 0) END AS mask FROM nm LEFT JOIN cal a ON a.nm = name LEFT JOIN cal b ON b.nm = w1 LEFT JOIN cal c ON c.nm = w2)"""
_COLD = r"(?:^|[^a-z0-9])cold(?![a-z0-9])"


def _masks(lib):
    return E.record_masks(lib.lines(), "recipe_id", "raw_line", E.produce_calendar(lib.spark, _CAL), _COLD)


@plan("joi6_lexicon_annotation", _SEASON + """
SELECT name, mask FROM m WHERE mask > 0 OR (split_part(name, ' ', 1) <> 'cold' AND split_part(name, ' ', 2) = 'plate' AND split_part(name, ' ', 1) <> 'old')""")
def _(lib):
    names = lib.lines().select("name").distinct()
    return E.season_masks(names, "name", E.produce_calendar(lib.spark, _CAL), _COLD).select("name", F.col("mask").cast("bigint").alias("mask"))


@plan("enr6_season_masks", _SEASON + "SELECT v_line.raw_line, any_value(mask) AS mask, count(*) AS n FROM v_line JOIN m USING (name) GROUP BY raw_line")
def _(lib):
    cal = E.produce_calendar(lib.spark, _CAL)
    d = E.per_distinct(lib.lines().select("recipe_id", "raw_line"), "raw_line", lambda k: E.season_masks(k, "raw_line", cal, _COLD))
    return d.groupBy("raw_line").agg(F.coalesce(F.max("mask"), F.lit(0)).cast("bigint").alias("mask"), F.count(F.lit(1)).alias("n"))


@plan("agg10_record_months", _SEASON + "SELECT recipe_id, bit_or(mask) AS mask FROM v_item JOIN m USING (name) GROUP BY recipe_id")
def _(lib):
    return _masks(lib).select("recipe_id", F.col("mask").cast("bigint").alias("mask"))


@plan("flt8_in_season", _SEASON + """, r AS (SELECT recipe_id, bit_or(mask) AS mask FROM v_item JOIN m USING (name) GROUP BY recipe_id)
SELECT 'in' AS side, id FROM v_live JOIN r ON recipe_id = id WHERE (mask >> 5) & 1 = 1
UNION ALL SELECT 'out', id FROM v_live WHERE id NOT IN (SELECT recipe_id FROM r WHERE (mask >> 5) & 1 = 1)""")
def _(lib):
    # both sides in one pass: the masks are worked out once
    live, masks = lib.live().select("id"), _masks(lib)
    hit = E.season_records(masks, "recipe_id", 6).withColumn("side", F.lit("in"))
    return live.join(hit, live["id"] == hit["recipe_id"], "left").select(F.coalesce("side", F.lit("out")).alias("side"), "id")


@plan("flt8_out_of_season", _SEASON + """, r AS (SELECT recipe_id, bit_or(mask) AS mask FROM v_item JOIN m USING (name) GROUP BY recipe_id)
SELECT id FROM v_live WHERE id NOT IN (SELECT recipe_id FROM r WHERE (mask >> 2) & 1 = 1)""")
def _(lib):
    return E.in_season(lib.live().select("id"), _masks(lib), "recipe_id", 3, keep=False)


@plan("agg9_vocabulary", r"""
SELECT term, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term""")
def _(lib):
    from quern.operators.search import vocabulary
    return vocabulary(lib.documents().select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")))


@plan("enr10_durations", """
WITH t AS (SELECT o_orderkey AS id, o_orderkey % 2000 + 1 AS m FROM orders)
SELECT id, CASE id % 5 WHEN 0 THEN CASE WHEN m % 60 = 0 THEN 'PT' || (m // 60) || 'H' ELSE 'PT' || CASE WHEN m >= 60 THEN (m // 60) || 'H' ELSE '' END || (m % 60) || 'M' END
 WHEN 1 THEN 'PT' || m || 'M' WHEN 2 THEN CASE WHEN m % 60 = 0 THEN 'PT' || (m // 60) || 'H' ELSE 'PT' || CASE WHEN m >= 60 THEN (m // 60) || 'H' ELSE '' END || (m % 60) || 'M' END
 WHEN 3 THEN 'PT' || m || 'H' END AS iso, CASE id % 5 WHEN 3 THEN m * 60.0 WHEN 4 THEN NULL ELSE m * 1.0 END AS minutes FROM t""")
def _(lib):
    t = lib.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2000 + 1).alias("m"))
    h, r = F.floor(F.col("m") / 60).cast("string"), (F.col("m") % 60).cast("string")
    text = (F.when(F.col("id") % 5 == 0, F.concat(h, F.lit(" hr "), r, F.lit(" min"))).when(F.col("id") % 5 == 1, F.col("m").cast("string"))
            .when(F.col("id") % 5 == 2, F.concat(h, F.lit(" h "), r)).when(F.col("id") % 5 == 3, F.concat(F.col("m").cast("string"), F.lit(" heures")))
            .otherwise(F.lit("a while")))
    # whole distinct texts, then back to the rows
    d = t.withColumn("text", text)
    return d.select("id", A.iso_duration(F.col("text")).alias("iso"), A.text_minutes(F.col("text")).alias("minutes"))


@plan("enr11_time_columns", """
WITH t AS (SELECT o_orderkey AS id, o_orderkey * 7 % 90000 AS m FROM orders),
p AS (SELECT id, m, printf('%02d:%02d:%02d', m // 1440, m % 1440 // 60, CASE WHEN id % 10 = 0 THEN 75 ELSE m % 60 END) AS text FROM t)
SELECT id, text, CASE WHEN id % 10 <> 0 AND m <= 86400 THEN m END AS minutes,
 CASE WHEN m > 0 THEN array_to_string(list_filter([CASE WHEN m >= 1440 THEN (m // 1440) || chr(160) || 'j' END, CASE WHEN m % 1440 >= 60 THEN (m % 1440 // 60) || chr(160) || 'h' END, CASE WHEN m % 60 > 0 THEN (m % 60) || chr(160) || 'min' END], lambda x: x IS NOT NULL), ' ') END AS label FROM p""")
def _(lib):
    t = lib.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7 % 90000).alias("m"))
    text = F.concat(F.substring(A.minutes_ddhhmm(F.col("m")), 1, 6), F.when(F.col("id") % 10 == 0, "75").otherwise(F.lpad((F.col("m") % 60).cast("string"), 2, "0")))
    return t.withColumn("text", text).select("id", "text", A.ddhhmm_minutes(F.col("text")).alias("minutes"), A.cook_time_label(F.col("m"), "fr").alias("label"))


@plan("enr12_scaled_amounts", """
SELECT recipe_id, n, CASE n % 4 WHEN 0 THEN quantity * 2.0 WHEN 1 THEN (quantity + 0.5) * 2 WHEN 2 THEN NULL ELSE quantity * 2.0 END AS low,
 CASE WHEN n % 4 = 3 THEN (quantity + 3) * 2.0 END AS high, n % 4 = 2 AS kept FROM v_item""")
def _(lib):
    q, rest = F.col("quantity").cast("string"), F.concat_ws(" ", "unit", "name")
    line = (F.when(F.col("n") % 4 == 0, F.concat_ws(" ", q, rest)).when(F.col("n") % 4 == 1, F.concat(q, F.lit("½ "), rest))
            .when(F.col("n") % 4 == 2, F.concat(q, F.lit(",000 "), rest)).otherwise(F.concat(q, F.lit("-"), (F.col("quantity") + 3).cast("string"), F.lit(" "), rest)))
    return E.scaled(items(lib).withColumn("line", line), "line", 2.0).select("recipe_id", "n", "low", "high", "kept")


_DENS = [("bolt", 100.0), ("red bolt", 150.0), ("widget", None), ("ring", 80.0), ("new", 60.0), ("gear", 210.0)]
_DSQL = f"""WITH den(nm, g) AS (VALUES {", ".join(f"('{n}', {'NULL' if g is None else g})" for n, g in _DENS)}),
d AS (SELECT i.*, coalesce(a.nm, b.nm, c.nm) AS ingredient, CASE WHEN a.nm IS NOT NULL THEN a.g WHEN b.nm IS NOT NULL THEN b.g ELSE c.g END AS g
 FROM v_item i LEFT JOIN den a ON a.nm = name LEFT JOIN den b ON b.nm = split_part(name, ' ', 1) LEFT JOIN den c ON c.nm = split_part(name, ' ', 2))"""
_F = "CASE unit WHEN 'cup' THEN 1.0::DOUBLE WHEN 'tbsp' THEN 1.0::DOUBLE / 16 WHEN 'tsp' THEN 1.0::DOUBLE / 48 WHEN 'ml' THEN 1.0::DOUBLE / 236.588 END"
_W = "CASE unit WHEN 'g' THEN 1.0::DOUBLE WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'oz' THEN 28.3495::DOUBLE WHEN 'lb' THEN 453.592::DOUBLE END"


def _lined(lib):
    return items(lib).withColumn("line", F.concat_ws(" ", F.col("quantity").cast("string"), "unit", "name"))


@plan("enr13_volume_to_mass", _DSQL + f"""
SELECT coalesce(ingredient, '-') AS ingredient, round(sum(quantity * {_F} * g), 2) AS grams, count(*) FILTER ({_F} IS NOT NULL AND g IS NULL) AS kept FROM d GROUP BY 1""")
def _(lib):
    d = E.per_distinct(_lined(lib), "line", lambda k: E.to_grams(k, "line", E.densities(lib.spark, _DENS)))
    # weights name no ingredient of their own: give them their name's entry
    names = LX.annotate(lib.table("part").select("p_name").distinct(), "p_name", F.col("p_name"), E.densities(lib.spark, _DENS), "name", ["name"])
    d = d.drop("ingredient").join(names.select(F.col("p_name").alias("pn"), F.col("name").alias("ingredient")), F.col("name") == F.col("pn"), "left")
    return d.groupBy(F.coalesce("ingredient", F.lit("-")).alias("ingredient")).agg(F.round(F.sum("grams_low"), 2).alias("grams"), F.count_if("kept").alias("kept"))


@plan("enr14_mass_to_volume", _DSQL + f""", v AS (SELECT *, quantity * {_W} / g AS cups FROM d),
u AS (SELECT *, CASE WHEN cups >= 0.25 - 1e-9 THEN 'cup' WHEN cups * 16 >= 1 - 1e-9 THEN 'tbsp' WHEN cups IS NOT NULL THEN 'tsp' END AS kitchen_unit FROM v)
SELECT recipe_id, n, round(cups, 6) AS cups, kitchen_unit, {_W} IS NOT NULL AND cups IS NULL AS kept FROM u""")
def _(lib):
    d = E.per_distinct(_lined(lib), "line", lambda k: E.to_volume(k, "line", E.densities(lib.spark, _DENS)))
    return d.select("recipe_id", "n", F.round("cups", 6).alias("cups"), "kitchen_unit", "kept")


@plan("enr15_part_names", """
SELECT name, n % 3 = 0 AND name NOT LIKE '%bolt' OR n % 3 = 2 AS is_part, count(*) AS rows FROM v_item GROUP BY 1, 2""")
def _(lib):
    line = (F.when(F.col("n") % 3 == 0, F.concat("name", F.when(F.col("name").endswith("bolt"), " to taste").otherwise(""), F.lit(":")))
            .when(F.col("n") % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("To serve "), "name", F.lit(":"))))
    return (items(lib).select("name", T.is_part_name(line).alias("is_part")).groupBy("name", "is_part").agg(F.count(F.lit(1)).alias("rows")))


_MSG = "'see ' || url || ', then (' || url || ').' || CASE WHEN page_id % 3 = 0 THEN ' http://a.example/1 http://b.example/2 http://c.example/3!' ELSE '' END"


@plan("enr16_link_harvest", f"""
WITH m AS (SELECT page_id, {_MSG} AS body FROM pages),
l AS (SELECT page_id, unnest(list_transform(regexp_extract_all(body, 'https?://[^\\s<>")'']+'), lambda u: rtrim(u, '.,;:!?'))) AS link FROM m)
SELECT page_id, count(DISTINCT link) AS n_links, CASE WHEN count(DISTINCT link) <= 3 THEN string_agg(DISTINCT link, ' ' ORDER BY link) END AS tried FROM l GROUP BY page_id""")
def _(lib):
    links = T.links_in(F.expr(_MSG))
    return lib.pages().select("page_id", links.alias("l")).select(
        "page_id", F.size("l").cast("bigint").alias("n_links"), F.when(F.size("l") <= W.MAX_LINKS_TRIED, F.array_join(F.array_sort("l"), " ")).alias("tried"))


@plan("enr17_message_cleanup", """
SELECT conv_id, turn, md5(text || chr(10)) AS body_md5 FROM conversations""")
def _(lib):
    nl = F.lit("\n")
    body = F.concat("text", nl, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("-- "), nl, F.lit("signature "), "role", nl, F.lit("more"))).otherwise(
        F.concat(F.lit("Get Outlook for iOS<https://x.example/"), F.col("turn").cast("string"), F.lit(">"))))
    return lib.table("conversations").select("conv_id", "turn", F.md5(T.strip_footer(body)).alias("body_md5"))


@plan("enr18_redacted_links", r"""
SELECT page_id, 'GET ' || regexp_replace(url, '[?#].*$', '?…') || ' failed' AS message FROM pages""")
def _(lib):
    withuser = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "://", "://user:pw@")).otherwise(F.col("url"))
    return lib.pages().select("page_id", T.redact_links(F.concat(F.lit("GET "), withuser, F.lit(" failed"))).alias("message"))


@plan("enr19_coercions", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 BETWEEN 1 AND 5 THEN o_orderkey % 8 END AS rating,
 CASE o_orderkey % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' END AS difficulty,
 CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderdate <= TIMESTAMP '2000-01-01' THEN epoch_us(o_orderdate) // 1000000 END WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderdate + INTERVAL 5 HOUR <= TIMESTAMP '2000-01-01' THEN epoch_us(o_orderdate + INTERVAL 5 HOUR) // 1000000 END END AS created
FROM orders""")
def _(lib):
    o = lib.table("orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    when = F.when(k % 3 == 0, F.concat(day, F.lit(" 00:00:00"))).when(k % 3 == 1, F.concat(day, F.lit("T00:00:00-05:00"))).otherwise("yesterday")
    word = F.element_at(F.array(*map(F.lit, ["Facile", " moyen ", "DIFFICULT", "odd"])), (k % 4 + 1).cast("int"))
    return o.select(k.alias("id"), E.rating(F.when(k % 8 == 7, F.lit("x")).otherwise((k % 8).cast("string"))).cast("bigint").alias("rating"),
                    E.difficulty(word).alias("difficulty"), F.unix_seconds(E.import_date(when, F.expr("TIMESTAMP '2000-01-01 00:00:00'"))).alias("created"))


@plan("enr20_export_keys", r"""
SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[^\x00-\x7f]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 40), ''), 'recipe') AS slug
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""")
def _(lib):
    return lib.pages().select("page_id", T.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@plan("enr21_quality_findings", """
WITH i AS (SELECT recipe_id AS id, n AS idx, CASE n % 4 WHEN 0 THEN quantity || ' ' || unit || ' ' || name WHEN 1 THEN name WHEN 2 THEN name || ' to taste' ELSE name || ':' END AS line FROM v_item)
SELECT id, 'item' AS kind, CAST(idx AS BIGINT) AS idx, 'no_amount' AS reason FROM i WHERE idx % 4 = 1
UNION ALL SELECT conv_id, 'step', turn, CASE WHEN length(trim(text)) < 12 THEN 'short' ELSE 'long' END FROM conversations WHERE length(trim(text)) < 12 OR length(text) > 700
UNION ALL SELECT o_orderkey, 'record', NULL, 'servings_missing' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'record', NULL, 'low_confidence' FROM orders WHERE o_orderkey % 100 < 80 AND o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'record', NULL, 'title_guessed' FROM orders WHERE o_orderkey % 5 = 1""")
def _(lib):
    n = F.col("n")
    line = (F.when(n % 4 == 0, F.concat_ws(" ", F.col("quantity").cast("string"), "unit", "name")).when(n % 4 == 1, F.col("name"))
            .when(n % 4 == 2, F.concat("name", F.lit(" to taste"))).otherwise(F.concat("name", F.lit(":"))))
    it = items(lib).select(F.col("recipe_id").alias("id"), n.cast("bigint").alias("idx"), line.alias("line"), F.lit(None).cast("string").alias("quantity"))
    st = lib.steps().select(F.col("recipe_id").alias("id"), F.col("position").alias("idx"), "text")
    k = F.col("o_orderkey")
    rec = lib.table("orders").select(k.alias("id"), F.when(k % 4 > 0, "4").alias("servings"), F.when(k % 3 > 0, k % 100).alias("confidence"),
                                     F.lit("text").alias("raw_text"), (k % 5 == 1).alias("from_text"))
    return E.findings(it, st, rec)


@plan("flt15_training_selection", """
WITH d AS (SELECT conv_id AS id, string_agg(text, chr(10) ORDER BY turn) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'a line of its own' ELSE '' END AS raw, conv_id % 7 <> 0 AS checked FROM conversations GROUP BY conv_id)
SELECT id FROM d WHERE checked AND id % 2 = 0""")
def _(lib):
    c = lib.steps().groupBy(F.col("recipe_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("turns"))
    c = c.select("id", F.flatten(F.transform("turns", lambda t: F.split(t, "\n"))).alias("steps"))
    raw = F.concat(F.array_join("steps", "\n"), F.when(F.col("id") % 2 == 0, "\nA line of its own").otherwise(""))
    return c.filter("id % 7 <> 0").filter(~E.steps_only(raw, F.col("steps"))).select("id")


@plan("flt16_missing_parts", """
WITH i AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), s AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT id, CASE WHEN i.id IS NULL AND s.id IS NULL THEN 'ingredients,steps' WHEN i.id IS NULL THEN 'ingredients' ELSE 'steps' END AS missing
FROM v_live LEFT JOIN i USING (id) LEFT JOIN s USING (id) WHERE i.id IS NULL OR s.id IS NULL""")
def _(lib):
    i = lib.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array(F.first("l_linenumber")).alias("items"))
    s = lib.steps().groupBy(F.col("recipe_id").alias("id")).agg(F.array(F.first("position")).alias("steps"))
    r = lib.live().select("id").join(i, "id", "left").join(s, "id", "left")
    return (r.withColumn("m", E.missing_parts(F.col("items"), F.col("steps"))).filter(F.size("m") > 0).select("id", F.array_join("m", ",").alias("missing")))


@plan("agg15_scan_confidence", """
SELECT doc_id, round(avg(conf), 6) AS mean_conf, count(conf) = count(*) AS fully_scanned, coalesce(avg(conf) < 50, false) AS too_poor
FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 5 > 0 THEN l_quantity * 2 END AS conf FROM lineitem) GROUP BY doc_id""")
def _(lib):
    p = lib.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_quantity") * 2).alias("conf"))
    return E.scan_confidence(p, "doc_id", "conf").withColumn("mean_conf", F.round("mean_conf", 6))
