"""Lines of texts: windows, segmentation stages, pages and logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import patterns as P, text as T, words as W
from quern.model import VIEWS
from quern.operators import lines as L, segment as G
from quern.plans.registry import plan

VIEWS["v_docline"] = """
SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ ]+')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> ''"""
HEAD = "length(line) <= 20"      # short lines stand in for headings on these texts


def doclines(lib):
    return L.lines_table(lib.documents()).withColumn("words", F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))))


def head():
    return F.length("line") <= 20


_W = "OVER (PARTITION BY doc_id ORDER BY i)"


@plan("win4_neighbour_features", f"""
SELECT doc_id, i, lag(s, 2) {_W} AS pp, lag(s) {_W} AS p, lead(s) {_W} AS n, lead(s, 2) {_W} AS nn, r = 1 AS is_first, r = c AS is_last, least((r - 1) * 10 // c, 9) AS tenth
FROM (SELECT doc_id, i, words % 10 AS s, row_number() {_W} AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM v_docline)""")
def _(lib):
    return L.neighbours(doclines(lib), (F.col("words") % 10).cast("bigint")).select("doc_id", "i", "pp", "p", "n", "nn", "is_first", "is_last", "tenth")


@plan("win5_heading_seen", f"""
SELECT doc_id, i, coalesce(bool_or({HEAD}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM v_docline""")
def _(lib):
    return L.seen_before(doclines(lib), head()).select("doc_id", "i", "seen")


@plan("win6_section_of_line", f"""
SELECT doc_id, i, last_value(CASE WHEN {HEAD} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM v_docline""")
def _(lib):
    return L.carry_heading(doclines(lib), head()).select("doc_id", "i", "heading")


@plan("win7_wrapped_lines", r"""
WITH s AS (SELECT doc_id, i, line, CASE WHEN coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY i), '[.!?:)]\s*$'), true) THEN 1 ELSE 0 END AS st FROM v_docline),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s)
SELECT doc_id, CAST(g AS BIGINT) AS island, md5(string_agg(line, ' ' ORDER BY i)) AS text_md5 FROM g GROUP BY ALL""")
def _(lib):
    return L.joined(doclines(lib), F.col("line").rlike(P.STEP_BREAK)).select("doc_id", "island", F.md5("text").alias("text_md5"))


_KIND = "CASE WHEN words >= 12 THEN 'prose' ELSE 'ing' END"


@plan("win8_part_runs", f"""
WITH k AS (SELECT doc_id, i, {_KIND} AS kind FROM v_docline), s AS (SELECT *, CASE WHEN kind = lag(kind) {_W} THEN 0 ELSE 1 END AS st FROM k),
g AS (SELECT *, sum(st) {_W} AS g FROM s), r AS (SELECT doc_id, g, any_value(kind) AS kind, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT doc_id, kind = 'prose' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY g) = 'ing' AND lag(n) OVER (PARTITION BY doc_id ORDER BY g) >= 2 AS hit FROM r)
SELECT doc_id, count(*) FILTER (hit) AS n_parts FROM h GROUP BY doc_id HAVING count(*) FILTER (hit) >= 2""")
def _(lib):
    return L.parts(doclines(lib), F.expr(_KIND))


_LAB = "CASE words % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ingredient' WHEN 2 THEN 'step' ELSE 'other' END"


@plan("win9_ambiguous_labels", f"""
WITH a AS (SELECT doc_id, i, {_LAB} AS label, CASE WHEN words % 8 = 0 THEN 'step' ELSE 'ingredient' END AS best FROM v_docline),
x AS (SELECT *, lag(label) {_W} AS pl, CASE WHEN label IS NULL AND lag(i) {_W} IS NOT NULL AND lag(label) {_W} IS NULL THEN 0 ELSE 1 END AS st FROM a),
b AS (SELECT *, sum(st) {_W} AS run, first_value(CASE WHEN label IN ('ingredient', 'step') THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nl FROM x)
SELECT doc_id, i, coalesce(label, first_value(coalesce(CASE WHEN pl IN ('ingredient', 'step') THEN pl END, nl, best)) OVER (PARTITION BY doc_id, run ORDER BY i)) AS label FROM b""")
def _(lib):
    d = doclines(lib).select("doc_id", "i", F.expr(_LAB).alias("label"), F.when(F.col("words") % 8 == 0, "step").otherwise("ingredient").alias("best"))
    return L.fill_labels(d)


@plan("win10_step_numbers", """
SELECT l_orderkey AS id, count(*) >= 2 AND count(DISTINCT d) = 1 AS counts_up FROM
 (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM lineitem) GROUP BY 1""")
def _(lib):
    return L.counts_up(lib.table("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber"), "id", "l_linenumber")


@plan("win11_repeated_line", """
WITH g AS (SELECT doc_id, lower(line) AS low, count(*) AS n, min(i) AS i, arg_min(line, i) AS line FROM v_docline GROUP BY ALL)
SELECT doc_id, arg_min(line, i) AS line FROM g WHERE n >= 2 GROUP BY doc_id""")
def _(lib):
    return L.repeated_line(doclines(lib))


@plan("win12_best_block", f"""
WITH b AS (SELECT *, {HEAD} AS h, sum(CASE WHEN {HEAD} THEN 1 ELSE 0 END) {_W} AS block FROM v_docline),
s AS (SELECT doc_id, block, count(*) FILTER (NOT h AND words % 3 = 0) AS hits, min(i) AS at_line FROM b WHERE block > 0 GROUP BY ALL)
SELECT doc_id, hits, at_line AS at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, at_line) AS r FROM s) WHERE r = 1""".replace("AS at FROM", 'AS "at" FROM'))
def _(lib):
    return L.best_block(doclines(lib), head(), F.col("words") % 3 == 0)


# scores of two tags over the labelled documents, from the document itself
_SCORE = "SELECT CASE WHEN l.doc_id % 2 = 0 THEN 'quality' ELSE 'toxic' END || l.doc_id % 7 AS tag, round((n_chars % 1000) / 1000.0, 3) AS p, CASE WHEN l.doc_id % 11 < 9 OR quality + toxic = 2 THEN 1 ELSE 0 END AS truth FROM labels l JOIN documents USING (doc_id)"


def scores(lib):
    return lib.table("labels").join(lib.documents().select("doc_id", "n_chars"), "doc_id").select(
        F.concat(F.when(F.col("doc_id") % 2 == 0, "quality").otherwise("toxic"), (F.col("doc_id") % 7).cast("string")).alias("tag"),
        F.round(F.col("n_chars") % 1000 / 1000.0, 3).alias("p"),
        F.when((F.col("doc_id") % 11 < 9) | (F.col("quality") + F.col("toxic") == 2), 1).otherwise(0).alias("truth"))


_CUTS = f"WITH s AS ({_SCORE}), c AS (SELECT tag, p, sum(truth) OVER w AS hits, count(*) OVER w AS rank FROM s WHERE p >= 0.5 WINDOW w AS (PARTITION BY tag ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@plan("win2_precision_threshold", _CUTS + "SELECT tag, min(p) AS threshold FROM c WHERE hits >= 3 AND hits / rank >= 0.85 GROUP BY tag")
def _(lib):
    return L.threshold(scores(lib), "tag")


@plan("win3_best_precision", _CUTS + "SELECT tag, round(max(hits / rank), 9) AS best_precision FROM c WHERE hits >= 3 GROUP BY tag")
def _(lib):
    return L.best_precision(scores(lib), "tag").withColumn("best_precision", F.round("best_precision", 9))


# --- segmentation stages ------------------------------------------------------------------------

@plan("seg1_prepared_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split('- *note*' || chr(10) || text || chr(10) || '  • ', chr(10))) AS line, generate_subscripts(string_split('- *note*' || chr(10) || text || chr(10) || '  • ', chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, CASE WHEN line = '- *note*' THEN 'note' WHEN trim(line) = '•' THEN '' ELSE trim(line) END AS line FROM l)
SELECT doc_id, count(*) AS n FROM p WHERE line <> '' GROUP BY doc_id""")
def _(lib):
    text = F.concat(F.lit("- *note*\n"), "text", F.lit("\n  • "))
    return lib.documents().select("doc_id", F.size(G.prepared(text)).cast("bigint").alias("n"))


@plan("seg2_line_predicates", r"""
WITH l AS (SELECT line FROM v_docline UNION ALL SELECT line || ':' FROM v_docline WHERE words <= 2 UNION ALL SELECT (words + 1) || ' ' || line FROM v_docline)
SELECT count(*) FILTER (regexp_matches(line, '^\s*[0-9]')) AS quantity, count(*) FILTER (line LIKE '%:' AND NOT regexp_matches(line, '^\s*[0-9]') AND len(regexp_extract_all(line, '\S+')) <= 6) AS section_colon,
 count(*) FILTER (regexp_matches(line, '^\s*[0-9]{1,2}(?:[.):]\s*|\s+)[A-ZÀ-ÖØ-Þ]')) AS step_start FROM l""")
def _(lib):
    d = doclines(lib)
    l = d.select("line").unionAll(d.filter("words <= 2").select(F.concat("line", F.lit(":")))).unionAll(
        d.select(F.concat((F.col("words") + 1).cast("string"), F.lit(" "), "line")))
    c = F.col("line")
    return l.agg(F.count_if(G.PREDICATES["quantity"](c)).alias("quantity"), F.count_if(G.section_label(c) & c.endswith(":")).alias("section_colon"),
                 F.count_if(G.PREDICATES["step_start"](c)).alias("step_start"))


@plan("seg2_predicate_profile")
def _(lib):
    one = doclines(lib).select("line").distinct()
    each = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("predicate"), f(F.col("line")).alias("hit")) for n, f in G.PREDICATES.items()])))
    return each.groupBy("predicate").agg(F.count_if("hit").alias("lines"), F.count(F.lit(1)).alias("of"))


def as_recipes(lib):
    """Every document dressed as a recipe: headings and measured lines around its text."""
    t, k = F.col("text"), F.col("doc_id") % 3
    ing = F.lit("Ingredients\n2 cups flour\n1 tbsp sugar\nSalt to taste\n")
    return lib.documents().select("doc_id", F.when(k == 0, F.concat(F.lit("A Plain Name\nServes 4\n"), ing, F.lit("Instructions\n"), t))
                                  .when(k == 1, F.concat(F.lit("A Plain Name\nMakes 6 rolls\n"), ing, F.lit("1. Mix everything.\n2. Bake.\nNotes\n"), t))
                                  .otherwise(F.concat(F.lit("A Plain Name\nold note\n2 cups flour\n1 tbsp sugar\nMix everything together well.\n"), F.translate(t, "\n", " "))).alias("text"))


_ROUTE = "CASE doc_id % 3 WHEN 0 THEN 'both headings' WHEN 1 THEN 'numbered steps' ELSE 'no headings' END"


@plan("seg3_routes", f"SELECT {_ROUTE} AS route, count(*) AS n FROM documents GROUP BY 1")
def _(lib):
    return G.segment(as_recipes(lib)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@plan("seg4_ingredients", "SELECT doc_id, '2 cups flour|1 tbsp sugar' || CASE WHEN doc_id % 3 < 2 THEN '|Salt to taste' ELSE '' END AS ingredients FROM documents")
def _(lib):
    return G.segment(as_recipes(lib)).select("doc_id", F.array_join("ingredients", "|").alias("ingredients"))


@plan("seg5_steps", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'Mix everything.|Bake.' WHEN 2 THEN 'Mix everything together well.' END AS steps FROM documents")
def _(lib):
    s = F.col("steps")
    return G.segment(as_recipes(lib)).select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.array_join(s, "|")).when(F.col("doc_id") % 3 == 2, F.get(s, F.lit(0))).alias("steps"))


@plan("seg6_component_records")
def _(lib):
    t = F.element_at(F.split("text", "\n"), 1)
    parts = F.concat(F.lit("Two Parts\nDough\n2 cups flour\n1 egg\nMix everything together and rest it well.\nFilling\n3 apples\n1 cup sugar\nCook the apples slowly until soft. "), t, F.lit("."))
    return G.segment(lib.documents().select("doc_id", parts.alias("text"))).select("doc_id", "route", F.array_join("ingredients", "|").alias("ingredients"), F.size("steps").alias("n_steps"))


@plan("seg7_titles", "SELECT doc_id, 'A Plain Name' AS title FROM documents")
def _(lib):
    return G.segment(as_recipes(lib)).select("doc_id", "title")


@plan("seg8_servings", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '4' WHEN 1 THEN '6 rolls' END AS servings FROM documents")
def _(lib):
    first = F.slice(G.prepared(F.col("text")), 1, 12)
    return as_recipes(lib).select("doc_id", F.get(F.array_compact(F.transform(first, G.yield_text)), F.lit(0)).alias("servings"))


@plan("seg9_left_out", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'old note' ELSE '' END AS left_out FROM documents")
def _(lib):
    return G.segment(as_recipes(lib)).select("doc_id", F.array_join("left_out", "|").alias("left_out"))


@plan("seg10_message_source", """
SELECT page_id AS msg_id, page_id % 3 < 2 AS found, CASE page_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'body' END AS kind,
 CASE page_id % 3 WHEN 1 THEN 'document: no steps' WHEN 2 THEN 'document: no steps; body: no ingredients and steps' ELSE '' END AS reasons FROM pages""")
def _(lib):
    ing = "Name of It\nIngredients\n2 cups flour\n1 egg\n"
    k = F.col("page_id") % 3
    doc = F.struct(F.lit(0).alias("priority"), F.lit("document").alias("kind"), F.when(k == 0, F.lit(ing + "1. Mix everything.\n2. Bake.")).otherwise(F.lit(ing)).alias("text"))
    body = F.struct(F.lit(3).alias("priority"), F.lit("body").alias("kind"), F.when(k < 2, F.lit(ing + "1. Mix everything.\n2. Bake.")).otherwise(F.col("url")).alias("text"))
    cand = lib.pages().select(F.col("page_id").alias("msg_id"), "url", F.inline(F.array(doc, body))).withColumn("doc_id", F.concat_ws("/", "msg_id", "kind"))
    seg = G.segment(cand.select("doc_id", "text"))
    return G.best_source(cand.select("msg_id", "priority", "kind", "doc_id").join(seg, "doc_id")).select("msg_id", "found", "kind", "reasons")


@plan("udf1_pluggable_segmenter", f"SELECT CASE WHEN doc_id % 2 = 1 THEN 'learned' ELSE {_ROUTE} END AS route, count(*) AS n FROM documents GROUP BY 1")
def _(lib):
    def learned(docs, rules):      # a model that has an answer for some texts
        return rules.filter("doc_id % 2 = 1").select("doc_id", F.upper("title").alias("title"), "ingredients", "steps")
    return G.segment(as_recipes(lib), learned).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@plan("src21_log_records", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^([A-D]\S*)\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS rec FROM l),
r AS (SELECT doc_id, rec, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS record FROM g GROUP BY ALL)
SELECT doc_id, i, regexp_extract(record, '^([A-D]\S*)\s', 1) AS level, md5(record) AS record_md5 FROM r WHERE regexp_extract(record, '^([A-D]\S*)\s', 1) IN ('An', 'And', 'At', 'Be', 'By', 'De', 'Du')""")
def _(lib):
    # words at the start of a line stand in for the time and level of a log line
    r = L.log_records(lib.documents(), "doc_id", r"^([A-D]\S*)\s", ["An", "And", "At", "Be", "By", "De", "Du"])
    return r.select("doc_id", "i", "level", F.md5("record").alias("record_md5"))


@plan("src23_page_text", r"""
SELECT page_id, md5(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS text_md5 FROM (
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'),
 '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>', '', 'g'),
 '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-4])\s*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM pages)""")
def _(lib):
    return lib.pages().select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5"))


@plan("src24_plain_from_markdown", r"""
SELECT doc_id, md5('Title' || chr(10) || trim(array_to_string(list_transform(string_split(translate(text, '*_#>`~[-', ''), chr(10)), lambda l: trim(l)), chr(10)), chr(10) || ' ' || chr(9)) || chr(10) || 'see link') AS text_md5 FROM documents""")
def _(lib):
    words = T.markdown_to_text(F.translate("text", "*_#>`~[-", ""))
    md = F.concat(F.lit("# Title #\n---\n"), words, F.lit("\n> **see** [link](http://x.example/)\n```"))
    return lib.documents().select("doc_id", F.md5(T.markdown_to_text(md)).alias("text_md5"))


@plan("src21_newest_records", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^([A-D]\S*)\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS rec FROM l),
r AS (SELECT doc_id, rec, min(i) AS i, string_agg(line, chr(10) ORDER BY i) AS record FROM g GROUP BY ALL)
SELECT doc_id, i, md5(record) AS record_md5, place FROM (SELECT *, row_number() OVER (ORDER BY doc_id DESC, i DESC) AS place FROM r WHERE regexp_matches(record, '^([A-D]\S*)\s')) WHERE place <= 300""")
def _(lib):
    r = L.log_records(lib.documents(), "doc_id", r"^([A-D]\S*)\s").filter("level IS NOT NULL")
    return L.newest_records(r, ["doc_id", "i"], 300).select("doc_id", "i", F.md5("record").alias("record_md5"), F.col("place").cast("bigint").alias("place"))


@plan("seg3_library_texts", """
SELECT recipe_id AS doc_id, 'both headings' AS route, 'Plain Dish Number ' || recipe_id AS title, string_agg(CAST(quantity AS VARCHAR) || ' ' || unit || ' ' || name, '|' ORDER BY position) AS ingredients,
 string_agg('Mix the ' || name || ' with part ' || (position + 1) || '.', '|' ORDER BY position) AS steps, CAST(2 + recipe_id % 7 AS VARCHAR) AS servings FROM v_ingredient GROUP BY recipe_id""")
def _(lib):
    """Every record of the library written out as a text and read back: title, all items, all steps and servings."""
    listed = lib.lines().groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("ord", "raw_line", "name"))).alias("ls"))
    step = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Mix the "), x["name"], F.lit(" with part "), (i + 1).cast("string"), F.lit("."))
    text = F.concat(F.lit("Plain Dish Number "), F.col("recipe_id").cast("string"), F.lit("\nServes "), (2 + F.col("recipe_id") % 7).cast("string"), F.lit("\nIngredients\n"),
                    F.array_join(F.transform("ls", lambda x: x["raw_line"]), "\n"), F.lit("\nInstructions\n"), F.array_join(F.transform("ls", step), "\n"))
    s = G.segment(listed.select(F.col("recipe_id").alias("doc_id"), text.alias("text")))
    return s.select("doc_id", "route", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), "servings")
