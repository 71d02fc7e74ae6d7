"""Keys, duplicates, set operations and the life of records."""
from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T, words as W
from quern.operators import dedupe as D, lifecycle as L, sets as X
from quern.plans.registry import plan


def duck_link(c: str) -> str:
    """The link key in DuckDB, as one expression over column c."""
    pat = r"(?i)^\s*(https?)://(?:[^/?#]*@)?([^/?#:@\s]+)(?::([0-9]*))?(/[^?#\s]*)?(?:\?([^#\s]*))?(?:#.*)?\s*$"
    x = lambda n: f"regexp_extract({c}, '{pat}', {n})"
    port = f"try_cast({x(3)} AS INT)"
    pairs = (f"list_sort(list_filter(list_transform(list_filter(string_split({x(5)}, '&'), lambda p: p <> ''), "
             f"lambda p: {{'k': split_part(p, '=', 1), 'v': CASE WHEN contains(p, '=') THEN p[strpos(p, '=') + 1:] ELSE '' END}}), "
             f"lambda q: NOT regexp_matches(q.k, '(?i){W.TRACKING_PARAM}')))")
    query = f"array_to_string(list_transform({pairs}, lambda q: q.k || '=' || q.v), '&')"
    return (f"CASE WHEN regexp_matches({c}, '{pat}') THEN regexp_replace(lower({x(2)}), '^www\\.', '') || "
            f"CASE WHEN {port} > 0 AND {port} <> CASE WHEN lower({x(1)}) = 'http' THEN 80 ELSE 443 END THEN ':' || {port} ELSE '' END || "
            f"regexp_replace({x(4)}, '/+$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END")


def duck_title(c: str) -> str:
    return f"nullif(trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"


KEYED = f"k AS (SELECT id, title, {duck_link('source_url')} AS lk, {duck_title('title')} AS tk FROM v_live)"


@plan("enr7_link_keys", f"SELECT page_id, {duck_link('url')} AS link_key FROM pages")
def _(lib):
    return lib.pages().select("page_id", T.link_key(F.col("url")).alias("link_key"))


@plan("enr8_title_keys", rf"""
SELECT page_id, {duck_title("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title_key FROM pages""")
def _(lib):
    return lib.pages().select("page_id", T.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"))


@plan("enr9_folded_text", """
SELECT doc_id, md5(strip_accents(replace(replace(replace(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae'), '’', ''''), '‘', ''''), '`', ''''))) AS folded_md5 FROM documents""")
def _(lib):
    return lib.documents().select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded_md5"))


@plan("joi3_duplicate_lookup", f"""
WITH {KEYED}, pairs AS (
 SELECT a.id AS probe_id, b.id, b.title, 'link' AS reason, 0 AS o FROM k a JOIN k b ON a.lk = b.lk AND a.id <> b.id
 UNION ALL SELECT a.id, b.id, b.title, 'title', 1 FROM k a JOIN k b ON a.tk = b.tk AND a.id <> b.id AND a.lk IS DISTINCT FROM b.lk
 UNION ALL SELECT a.id, b.id, b.title, 'title', 1 FROM k a JOIN k b ON a.tk = b.tk AND a.id <> b.id AND a.lk IS NULL AND b.lk IS NULL)
SELECT probe_id, rank, id, title, reason FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY o, id) AS rank FROM pairs) WHERE rank <= 5""")
def _(lib):
    k = D.keyed(lib.live())
    return D.lookup(k, k)


@plan("joi4_dedupe_index", f"""
WITH {KEYED} SELECT 'link' AS kind, lk AS key, min(id) AS id, arg_min(title, id) AS title FROM k WHERE lk IS NOT NULL GROUP BY lk
UNION ALL SELECT 'title', tk, min(id), arg_min(title, id) FROM k WHERE tk IS NOT NULL GROUP BY tk""")
def _(lib):
    return D.index(D.keyed(lib.live()))


@plan("joi5_duplicate_groups", f"""
WITH RECURSIVE {KEYED},
e AS (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.lk = b.lk UNION SELECT a.id, b.id FROM k a JOIN k b ON a.tk = b.tk),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
g AS (SELECT x AS id, min(y) AS group_id FROM r GROUP BY x)
SELECT group_id, id, title FROM g JOIN k USING (id) WHERE group_id IN (SELECT group_id FROM g GROUP BY group_id HAVING count(*) > 1)""")
def _(lib):
    return D.groups(D.keyed(lib.live()))


@plan("src9_bulk_import", f"""
WITH {KEYED}, l AS (SELECT *, 0 AS src FROM k WHERE id % 4 <> 0 UNION ALL SELECT *, 1 FROM k WHERE id % 4 = 0),
fl AS (SELECT id, src, title, tk, first_value(id) OVER (PARTITION BY lk ORDER BY src, id) AS f, lk FROM l),
s AS (SELECT *, CASE WHEN src = 1 AND lk IS NOT NULL AND f <> id THEN f END AS link_of FROM fl),
ft AS (SELECT id, first_value(id) OVER (PARTITION BY tk ORDER BY src, id) AS t FROM s WHERE link_of IS NULL AND tk IS NOT NULL)
SELECT s.id, title, CASE WHEN link_of IS NULL THEN 'saved' ELSE 'skipped' END AS status, coalesce(link_of, CASE WHEN t <> s.id THEN t END) AS existing_id
FROM s LEFT JOIN ft ON ft.id = s.id WHERE src = 1 AND link_of IS NULL
UNION ALL SELECT s.id, title, 'skipped', link_of FROM s WHERE src = 1 AND link_of IS NOT NULL""")
def _(lib):
    k = D.keyed(lib.live())
    return D.import_batch(k.filter("id % 4 <> 0"), k.filter("id % 4 = 0").withColumn("seq", F.col("id")))


@plan("src10_batch_links_report", f"""
WITH p AS (SELECT page_id, {duck_link('url')} AS lk, len(regexp_extract_all(html, '<li')) AS items, len(regexp_extract_all(html, '<br>')) AS steps FROM pages),
known AS (SELECT DISTINCT lk FROM p WHERE page_id % 3 = 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN lk IS NULL THEN 'failed: not a web address' WHEN lk IN (SELECT lk FROM known) THEN 'skipped'
 WHEN items = 0 OR steps = 0 THEN 'failed: incomplete' ELSE 'succeeded' END AS status FROM p WHERE page_id % 3 <> 0) GROUP BY status""")
def _(lib):
    p = lib.pages().select("page_id", T.link_key(F.col("url")).alias("lk"), F.regexp_count("html", F.lit("<li")).alias("items"),
                           F.regexp_count("html", F.lit("<br>")).alias("steps"))
    known = p.filter("page_id % 3 = 0 AND lk IS NOT NULL").select("lk").distinct().withColumn("known", F.lit(True))
    batch = p.filter("page_id % 3 <> 0").join(known, "lk", "left")
    status = (F.when(F.col("lk").isNull(), "failed: not a web address").when(F.col("known"), "skipped")
              .when((F.col("items") == 0) | (F.col("steps") == 0), "failed: incomplete").otherwise("succeeded"))
    return batch.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@plan("joi9_label_match", """
WITH lab AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN lower(p_type) ELSE p_name END AS label FROM lineitem JOIN part ON p_partkey = l_partkey),
known AS (SELECT lower(tag_name) AS lname, arg_min(tag_name, category || tag_name) AS tag_name, min(category) AS category FROM v_tag GROUP BY 1)
SELECT DISTINCT doc_id, coalesce(tag_name, label) AS tag_name, coalesce(category, 'custom') AS category FROM lab LEFT JOIN known ON lname = lower(label)""")
def _(lib):
    li = lib.table("lineitem").join(lib.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    labels = li.select(F.col("l_orderkey").alias("doc_id"),
                       F.when(F.col("l_linenumber") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_name")).alias("label")).distinct()
    return X.match_labels(labels, lib.tags(), keep_unknown=True)


@plan("joi10_merge_records", """
WITH pairs AS (SELECT id AS keep_id, id + 1 AS other_id FROM v_live WHERE id % 7 = 2 AND id + 1 IN (SELECT id FROM v_live)),
t AS (SELECT keep_id, count(*) AS n_tags, string_agg(tag_name, ' ' ORDER BY tag_name) AS tags_text FROM
 (SELECT DISTINCT keep_id, tag_name, category FROM pairs JOIN v_recipe_tag ON recipe_id = keep_id OR recipe_id = other_id) GROUP BY keep_id)
SELECT k.id, o.id AS other_id, k.title, o.image_path, k.source_type, CASE WHEN o.source_url IS NULL AND k.source_type = 'url' THEN k.source_url ELSE o.source_url END AS source_url,
 o.favorite, o.tastiness_rating, nullif(concat_ws(chr(10) || chr(10), nullif(trim(k.notes), ''), nullif(trim(o.notes), '')), '') AS notes,
 coalesce(n_tags, 0) AS n_tags, coalesce(tags_text, '') AS tags_text, false AS needs_review
FROM pairs p JOIN v_live k ON k.id = p.keep_id JOIN v_live o ON o.id = p.other_id LEFT JOIN t ON t.keep_id = p.keep_id""")
def _(lib):
    live = lib.live()
    ids = live.select("id")
    pairs = (ids.filter("id % 7 = 2").select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("other_id"))
             .join(ids.withColumnRenamed("id", "other_id"), "other_id", "left_semi"))
    take = {"title": "keep", "photo": "other", "content": "keep", "source": "other", "ratings": "other", "notes": "both"}
    return X.merge_pairs(pairs, live, lib.recipe_tags(), take)[0]


_LATEST = """
WITH last AS (SELECT entity_id, kind, CASE WHEN value >= 20 THEN value END AS value, row_number() OVER (PARTITION BY entity_id, kind ORDER BY ts DESC, event_id DESC) AS rn FROM v_change)"""


@plan("joi12_latest_state", _LATEST + """
SELECT c_custkey AS entity_id, CASE WHEN v.entity_id IS NOT NULL THEN v.value ELSE c_acctbal END AS view,
 CASE WHEN p.entity_id IS NOT NULL THEN p.value ELSE NULL END AS purchase, CASE WHEN k.entity_id IS NOT NULL THEN k.value ELSE CAST(c_nationkey AS DOUBLE) END AS click
FROM customer LEFT JOIN (SELECT * FROM last WHERE rn = 1 AND kind = 'view') v ON v.entity_id = c_custkey
 LEFT JOIN (SELECT * FROM last WHERE rn = 1 AND kind = 'purchase') p ON p.entity_id = c_custkey
 LEFT JOIN (SELECT * FROM last WHERE rn = 1 AND kind = 'click') k ON k.entity_id = c_custkey""")
def _(lib):
    ch = lib.changes().filter(F.col("kind").isin("view", "purchase", "click")).select(
        "entity_id", F.col("kind").alias("field"), "ts", "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    last = D.latest(ch, ["entity_id", "field"], [F.col("ts"), F.col("event_id")], "value")
    snap = lib.table("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("view"),
                                        F.lit(None).cast("double").alias("purchase"), F.col("c_nationkey").cast("double").alias("click"))
    return X.apply_changes(snap, last, "entity_id", ["view", "purchase", "click"])


@plan("set1_match_provenance", """
WITH t AS (SELECT DISTINCT recipe_id AS id FROM v_line WHERE name LIKE '%anvil%'), g AS (SELECT recipe_id AS id FROM v_recipe_tag WHERE tag_name = 'PROMO')
SELECT id, CASE WHEN t.id IS NOT NULL AND g.id IS NOT NULL THEN 'tag,text' WHEN t.id IS NOT NULL THEN 'text' ELSE 'tag' END AS matched_via,
 CASE WHEN t.id IS NOT NULL THEN 1 ELSE 2 END AS score FROM t FULL JOIN g USING (id)""")
def _(lib):
    text = lib.lines().filter(F.col("name").contains("anvil")).select(F.col("recipe_id").alias("id"), F.lit("text").alias("via"), F.lit(1).alias("score"))
    tag = lib.recipe_tags().filter("tag_name = 'PROMO'").select(F.col("recipe_id").alias("id"), F.lit("tag").alias("via"), F.lit(2).alias("score"))
    return text.unionAll(tag).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("matched_via"),
                                                F.min("score").cast("bigint").alias("score"))


@plan("set2_include_minus_exclude", """
SELECT recipe_id AS id FROM v_recipe_tag WHERE tag_name = 'PROMO' EXCEPT SELECT recipe_id FROM v_recipe_tag WHERE tag_name = 'A'""")
def _(lib):
    b = lib.recipe_tags()
    ids = lambda t: b.filter(F.col("tag_name") == t).select(F.col("recipe_id").alias("id"))
    return ids("PROMO").join(ids("A"), "id", "left_anti")


@plan("set3_batch_tag", """
WITH req AS (SELECT DISTINCT o_orderkey * 2 AS id FROM orders), s AS (SELECT recipe_id AS id, count(*) AS n, bool_or(tag_name = 'PROMO') AS has FROM v_recipe_tag GROUP BY 1)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM v_live) THEN 'missing' WHEN coalesce(has, false) THEN 'unchanged' WHEN coalesce(n, 0) >= 9 THEN 'full' ELSE 'changed' END AS status
FROM req LEFT JOIN s USING (id)""")
def _(lib):
    ids = lib.table("orders").select((F.col("o_orderkey") * 2).alias("id"))
    return X.batch_tag(lib.live(), lib.recipe_tags(), ids, "PROMO", "meal_type", max_tags=9)[0]


@plan("set3_batch_untag", """
SELECT category, count(*) AS n FROM v_recipe_tag WHERE NOT (tag_name = 'PROMO' AND category = 'meal_type' AND recipe_id IN (SELECT id FROM v_live)) GROUP BY category""")
def _(lib):
    live = lib.live()
    new = X.batch_tag(live, lib.recipe_tags(), live.select("id"), "PROMO", "meal_type", action="remove")[1]
    return new.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_TAGWORDS = [("widget", "PROMO", "meal_type"), ("gear", "LARGE", "meal_type"), ("red bolt", "Brand#1", "main_ingredient"), ("anvil", "A", "cooking_style")]
_SUGGEST = ("SELECT DISTINCT recipe_id, tag_name, category FROM v_line JOIN (VALUES " +
            ", ".join(str(w) for w in _TAGWORDS) + ") w(kw, tag_name, category) ON ' ' || name || ' ' LIKE '% ' || kw || ' %'")


@plan("set4_bulk_auto_tag", f"""
WITH s AS ({_SUGGEST}), picked AS (SELECT * FROM s WHERE recipe_id % 4 <> 1)
SELECT tag_name, category, count(*) AS added FROM (SELECT * FROM picked WHERE recipe_id IN (SELECT id FROM v_live WHERE NOT (id % 9 = 0))
 EXCEPT SELECT * FROM v_recipe_tag) GROUP BY ALL""")
def _(lib):
    from quern.operators import lexicon as LX
    words = lib.spark.createDataFrame([(n, c, i, k) for i, (k, n, c) in enumerate(_TAGWORDS)], "tag_name string, category string, ord int, keyword string")
    docs = lib.lines().select(F.col("recipe_id").alias("doc_id"), F.col("name").alias("text")).distinct()
    found = LX.keyword_hits(docs, "doc_id", "text", words).select(F.col("doc_id").alias("recipe_id"), "tag_name", "category")
    records = lib.live().withColumn("autotag_ignored", F.col("id") % 9 == 0)
    picks = found.filter("recipe_id % 4 <> 1").select("recipe_id", "tag_name").distinct()
    new = X.auto_apply(records, lib.recipe_tags(), found, W.MEAT_TAGS, picks)
    return new.groupBy("tag_name", "category").agg(F.count(F.lit(1)).alias("added"))


@plan("set5_suggestion_algebra", """
WITH kw AS (SELECT recipe_id AS doc_id, CASE tag_name WHEN 'SMALL' THEN 'Vegetarian' WHEN 'LARGE' THEN 'Beef' ELSE tag_name END AS tag_name, 'main_ingredient' AS category, 'keyword' AS why
  FROM v_recipe_tag WHERE category = 'meal_type'),
le AS (SELECT recipe_id AS doc_id, CASE tag_name WHEN 'Brand#1' THEN 'Vegetarian' WHEN 'Brand#2' THEN 'Fish' WHEN 'Brand#3' THEN 'Unknown' ELSE tag_name END AS tag_name, 'main_ingredient' AS category, 'learned' AS why
  FROM v_recipe_tag WHERE category = 'main_ingredient' AND tag_name IN ('Brand#1', 'Brand#2', 'Brand#3')),
fresh AS (SELECT * FROM le WHERE tag_name <> 'Unknown' AND (doc_id, tag_name) NOT IN (SELECT doc_id, tag_name FROM kw)),
b AS (SELECT * FROM kw UNION ALL SELECT * FROM fresh),
f AS (SELECT doc_id, bool_or(tag_name IN ('Beef', 'Fish')) AS meat, bool_or(tag_name = 'Vegetarian' AND why = 'keyword') AS kv FROM b GROUP BY doc_id)
SELECT doc_id, tag_name, category, why FROM b JOIN f USING (doc_id) WHERE NOT (tag_name = 'Vegetarian' AND meat) AND NOT (tag_name = 'Vegetarian' AND why = 'learned' AND NOT kv)""")
def _(lib):
    b = lib.recipe_tags()
    kw = b.filter("category = 'meal_type'").select(
        F.col("recipe_id").alias("doc_id"), F.expr("CASE tag_name WHEN 'SMALL' THEN 'Vegetarian' WHEN 'LARGE' THEN 'Beef' ELSE tag_name END").alias("tag_name"),
        F.lit("main_ingredient").alias("category"), F.lit("keyword").alias("why"))
    le = b.filter("category = 'main_ingredient' AND tag_name IN ('Brand#1', 'Brand#2', 'Brand#3')").select(
        F.col("recipe_id").alias("doc_id"), F.expr("CASE tag_name WHEN 'Brand#1' THEN 'Vegetarian' WHEN 'Brand#2' THEN 'Fish' ELSE 'Unknown' END").alias("tag_name"),
        F.lit("main_ingredient").alias("category"), F.lit("learned").alias("why"))
    known = lib.spark.createDataFrame([(n, c) for n, c, _s in W.SEED_TAGS], "tag_name string, category string")
    return X.combine_suggestions(kw, le, known, W.MEAT_TAGS)


@plan("set6_merge_tag_lists", """
WITH p AS (SELECT id, id + 2 AS o FROM v_live WHERE id % 10 = 1)
SELECT id, string_agg(DISTINCT tag_name, ' ' ORDER BY tag_name) AS tags_text FROM p JOIN v_recipe_tag ON recipe_id = id OR recipe_id = o GROUP BY id""")
def _(lib):
    p = lib.live().filter("id % 10 = 1").select("id", F.explode(F.array(F.col("id"), F.col("id") + 2)).alias("recipe_id"))
    return p.join(lib.recipe_tags(), "recipe_id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag_name")), " ").alias("tags_text"))


@plan("set7_remove_tags", """
SELECT category, count(*) AS links_left, (SELECT count(DISTINCT recipe_id) FROM v_recipe_tag WHERE category = 'main_ingredient' AND tag_name < 'Brand#2') AS touched
FROM v_recipe_tag WHERE NOT (category = 'main_ingredient' AND tag_name < 'Brand#2') GROUP BY category""")
def _(lib):
    gone = lib.tags().filter("category = 'main_ingredient' AND tag_name < 'Brand#2'").select("tag_name", "category")
    left, touched = X.remove_tags(lib.recipe_tags(), gone)
    return left.groupBy("category").agg(F.count(F.lit(1)).alias("links_left")).withColumn("touched", touched.scalar())


@plan("set8_category_repair", """
WITH b AS (SELECT * FROM v_recipe_tag UNION SELECT recipe_id, tag_name, 'custom' FROM v_recipe_tag WHERE recipe_id % 5 = 0 AND tag_name = 'PROMO')
SELECT tag_name, category, count(*) AS n FROM (SELECT DISTINCT recipe_id, tag_name, CASE WHEN category IN ('cooking_style', 'custom') THEN category ELSE 'custom' END AS category FROM b) GROUP BY ALL""")
def _(lib):
    b = lib.recipe_tags()
    extra = b.filter("recipe_id % 5 = 0 AND tag_name = 'PROMO'").withColumn("category", F.lit("custom"))
    return (X.repair_categories(b.unionByName(extra), ["cooking_style", "custom"]).groupBy("tag_name", "category").agg(F.count(F.lit(1)).alias("n")))


@plan("set9_copy_records", """
SELECT id + (SELECT max(id) FROM v_live) + 1 AS id, id AS copied_from, substring(title, 1, 493) || ' (copy)' AS title, source_url, tastiness_rating, false AS favorite, false AS needs_review
FROM v_live WHERE id % 100 = 7""")
def _(lib):
    return X.copy_records(lib.live(), F.col("id") % 100 == 7)


NOW = "TIMESTAMP '1998-06-01 12:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ '1998-06-01 12:00:00'")


@plan("srt6_recently_deleted", f"""
SELECT id, title, greatest(0, CAST(ceil((epoch_us(deleted_at + INTERVAL 30 DAY) - epoch_us({NOW})) / 86400000000.0) AS BIGINT)) AS days_left FROM v_recipe WHERE deleted_at IS NOT NULL
ORDER BY deleted_at DESC, id DESC""")
def _(lib):
    return L.recently_deleted(lib.recipes().orderBy(F.desc("deleted_at"), F.desc("id")), now())


@plan("st7_purge_cascade", f"""
WITH gone AS (SELECT id FROM v_recipe WHERE deleted_at + INTERVAL 30 DAY < {NOW})
SELECT 'records' AS table_name, count(*) AS n FROM v_recipe WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'items', count(*) FROM v_ingredient WHERE recipe_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'tags', count(*) FROM v_recipe_tag WHERE recipe_id NOT IN (SELECT id FROM gone)""")
def _(lib):
    left = L.purge(lib.recipes(), {"items": lib.lines(), "tags": lib.recipe_tags()}, now())
    count = lambda n: left[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"))
    return count("records").unionAll(count("items")).unionAll(count("tags"))


@plan("st7_restore", "SELECT count(*) AS live FROM v_recipe WHERE deleted_at IS NULL OR id % 3 = 0")
def _(lib):
    r = lib.recipes()
    return L.restore(r, r.filter("id % 3 = 0").select("id")).filter("deleted_at IS NULL").agg(F.count(F.lit(1)).alias("live"))


@plan("src11_fit_limits", """
SELECT conv_id AS id, md5(string_agg(substring(text, 1, 20000), chr(10) ORDER BY turn)) AS steps_md5, count(*) AS n_steps,
 substring(any_value(t), 1, 500) AS title, CASE WHEN length(any_value(u)) <= 2000 THEN any_value(u) END AS source_url
FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t, 'http://x.example/' || repeat(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn), 4) AS u FROM conversations)
GROUP BY conv_id""")
def _(lib):
    c = lib.steps().groupBy(F.col("recipe_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("steps"),
        F.min_by("text", "position").alias("title"))
    c = c.withColumn("source_url", F.concat(F.lit("http://x.example/"), F.repeat("title", 4)))
    return L.fit_limits(c).select("id", F.md5(F.array_join("steps", "\n")).alias("steps_md5"), F.size("steps").cast("bigint").alias("n_steps"), "title", "source_url")


@plan("src14_redacted_export", """
SELECT c_custkey, '' AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment, true AS redacted FROM customer""")
def _(lib):
    return L.redact(lib.table("customer"), {"c_name": "", "c_acctbal": None})


@plan("src15_export_manifest", """
WITH w AS (SELECT DISTINCT image_path AS name FROM v_recipe WHERE image_path IS NOT NULL)
SELECT (SELECT count(*) FROM v_live) AS records, count(*) FILTER (w.name IS NOT NULL AND f.name IS NOT NULL) AS files,
 CAST(sum(bytes) FILTER (w.name IS NOT NULL AND f.name IS NOT NULL) AS BIGINT) AS total_bytes, count(*) FILTER (f.name IS NULL) AS missing, count(*) FILTER (w.name IS NULL) AS unreferenced
FROM w FULL JOIN v_file f ON w.name = f.name""")
def _(lib):
    return L.manifest(lib.recipes(), lib.files())


@plan("src16_snapshot_report", """
SELECT 'table items' AS item, 'damaged' AS value UNION ALL SELECT 'table records', 'ok'
UNION ALL SELECT 'live records', CAST(count(*) AS VARCHAR) FROM v_live UNION ALL SELECT 'photos', CAST(count(image_path) AS VARCHAR) FROM v_live
UNION ALL SELECT 'files', CAST(count(*) FILTER (regexp_matches(name, '^[a-z]+-[0-9]+[.]jpg$')) AS VARCHAR) FROM v_file
UNION ALL SELECT 'files left out', CAST(count(*) FILTER (NOT regexp_matches(name, '^[a-z]+-[0-9]+[.]jpg$')) AS VARCHAR) FROM v_file""")
def _(lib):
    required = {"records": ["id", "title", "deleted_at"], "items": ["recipe_id", "no_such_column"]}
    return L.validate_snapshot({"records": lib.recipes(), "items": lib.lines()}, required, lib.files(), "^[a-z]+-[0-9]+[.]jpg$")


@plan("src18_orphan_files", f"""
SELECT name, bytes FROM v_file WHERE modified < {NOW} - INTERVAL 24 HOUR AND name NOT IN (SELECT image_path FROM v_recipe WHERE image_path IS NOT NULL)""")
def _(lib):
    return L.orphan_files(lib.files(), lib.recipes(), now()).select("name", "bytes")
