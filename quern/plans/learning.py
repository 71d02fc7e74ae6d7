"""Alignment, features, models and evaluation on the documents and labels."""
from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.functions import text as T, words as W
from quern.operators import evaluate as V, learn as M, many as MT, segment as G
from quern.plans.registry import plan
from quern.plans.texts import doclines
from quern.session import checkpoint_dir, cut_lineage

_TOK = r"'[\p{L}\p{N}_]+'"


def items(lib):
    """Every third line saved as an ingredient, the next one as part of a step, and
    the first line as the title."""
    d = doclines(lib)
    third = d.filter("i % 3 < 2").select("doc_id", F.when(F.col("i") % 3 == 0, "ingredient").otherwise("step").alias("label"), F.col("i").alias("k"),
                                         F.when(F.col("i") % 3 == 0, F.col("line")).otherwise(F.concat("line", F.lit(" and more"))).alias("text"))
    first = d.groupBy("doc_id").agg(F.min_by("line", "i").alias("text")).select("doc_id", F.lit("title").alias("label"), F.lit(0).cast("bigint").alias("k"), "text")
    return third.unionByName(first)


def aligned(lib):
    return M.align(doclines(lib).select("doc_id", "i", "line"), items(lib))


_ALIGN = rf"""
WITH ln AS (SELECT doc_id, i, line, list_distinct(regexp_extract_all(strip_accents(lower(line)), {_TOK})) AS t FROM v_docline),
it AS (SELECT doc_id, CASE WHEN i % 3 = 0 THEN 'ingredient' ELSE 'step' END AS lab, i AS k, CASE WHEN i % 3 = 0 THEN t ELSE list_distinct(list_concat(t, ['and', 'more'])) END AS s FROM ln WHERE i % 3 < 2),
ti AS (SELECT doc_id, arg_min(t, i) AS s FROM ln GROUP BY doc_id),
tt AS (SELECT ln.doc_id, i FROM ln JOIN ti USING (doc_id) WHERE len(t) > 0 AND len(list_intersect(t, s)) / len(t) >= 0.8 AND len(list_intersect(t, s)) / len(s) >= 0.8),
f AS (SELECT ln.doc_id, i, lab, k, len(list_intersect(t, s)) / len(t) AS c, len(list_intersect(t, s)) / len(t) + 0.5 * len(list_intersect(t, s)) / len(s) AS score
 FROM ln JOIN it USING (doc_id) WHERE len(t) > 0 AND len(s) > 0 AND len(list_intersect(t, s)) / len(t) >= 0.75 AND (ln.doc_id, i) NOT IN (SELECT doc_id, i FROM tt)),
sd AS (SELECT doc_id, i, max(score) FILTER (lab = 'ingredient') AS si, max(score) FILTER (lab = 'step') AS ss FROM f GROUP BY ALL),
a AS (SELECT ln.doc_id, ln.i, CASE WHEN tt.i IS NOT NULL THEN 'title' WHEN si IS NULL AND ss IS NULL THEN 'other' WHEN ss IS NULL THEN 'ingredient' WHEN si IS NULL THEN 'step' END AS label,
 CASE WHEN si > ss THEN 'ingredient' ELSE 'step' END AS best FROM ln LEFT JOIN sd ON sd.doc_id = ln.doc_id AND sd.i = ln.i LEFT JOIN tt ON tt.doc_id = ln.doc_id AND tt.i = ln.i),
x AS (SELECT *, lag(label) OVER w AS pl, CASE WHEN label IS NULL AND lag(i) OVER w IS NOT NULL AND lag(label) OVER w IS NULL THEN 0 ELSE 1 END AS st FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run, first_value(CASE WHEN label IN ('ingredient', 'step') THEN label END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nl FROM x),
al AS (SELECT doc_id, i, coalesce(label, first_value(coalesce(CASE WHEN pl IN ('ingredient', 'step') THEN pl END, nl, best)) OVER (PARTITION BY doc_id, run ORDER BY i)) AS label FROM b)"""


@plan("joi8_alignment", _ALIGN + "SELECT doc_id, i, label FROM al")
def _(lib):
    return aligned(lib)[0].select("doc_id", "i", "label")


@plan("ml8_training_examples", _ALIGN + """,
bk AS (SELECT DISTINCT doc_id, lab, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i, lab ORDER BY score DESC, k) AS r FROM f) WHERE r = 1),
cv AS (SELECT it.doc_id, count(*) FILTER (lab = 'ingredient') AS ni, count(*) FILTER (lab = 'step') AS ns FROM it WHERE len(s) > 0 GROUP BY 1),
h AS (SELECT doc_id, count(*) FILTER (lab = 'ingredient') AS hi, count(*) FILTER (lab = 'step') AS hs FROM bk GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM al GROUP BY 1)
SELECT doc_id, n >= 3 AND coalesce(hi, 0) / ni >= 0.5 AND coalesce(hs, 0) / ns >= 0.5 AS imported, CASE WHEN n >= 3 AND coalesce(hi, 0) / ni >= 0.5 AND coalesce(hs, 0) / ns >= 0.5 THEN 1.0 ELSE 0.3 END AS weight
FROM cv JOIN n USING (doc_id) LEFT JOIN h USING (doc_id) WHERE ni > 0 AND ns > 0""")
def _(lib):
    labels, cov = aligned(lib)
    return M.examples(labels, cov)


@plan("agg12_transitions", _ALIGN + """,
lb AS (SELECT unnest(['other', 'title', 'ingredient', 'step']) AS l),
c AS (SELECT 'prior' AS kind, '-' AS a, label AS b FROM al UNION ALL SELECT 'start', '-', label FROM (SELECT label, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM al) WHERE r = 1
 UNION ALL SELECT 'step', label, nx FROM (SELECT label, lead(label) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM al) WHERE nx IS NOT NULL
 UNION ALL SELECT 'prior', '-', l FROM lb UNION ALL SELECT 'start', '-', l FROM lb UNION ALL SELECT 'step', p.l, q.l FROM lb p, lb q)
SELECT kind, a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind, a), 9) AS p FROM c GROUP BY kind, a, b""")
def _(lib):
    return M.transitions(aligned(lib)[0]).withColumn("p", F.round("p", 9))


@plan("agg11_eligible_tags", """
WITH t AS (SELECT doc_id, unnest([lang, source, lang || '/' || source]) AS tag FROM documents)
SELECT tag, count(DISTINCT doc_id) AS n FROM t GROUP BY tag HAVING count(DISTINCT doc_id) >= 5 AND (SELECT count(*) FROM documents) - count(DISTINCT doc_id) >= 5 ORDER BY n DESC, tag LIMIT 50""")
def _(lib):
    d = lib.documents()
    t = d.select("doc_id", F.explode(F.array("lang", "source", F.concat_ws("/", "lang", "source"))).alias("tag"))
    return M.eligible_tags(t, d.agg(F.count(F.lit(1))).scalar(), t.select("tag").distinct(), W.MAX_TAG_MODELS)


@plan("agg14_content_accuracy", _ALIGN + """,
z AS (SELECT al.label AS truth, CASE i % 3 WHEN 0 THEN 'ingredient' WHEN 1 THEN 'step' ELSE 'other' END AS pred FROM al)
SELECT count(*) FILTER (truth = pred AND truth <> 'other') AS "right", count(*) FILTER (truth <> 'other' OR pred <> 'other') AS counted,
 round(count(*) FILTER (truth = pred AND truth <> 'other') / count(*) FILTER (truth <> 'other' OR pred <> 'other'), 9) AS accuracy FROM z""")
def _(lib):
    third = F.when(F.col("i") % 3 == 0, "ingredient").when(F.col("i") % 3 == 1, "step").otherwise("other")
    return M.content_accuracy(aligned(lib)[0].select(F.col("label").alias("truth"), third.alias("pred"))).withColumn("accuracy", F.round("accuracy", 9))


@plan("ml1_line_features")
def _(lib):
    d = doclines(lib).select("doc_id", "i", "line", F.when(F.col("i") % 3 == 0, "ingredient").otherwise("step").alias("rule"))
    f = M.feature_cells(M.line_features(d))
    return f.groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


_FEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), {_TOK}) AS t FROM documents),
c AS (SELECT doc_id, 's:' || unnest(list_filter(t, lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\d+$'))) AS name, 0.5 AS v FROM w
 UNION ALL SELECT doc_id, 's:' || unnest(list_filter(list_transform(range(1, len(t)), lambda j: CASE WHEN regexp_matches(t[j], '^\d+$') OR regexp_matches(t[j + 1], '^\d+$') THEN NULL ELSE t[j] || '_' || t[j + 1] END), lambda x: x IS NOT NULL)), 0.25 FROM w),
f AS (SELECT doc_id, name, ln(1 + sum(v)) AS v FROM c GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM f GROUP BY doc_id)"""


def features(lib):
    return M.record_features(lib.documents(), {"text": ("s:", 0.5)})


@plan("ml2_record_features", _FEATS + "SELECT doc_id, count(*) AS n, round(sum(3 * v / norm), 6) AS total, max(name) AS last_name FROM f JOIN n USING (doc_id) GROUP BY doc_id")
def _(lib):
    return features(lib).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("name").alias("last_name"))


@plan("ml3_hashed_columns")
def _(lib):
    d = M.record_columns(lib.documents(), {"text": ("s:", 0.5)})
    return d.select("doc_id", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("vals").alias("value")))).withColumn("value", F.round("value", 6))


def labelled(lib):
    """(doc_id, features, tags) of the labelled documents."""
    tags = lib.table("labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("tags"))
    docs = lib.documents().join(tags.select("doc_id"), "doc_id", "left_semi")
    return M.vectors(M.record_columns(docs, {"text": ("s:", 0.5)}, beside=tags), ["doc_id", "tags"]).select("doc_id", "features", "tags")


@plan("ml4_line_model")
def _(lib):
    labels = cut_lineage(aligned(lib)[0])
    lab = F.array_position(F.array(*map(F.lit, M.LABELS)), F.col("label")).cast("double") - 1
    d = labels.withColumn("rule", F.when(F.col("i") % 3 == 0, "ingredient").otherwise("step"))
    rows = cut_lineage(M.vectors(M.hashed(M.line_features(d), ["doc_id", "i"]), ["doc_id", "i"]).join(labels.select("doc_id", "i", lab.alias("label_index")), ["doc_id", "i"]).withColumn("weight", F.lit(1.0)))
    model = M.softmax(rows, max_iter=5)
    scored = model.transform(rows)
    return scored.groupBy("label_index", "prediction").agg(F.count(F.lit(1)).alias("n"))


@plan("ml5_positive_weights", """
WITH y AS (SELECT 'quality' AS tag, quality AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels)
SELECT tag, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, round(least(5.0, greatest(1.0, sum(1 - y) / greatest(sum(y), 1))), 9) AS weight FROM y GROUP BY tag""")
def _(lib):
    y = lib.table("labels").select(F.inline(F.array(F.struct(F.lit("quality").alias("tag"), F.col("quality").cast("bigint").alias("y")), F.struct(F.lit("toxic").alias("tag"), F.col("toxic").cast("bigint").alias("y")))))
    return M.positive_weights(y).withColumn("weight", F.round("weight", 9))


@plan("ml5_tag_models")
def _(lib):
    rows = cut_lineage(labelled(lib))
    out = None
    for tag in ("quality", "toxic"):
        m = M.fit_tag(rows.withColumn("y", F.array_contains("tags", tag).cast("int")), 2.0, max_iter=10)
        p = m.transform(rows.withColumn("y", F.array_contains("tags", tag).cast("int"))).select("doc_id", F.lit(tag).alias("tag"), F.col("y").alias("truth"), F.round(vector_to_array("probability")[1], 3).alias("p"))
        out = p if out is None else out.unionByName(p)
    return out


@plan("ml6_grouped_folds", "SELECT doc_id, ('0x' || substr(md5('fold:' || doc_id), 1, 8))::BIGINT % 5 AS fold FROM documents")
def _(lib):
    return lib.documents().select("doc_id", M.fold(F.col("doc_id"), 5).alias("fold"))


_PATH = _ALIGN + """,
lb AS (SELECT unnest(['other', 'title', 'ingredient', 'step']) AS l),
tc AS (SELECT 'prior' AS kind, '-' AS a, label AS b FROM al UNION ALL SELECT 'start', '-', label FROM (SELECT label, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM al) WHERE r = 1
 UNION ALL SELECT 'step', label, nx FROM (SELECT label, lead(label) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM al) WHERE nx IS NOT NULL
 UNION ALL SELECT 'prior', '-', l FROM lb UNION ALL SELECT 'start', '-', l FROM lb UNION ALL SELECT 'step', p.l, q.l FROM lb p, lb q),
pr AS (SELECT kind, a, b, ln(count(*) / sum(count(*)) OVER (PARTITION BY kind, a)) AS p, list_position(['other', 'title', 'ingredient', 'step'], a) AS x, list_position(['other', 'title', 'ingredient', 'step'], b) AS y FROM tc GROUP BY kind, a, b),
st AS (SELECT list(p ORDER BY y) AS start FROM pr WHERE kind = 'start'), pi AS (SELECT list(p ORDER BY y) AS prior FROM pr WHERE kind = 'prior'),
sp AS (SELECT list(p ORDER BY x, y) AS step FROM pr WHERE kind = 'step'),
em AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn, list_transform([1, 2, 3, 4], lambda j: ln([0.1::DOUBLE, 0.1, CASE WHEN words % 3 = 0 THEN 0.6 ELSE 0.2 END, CASE WHEN words % 3 = 0 THEN 0.2 ELSE 0.6 END][j] + 1e-9) - prior[j]) AS e FROM v_docline, pi),
fw AS (SELECT doc_id, rn, list_transform([1, 2, 3, 4], lambda j: start[j] + e[j]) AS s, [0, 0, 0, 0] AS ptr FROM em, st WHERE rn = 1
 UNION ALL SELECT doc_id, rn, list_transform([1, 2, 3, 4], lambda j: list_max(c[j]) + e[j]), list_transform([1, 2, 3, 4], lambda j: list_position(c[j], list_max(c[j])))
 FROM (SELECT em.doc_id, em.rn, e, list_transform([1, 2, 3, 4], lambda j: list_transform([1, 2, 3, 4], lambda a: s[a] + step[(a - 1) * 4 + j])) AS c FROM fw JOIN em ON em.doc_id = fw.doc_id AND em.rn = fw.rn + 1, sp)),
bw AS (SELECT doc_id, rn, list_position(s, list_max(s)) AS label, ptr FROM fw JOIN (SELECT doc_id, max(rn) AS rn FROM em GROUP BY doc_id) USING (doc_id, rn)
 UNION ALL SELECT fw.doc_id, fw.rn, bw.ptr[bw.label], fw.ptr FROM bw JOIN fw ON fw.doc_id = bw.doc_id AND fw.rn = bw.rn - 1)
SELECT doc_id, i, ['other', 'title', 'ingredient', 'step'][bw.label] AS label FROM bw JOIN em USING (doc_id, rn)"""


@plan("ml7_best_path", _PATH.replace("WITH ln AS", "WITH RECURSIVE ln AS", 1))
def _(lib):
    probs = {(r["kind"], r["a"], r["b"]): r["p"] for r in M.transitions(aligned(lib)[0]).collect()}   # 24 rows
    e = doclines(lib).select("doc_id", "i", F.array(F.lit(0.1), F.lit(0.1), F.when(F.col("words") % 3 == 0, 0.6).otherwise(0.2), F.when(F.col("words") % 3 == 0, 0.2).otherwise(0.6)).alias("p"))
    return M.best_path(e, probs)


@plan("ml9_adoption", _ALIGN + """,
z AS (SELECT doc_id, label AS truth, CASE i % 3 WHEN 0 THEN 'ingredient' WHEN 1 THEN 'step' ELSE 'other' END AS learned, CASE WHEN i % 2 = 0 THEN 'ingredient' ELSE 'step' END AS rules FROM al),
r AS (SELECT count(DISTINCT doc_id) AS records, count(*) FILTER (truth = learned AND truth <> 'other') / count(*) FILTER (truth <> 'other' OR learned <> 'other') AS learned,
 count(*) FILTER (truth = rules AND truth <> 'other') / count(*) FILTER (truth <> 'other' OR rules <> 'other') AS rules FROM z)
SELECT records, round(learned, 9) AS learned, round(rules, 9) AS rules, CASE WHEN records < 8 THEN 'not_enough_data' WHEN learned < rules + 0.05 THEN 'rules_better' ELSE 'active' END AS status FROM r""")
def _(lib):
    third = F.when(F.col("i") % 3 == 0, "ingredient").when(F.col("i") % 3 == 1, "step").otherwise("other")
    s = aligned(lib)[0].select("doc_id", F.col("label").alias("truth"), third.alias("learned"), F.when(F.col("i") % 2 == 0, "ingredient").otherwise("step").alias("rules"))
    return M.adoption(s).withColumns({c: F.round(c, 9) for c in ("learned", "rules")})


@plan("ml10_tag_report")
def _(lib):
    rows = cut_lineage(labelled(lib))
    scores = cut_lineage(M.out_of_fold(rows, {"quality": 1.0, "toxic": 3.0}, 2))
    keyword = rows.filter("doc_id % 9 = 0").select("doc_id", F.explode("tags").alias("tag"))
    return M.tag_report(scores, keyword)


@plan("ml11_safeguards", """
SELECT conv_id AS doc_id, CASE conv_id % 5 WHEN 0 THEN 'no ingredients' WHEN 1 THEN 'measured lines lost' WHEN 2 THEN 'parts' WHEN 3 THEN 'no result' ELSE 'model' END AS outcome FROM conversations GROUP BY conv_id""")
def _(lib):
    c = lib.steps().groupBy(F.col("recipe_id").alias("doc_id")).agg(F.collect_list("text").alias("steps"))
    k = F.col("doc_id") % 5
    base = F.array(F.lit("2 cups flour"), F.lit("1 egg"), F.lit("salt"))
    rules = c.select("doc_id", F.when(k == 2, F.array_append(base, "Sauce:")).otherwise(base).alias("ingredients"), "steps")
    got = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("salt"))).otherwise(F.array(F.lit("2 Cups  flour"), F.lit("1 egg")))
    return M.safeguarded(rules, c.filter(k != 3).select("doc_id", got.alias("ingredients"), "steps")).select("doc_id", "outcome")


@plan("ml12_uncertain_lines", """
SELECT doc_id, i FROM (SELECT doc_id, i, words % 100 / 100.0 AS p, CASE WHEN i % 3 = 0 THEN 'ingredient' WHEN i % 3 = 1 THEN 'step' ELSE 'other' END AS label FROM v_docline) WHERE p < 0.6 AND label <> 'other'""")
def _(lib):
    d = doclines(lib).select("doc_id", "i", (F.col("words") % 100 / 100.0).alias("p"), F.when(F.col("i") % 3 == 0, "ingredient").when(F.col("i") % 3 == 1, "step").otherwise("other").alias("label"))
    return M.uncertain(d).select("doc_id", "i")


def _cases(lib):
    """Stored steps against the same steps, some of them changed."""
    s = lib.steps()
    k = F.col("recipe_id")
    return s.select(F.concat_ws("/", k.cast("string"), F.col("position").cast("string")).alias("case_id"), F.element_at(F.array(*map(F.lit, ["title", "prep_time", "steps"])), (F.col("position") % 3 + 1).cast("int")).alias("field"),
                    F.when(F.col("position") % 3 == 1, F.concat((k % 50 + 1).cast("string"), F.lit(" min"))).when(k % 4 == 0, F.upper("text")).when(k % 4 == 1, F.concat("text", F.lit(" x"))).when(k % 4 == 2, F.lit("")).otherwise(F.col("text")).alias("got"),
                    F.when(F.col("position") % 3 == 1, F.concat(F.lit("PT"), (F.when(k % 5 == 0, k % 50 + 2).otherwise(k % 50 + 1)).cast("string"), F.lit("M"))).otherwise(F.col("text")).alias("want"))


@plan("evl1_similarity")
def _(lib):
    return V.score_pairs(_cases(lib))


_SCORES = "SELECT conv_id || '/' || turn AS case_id, role AS type, CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, CASE turn % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'steps' ELSE 'ingredients' END AS field, CASE WHEN length(text) % 3 = 0 THEN 1.0 ELSE (length(text) % 100) / 100.0 END AS score FROM conversations"


def case_scores(lib):
    n = F.length("text")
    return lib.table("conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), F.col("role").alias("type"), F.when(F.col("turn") % 2 == 0, "en").otherwise("fr").alias("lang"),
        F.element_at(F.array(*map(F.lit, ["title", "steps", "ingredients"])), (F.col("turn") % 3 + 1).cast("int")).alias("field"), F.when(n % 3 == 0, 1.0).otherwise(n % 100 / 100.0).alias("score"))


@plan("agg13_evaluation_report", f"WITH s AS ({_SCORES}) SELECT type, lang, field, round(avg(score), 9) AS mean, count(*) FILTER (score = 1) AS exact, count(*) AS n FROM s GROUP BY ROLLUP (type, lang, field)")
def _(lib):
    return V.report(case_scores(lib)).withColumn("mean", F.round("mean", 9))


@plan("agg13_whole_cases", f"WITH s AS ({_SCORES}), p AS (SELECT case_id, min(score) AS lo FROM s GROUP BY 1) SELECT count(*) FILTER (lo = 1) AS whole, count(*) AS cases FROM p")
def _(lib):
    return V.whole_cases(case_scores(lib))


@plan("joi11_against_baseline", f"""WITH s AS ({_SCORES}), b AS (SELECT case_id, field, least(score + 0.03, 1.0) AS was FROM s WHERE length(case_id) % 2 = 0)
SELECT case_id, field, CASE WHEN was IS NULL THEN 'new' WHEN score < was - 0.02 THEN 'dropped' ELSE 'ok' END AS status FROM s LEFT JOIN b USING (case_id, field)""")
def _(lib):
    s = case_scores(lib).select("case_id", "field", "score")
    base = s.filter(F.length("case_id") % 2 == 0).withColumn("score", F.least(F.col("score") + 0.03, F.lit(1.0)))
    return V.against_baseline(s, base).select("case_id", "field", "status")


@plan("udf2_pluggable_tagger", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Fish' ELSE 'Vegetarian' END AS tag_name FROM documents""")
def _(lib):
    from quern.operators import sets as X
    d = lib.documents().select("doc_id")
    keyword = d.select("doc_id", F.lit("Vegetarian").alias("tag_name"), F.lit("main_ingredient").alias("category"), F.lit("keyword").alias("why"))
    tagger = lambda docs: docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("Fish").alias("tag_name"), F.lit("main_ingredient").alias("category"), F.lit("learned").alias("why"))
    known = lib.spark.createDataFrame([(n, c) for n, c, _s in W.SEED_TAGS], "tag_name string, category string")
    return X.combine_suggestions(keyword, tagger(d), known, W.MEAT_TAGS).select("doc_id", "tag_name")


@plan("udf3_user_keywords", """
WITH h AS (SELECT DISTINCT recipe_id AS doc_id FROM v_line WHERE ' ' || name || ' ' LIKE '% gizmo %')
SELECT doc_id, 'Gadget' AS tag_name FROM h UNION ALL SELECT recipe_id, 'Vegetarian' FROM (SELECT DISTINCT recipe_id FROM v_line) WHERE recipe_id NOT IN (SELECT doc_id FROM h)""")
def _(lib):
    from quern.operators import enrich as E
    extra = lib.spark.createDataFrame([("Gadget", "main_ingredient", "gizmo", True)], "tag_name string, category string, keyword string, rules_out_veg boolean")
    docs = lib.lines().groupBy(F.col("recipe_id").alias("doc_id")).agg(F.array_join(F.collect_list("name"), " , ").alias("text"))
    return E.keyword_tags(docs, E.tag_lexicon(lib.spark, extra)).select("doc_id", "tag_name")


@plan("ml13_published_model", "SELECT doc_id, toxic = 1 AS truth, true AS same FROM labels")
def _(lib):
    """A model is fitted, published, found again and loaded; its scores are those of the one that was fitted."""
    rows = cut_lineage(labelled(lib).withColumn("y", F.array_contains("tags", "toxic").cast("int")))
    root = f"{checkpoint_dir(lib.spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    fitted = M.fit_tag(rows, 2.0)
    M.publish(fitted, root, lib.spark, {"rows": rows.count()})
    loaded = LogisticRegressionModel.load(M.current_model(root, lib.spark))
    score = lambda m, name: m.transform(rows).select("doc_id", (F.col("y") == 1).alias("truth"), vector_to_array("probability")[1].alias(name))
    return score(fitted, "a").join(score(loaded, "b").drop("truth"), "doc_id").select("doc_id", "truth", (F.col("a") == F.col("b")).alias("same"))


def record_tags(lib):
    """(doc_id, tags): what the labels say, and the language and source of every document."""
    lab = lib.table("labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    d = lib.documents().select("doc_id", "lang", "source").join(lab, "doc_id", "left")
    return d.select("doc_id", F.array_compact(F.array(F.when(F.col("q") == 1, "quality"), F.when(F.col("t") == 1, "toxic"), F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"))).alias("tags"))


@plan("ml10_many_tags")
def _(lib):
    """All tags with enough records, at once, in five folds, over every document; what the keywords find is the language's own tag."""
    tags = cut_lineage(record_tags(lib))
    each = tags.select("doc_id", F.explode("tags").alias("tag"))
    n = tags.count()
    known = M.eligible_tags(each, F.lit(n), each.select("tag").distinct())
    y = known.select("tag", F.col("n").alias("pos"), (F.lit(n) - F.col("n")).alias("neg"))
    positive = {r["tag"]: r["w"] for r in y.select("tag", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("neg") / F.col("pos"))).alias("w")).orderBy("tag").collect()}   # a row per tag
    # MOST_MODELS at once: fewer hash columns keep the matrix at 8 MB
    got = cut_lineage(MT.out_of_fold(M.record_columns(lib.documents(), {"text": ("s:", 0.5)}, 4096, tags), None, positive, dim=4096, close=1e-3))
    return M.tag_report(got, each.filter("tag LIKE 'lang:%'").join(got.select("tag").distinct(), "tag", "left_semi"))


@plan("ml11_library_safeguards", """
WITH n AS (SELECT recipe_id, list(CAST(quantity AS VARCHAR) || ' ' || unit || ' ' || name ORDER BY position) AS ls FROM v_ingredient GROUP BY recipe_id),
m AS (SELECT recipe_id, ls, ls[1:greatest(len(ls) - CAST(recipe_id % 4 AS INT), 0)] AS kept FROM n)
SELECT recipe_id AS doc_id, CASE WHEN recipe_id % 9 = 0 THEN 'no result' WHEN len(kept) = 0 THEN 'no ingredients' WHEN len(list_filter(ls, lambda x: NOT list_contains(kept, x))) >= 2 THEN 'measured lines lost' ELSE 'model' END AS outcome,
 array_to_string(CASE WHEN recipe_id % 9 > 0 AND len(kept) > 0 AND len(list_filter(ls, lambda x: NOT list_contains(kept, x))) < 2 THEN list_transform(kept, lambda x: upper(x)) ELSE ls END, '|') AS ingredients FROM m""")
def _(lib):
    """A model that loses the last lines of some records of the library and changes the case of all, and has no answer for others."""
    ls = lib.lines().groupBy(F.col("recipe_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "raw_line"))).alias("ls"))
    rules = ls.select("doc_id", F.transform("ls", lambda x: x["raw_line"]).alias("ingredients"), F.array(F.lit("Mix well.")).alias("steps"))
    kept = F.slice("ingredients", F.lit(1), F.greatest(F.size("ingredients") - (F.col("doc_id") % 4).cast("int"), F.lit(0)))
    model = rules.filter("doc_id % 9 > 0").select("doc_id", F.transform(kept, lambda x: F.upper(x)).alias("ingredients"), "steps")
    return M.safeguarded(rules, model).select("doc_id", "outcome", F.array_join("ingredients", "|").alias("ingredients"))
