"""Search over the documents: index, typo tolerance, ranking, excerpts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T, words as W
from quern.model import VIEWS
from quern.operators import index as IX, search as S
from quern.plans.registry import plan
from quern.session import by_document, checkpoint_dir, cut_lineage, kept_by_document, small

COLUMNS = {"title": 10.0, "content_text": 3.0, "tags_text": 5.0}
_TOK = r"'[\p{L}\p{N}_]+'"

VIEWS["v_doc"] = """
SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS content_text, lang || ' ' || source AS tags_text FROM documents"""
VIEWS["v_token"] = f"""
SELECT doc_id, 'title' AS col, unnest(regexp_extract_all(strip_accents(lower(title)), {_TOK})) AS term FROM v_doc
UNION ALL SELECT doc_id, 'content_text', unnest(regexp_extract_all(strip_accents(lower(content_text)), {_TOK})) FROM v_doc
UNION ALL SELECT doc_id, 'tags_text', unnest(regexp_extract_all(strip_accents(lower(tags_text)), {_TOK})) FROM v_doc"""
VIEWS["v_posting"] = "SELECT doc_id, col, term, count(*) AS tf FROM v_token GROUP BY ALL"
VIEWS["v_term"] = "SELECT term, count(DISTINCT doc_id) AS docs FROM v_posting GROUP BY term"
# queries made of the benchmark passages: a start of the first word, the second word, the third left out
VIEWS["v_query"] = f"""
SELECT item_id AS qid, substring(t[1], 1, 4) || '  ' || t[2] || ' -' || t[3] AS q
FROM (SELECT item_id, regexp_extract_all(text, {_TOK}) AS t FROM benchmark)"""
VIEWS["v_word"] = """
SELECT item_id AS qid, 1 AS n, substring(strip_accents(lower(t[1])), 1, 4) AS word, false AS leave_out FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM benchmark)
UNION ALL SELECT item_id, 2, strip_accents(lower(t[2])), false FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM benchmark)
UNION ALL SELECT item_id, 3, strip_accents(lower(t[3])), true FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM benchmark)"""


def docs(lib):
    return lib.documents().select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("content_text"),
                                  F.concat_ws(" ", "lang", "source").alias("tags_text"))


def index(lib):
    return S.postings(docs(lib), list(COLUMNS))


def stored_index(lib):
    """As a library keeps it: written once by document, read by every step of a search."""
    return kept_by_document(index(lib))


def terms(lib):
    """The vocabulary straight from the texts: each document's words once, no
    distinct count."""
    words = F.array_distinct(F.flatten(F.array(*[T.tokens(F.col(c)) for c in COLUMNS])))
    return S.vocabulary(docs(lib).select("doc_id", F.explode(words).alias("term")))


def queries(lib):
    t = F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return lib.table("benchmark").select(F.col("item_id").alias("qid"), t.alias("t")).select("qid", F.concat(
        F.substring(F.get("t", F.lit(0)), 1, 4), F.lit("  "), F.get("t", F.lit(1)), F.lit(" -"), F.get("t", F.lit(2))).alias("q"))


def typo_words(lib):
    """Words of the passages with two letters swapped or one taken out."""
    w = lib.table("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).filter("length(w) >= 5").distinct()
    swapped = F.concat(F.substring("w", 1, 2), F.substring("w", 4, 1), F.substring("w", 3, 1), F.expr("substring(w, 5)"))
    dropped = F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)"))
    return w.select(F.when(F.crc32("w") % 2 == 0, swapped).otherwise(dropped).alias("word")).distinct()


@plan("sch1_parsed_queries", "SELECT qid, n - 1 AS n, word, leave_out FROM v_word")
def _(lib):
    return S.parse(queries(lib)).select("qid", "n", "word", "leave_out")


@plan("sch2_postings", "SELECT doc_id, col, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, md5(string_agg(term || tf, ' ' ORDER BY term)) AS digest FROM v_posting GROUP BY ALL")
def _(lib):
    return index(lib).groupBy("doc_id", "col").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "tf"))), lambda x: F.concat(x["term"], x["tf"].cast("string"))), " ")).alias("digest"))


_MATCH = """
WITH t AS (SELECT DISTINCT qid, n, term FROM v_word JOIN v_term ON starts_with(term, word) WHERE NOT leave_out),
pw AS (SELECT qid, n, doc_id, sum(tf * CASE col WHEN 'title' THEN 10.0 WHEN 'content_text' THEN 3.0 ELSE 5.0 END) AS wtf FROM v_posting JOIN t USING (term) GROUP BY ALL),
gone AS (SELECT DISTINCT qid, doc_id FROM v_word JOIN v_posting ON term IN (word, word || 's', word || 'es', word || 'x') WHERE leave_out)"""


@plan("sch3_prefix_all_words", _MATCH + """
SELECT qid, doc_id FROM pw GROUP BY ALL HAVING count(*) = 2""")
def _(lib):
    ix = stored_index(lib)
    vocab = S.vocabulary_of(ix)
    w = S.parse(queries(lib)).filter("NOT leave_out")
    t = small(S.by_prefix(w, vocab).select("qid", "n", "term").distinct())
    need = small(w.groupBy("qid").agg(F.count_distinct("n").alias("need")))
    return (by_document(ix.select("doc_id", "term")).distinct().join(t, "term").groupBy("doc_id", "qid").agg(F.count_distinct("n").alias("k"))
            .join(need, "qid").filter("k = need").select("qid", "doc_id"))


_RANKED = _MATCH + """,
dl AS (SELECT doc_id, sum(tf) AS dl FROM v_posting GROUP BY doc_id), df AS (SELECT qid, n, count(*) AS df FROM pw GROUP BY ALL),
s AS (SELECT qid, doc_id, count(*) AS k, sum(greatest(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS score
 FROM pw JOIN df USING (qid, n) JOIN dl USING (doc_id) GROUP BY ALL)"""


@plan("sch4_ranked_search", _RANKED + """
SELECT qid, doc_id, round(score, 6) AS score FROM s WHERE k = 2 AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM gone)""")
def _(lib):
    return S.search(queries(lib), docs(lib), stored_index(lib), COLUMNS, typos=False).withColumn("score", F.round("score", 6))


@plan("srt2_best_match_first", _RANKED + """
SELECT qid, doc_id, rank FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM s WHERE k = 2 AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM gone)) WHERE rank <= 10""")
def _(lib):
    from quern.operators.selection import top_k
    hits = S.search(queries(lib), docs(lib), stored_index(lib), COLUMNS, typos=False).withColumn("score", F.round("score", 6))
    return top_k(hits, ["qid"], [F.desc("score"), F.desc("doc_id")], 10).select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@plan("joi7_fuzzy_vocabulary", f"""
WITH w AS (SELECT DISTINCT w[1:2] || w[4] || w[3] || w[5:] AS word FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), {_TOK})) AS w FROM benchmark) WHERE length(w) >= 5)
SELECT word, term, docs, CAST(levenshtein(replace(word, 'ß', '~'), replace(term, 'ß', '~')) AS BIGINT) AS d FROM w JOIN v_term ON length(term) >= 3 AND abs(length(word) - length(term)) <= CASE WHEN length(word) < 8 THEN 1 ELSE 2 END
 AND levenshtein(replace(word, 'ß', '~'), replace(term, 'ß', '~')) <= CASE WHEN length(word) < 8 THEN 1 ELSE 2 END""")
def _(lib):
    w = lib.table("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).filter("length(w) >= 5").distinct()
    w = w.select(F.concat(F.substring("w", 1, 2), F.substring("w", 4, 1), F.substring("w", 3, 1), F.expr("substring(w, 5)")).alias("word")).distinct()
    return S.fuzzy(w, terms(lib), "levenshtein").withColumn("d", F.col("d").cast("bigint"))


@plan("sch5_corrections")
def _(lib):
    return S.corrections(typo_words(lib), cut_lineage(terms(lib)))


@plan("sch5_typo_tolerant_search")
def _(lib):
    q = typo_words(lib).select(F.crc32("word").alias("qid"), F.col("word").alias("q"))
    return S.search(q, docs(lib), stored_index(lib), COLUMNS).withColumn("score", F.round("score", 6))


@plan("sch6_commonest_with_prefix", f"""
WITH w AS (SELECT DISTINCT substring(term, 1, 3) AS word FROM (SELECT unnest(regexp_extract_all(strip_accents(lower(text)), {_TOK})) AS term FROM benchmark))
SELECT word, arg_min(term, {{'a': -docs, 'b': term}}) AS shown FROM w JOIN v_term ON starts_with(term, word) GROUP BY word""")
def _(lib):
    w = lib.table("benchmark").select(F.explode(T.tokens(F.col("text"))).alias("t")).select(F.substring("t", 1, 3).alias("word")).distinct()
    return S.commonest(w, terms(lib), "word")


@plan("sch7_whole_word_exclusion", _MATCH + "SELECT qid, doc_id FROM gone")
def _(lib):
    return S.excluded(S.parse(queries(lib)), index(lib))


@plan("sch8_excerpts", _MATCH + f""",
h AS (SELECT qid, doc_id FROM pw GROUP BY ALL HAVING count(*) = 2), p AS (SELECT qid, list(word) AS ps FROM v_word WHERE NOT leave_out GROUP BY qid),
d AS (SELECT qid, doc_id, ps, regexp_extract_all(content_text, {_TOK}) AS toks FROM h JOIN p USING (qid) JOIN v_doc USING (doc_id)
 WHERE len(list_filter(regexp_extract_all(strip_accents(lower(title)), {_TOK}), lambda w: starts_with(w, ps[1]) OR starts_with(w, ps[2]))) = 0),
f AS (SELECT qid, doc_id, toks, list_transform(toks, lambda w: starts_with(strip_accents(lower(w)), ps[1]) OR starts_with(strip_accents(lower(w)), ps[2])) AS hs FROM d),
b AS (SELECT *, list_sort(list_transform(list_filter(range(1, len(toks) + 1), lambda i: hs[i]), lambda i: {{'k': -len(list_filter(hs[i:i + 9], lambda x: x)), 'i': i}}))[1].i AS p0 FROM f)
SELECT qid, doc_id, array_to_string(list_transform(range(p0, least(p0 + 10, len(toks) + 1)), lambda i: CASE WHEN hs[i] THEN chr(2) || toks[i] || chr(3) ELSE toks[i] END), ' ') AS excerpt FROM b WHERE p0 IS NOT NULL""")
def _(lib):
    ix = stored_index(lib)
    vocab = S.vocabulary_of(ix)
    w = S.parse(queries(lib)).filter("NOT leave_out").withColumn("prefix", F.col("word"))
    return S.excerpts(w, ix, vocab, docs(lib), ["content_text"])


@plan("sch9_corrections_report")
def _(lib):
    words = typo_words(lib).select(F.crc32("word").alias("qid"), F.lit(0).cast("bigint").alias("n"), F.col("word").alias("typed"), "word")
    _, corrected = S.expand(words, cut_lineage(terms(lib)))
    return S.corrected_report(corrected).select("qid", F.to_json("corrected").alias("corrected"))


@plan("set1_search_provenance", """
WITH t AS (SELECT DISTINCT qid, n, term FROM v_word JOIN v_term ON starts_with(term, word) WHERE NOT leave_out),
h AS (SELECT qid, n, doc_id, bool_or(col = 'tags_text') AS g, bool_or(col <> 'tags_text') AS x FROM v_posting JOIN t USING (term) GROUP BY ALL)
SELECT qid, doc_id, CASE WHEN bool_and(g) AND bool_and(x) THEN 'tag,text' WHEN bool_and(x) THEN 'text' WHEN bool_and(g) THEN 'tag' ELSE 'tag,text' END AS via FROM h GROUP BY ALL HAVING count(*) = 2""")
def _(lib):
    ix = index(lib)
    w = S.parse(queries(lib)).filter("NOT leave_out").withColumn("prefix", F.col("word"))
    return S.provenance(w, ix, S.vocabulary_of(ix), ["tags_text"])


# --- the stored index -----------------------------------------------------------------------------

_INDEXES: dict[tuple[str, str], str] = {}


def search_index(lib):
    """The documents' index in the shared folder; queries of one session over one library share it."""
    key = (lib.spark.sparkContext.applicationId, lib.path)
    if key not in _INDEXES:
        root = f"{checkpoint_dir(lib.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        IX.SearchIndex.build(docs(lib), COLUMNS, root)
        _INDEXES[key] = root
    return IX.SearchIndex(lib.spark, _INDEXES[key])


_TOP = """
SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id DESC) AS rank FROM s
 WHERE k = 2 AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM gone)) WHERE rank <= 10"""


@plan("sch4_stored_top_k", _RANKED + _TOP)
def _(lib):
    return search_index(lib).top(queries(lib), 10).withColumn("rank", F.col("rank").cast("bigint"))


_REVISED = _RANKED.replace("WITH t AS", """
WITH v_doc2 AS (SELECT doc_id, CASE WHEN doc_id % 100 = 3 THEN 'Revised ' || title ELSE title END AS title, CASE WHEN doc_id % 100 = 3 THEN content_text || ' revised again' ELSE content_text END AS content_text, tags_text
 FROM v_doc WHERE doc_id % 100 <> 7),
v_token2 AS (SELECT doc_id, 'title' AS col, unnest(regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}_]+')) AS term FROM v_doc2
 UNION ALL SELECT doc_id, 'content_text', unnest(regexp_extract_all(strip_accents(lower(content_text)), '[\\p{L}\\p{N}_]+')) FROM v_doc2
 UNION ALL SELECT doc_id, 'tags_text', unnest(regexp_extract_all(strip_accents(lower(tags_text)), '[\\p{L}\\p{N}_]+')) FROM v_doc2),
v_posting2 AS (SELECT doc_id, col, term, count(*) AS tf FROM v_token2 GROUP BY ALL), v_term2 AS (SELECT term, count(DISTINCT doc_id) AS docs FROM v_posting2 GROUP BY term),
t AS""", 1).replace("v_posting JOIN t", "v_posting2 JOIN t").replace("JOIN v_term ON", "JOIN v_term2 ON").replace("v_word JOIN v_posting ON", "v_word JOIN v_posting2 ON").replace(
    "FROM v_posting GROUP BY doc_id), df", "FROM v_posting2 GROUP BY doc_id), df").replace("(SELECT count(*) FROM documents)", "(SELECT count(*) FROM v_doc2)")


def revised(lib):
    """The stored index after a change of one in a hundred documents and the removal of as many."""
    d = docs(lib)
    changed = d.filter("doc_id % 100 = 3").select("doc_id", F.concat(F.lit("Revised "), "title").alias("title"), F.concat("content_text", F.lit(" revised again")).alias("content_text"), "tags_text")
    root = f"{checkpoint_dir(lib.spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    return IX.SearchIndex.build(d, COLUMNS, root).change(changed, d.filter("doc_id % 100 = 7").select("doc_id"))


@plan("st8_index_upkeep", _REVISED + _TOP)
def _(lib):
    return revised(lib).top(queries(lib), 10).withColumn("rank", F.col("rank").cast("bigint"))


@plan("st8_compacted_postings", _REVISED + """
, w AS (SELECT doc_id, term, sum(tf * CASE col WHEN 'title' THEN 10.0 WHEN 'content_text' THEN 3.0 ELSE 5.0 END) AS wtf FROM v_posting2 GROUP BY ALL)
SELECT term, count(*) AS docs, CAST(sum(wtf) AS DOUBLE) AS weight, CAST(max(doc_id) AS BIGINT) AS last FROM w GROUP BY term""")
def _(lib):
    p = revised(lib).compact().postings()
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("wtf").alias("weight"), F.max("doc_id").alias("last"))
