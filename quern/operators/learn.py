"""Learning from corrected records: alignment, features, models, decisions."""
from __future__ import annotations

import math
import uuid
import zlib
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from quern.functions import patterns as P, text as T, words as W
from quern.operators import lines as L, manifest, segment as G
from quern.session import by_document, cut_lineage

LABELS = ["other", "title", "ingredient", "step"]


# --- alignment ---------------------------------------------------------------------------

def line_tokens(c: Column) -> Column:
    return F.array_distinct(T.tokens(F.regexp_replace(F.regexp_replace(c, P.STEP_START, ""), P.MARKER, "")))


def _runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _parts(costs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose costs add up to ``most``, or single ones that cost more."""
    before, out, at = np.concatenate([[0], np.cumsum(costs)]), [], 0
    while at < len(costs):
        to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        out.append((at, to))
        at = to
    return out


def overlaps(t_doc: np.ndarray, t_size: np.ndarray, t: np.ndarray, s_doc: np.ndarray, s_size: np.ndarray, s: np.ndarray,
             share: float = W.MATCH_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, item, inter) of every line and saved item of a document where the item has at least ``share`` of the line's words. Lines and
    items are given by their document, the number of their distinct words and these words, one after the other.

    An item that has so many of a line's words has one of any few of them that leave too few others out. So lines meet
    items only on the rarest of their words that any item has, and words that many items share make no pairs."""
    _, ids = np.unique(np.concatenate([t, s]), return_inverse=True)
    line, item = np.repeat(np.arange(len(t_size)), t_size), np.repeat(np.arange(len(s_size)), s_size)
    lk, word = t_doc[line] << 32 | ids[:len(t)], ids[len(t):]
    ik = s_doc[item] << 32 | word
    by_word = np.argsort(ik, kind="stable")
    low, high = np.searchsorted(ik[by_word], lk, "left"), np.searchsorted(ik[by_word], lk, "right")
    held = high - low
    need = np.ceil(t_size * share).astype(np.int64)
    known = np.bincount(line[held > 0], minlength=len(t_size))
    order = np.lexsort((held, line))
    order = order[(held[order] > 0) & (known[line[order]] >= need[line[order]])]
    sizes = np.bincount(line[order], minlength=len(t_size))
    place = _runs(sizes, np.zeros(len(sizes), np.int64))
    rare = order[place < (known - need + 1)[line[order]]]           # by line
    has = np.sort(item << 32 | word)
    starts = np.cumsum(t_size) - t_size
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    cuts = np.searchsorted(line[rare], np.arange(len(t_size) + 1))
    costs = np.concatenate([[0], np.cumsum(held[rare])])[cuts]
    for a, z in _parts(np.diff(costs), 1_000_000):
        w = rare[cuts[a]:cuts[z]]
        pairs = np.unique(np.repeat(line[w], held[w]) << 32 | item[by_word[_runs(held[w], low[w])]])
        for f, to in _parts(t_size[pairs >> 32], 1_000_000):
            i, k = pairs[f:to] >> 32, pairs[f:to] & 0xFFFFFFFF
            asked = np.repeat(k, t_size[i]) << 32 | ids[_runs(t_size[i], starts[i])]
            hit = has[np.minimum(np.searchsorted(has, asked), len(has) - 1)] == asked
            inter = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(t_size[i])[:-1]]))
            use = inter >= t_size[i] * share
            found.append((i[use], k[use], inter[use]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: Words of the lines and items of documents that are compared at once.
ALIGNED_WORDS = 500_000


def _groups(*columns: np.ndarray) -> np.ndarray:
    """The number of the distinct row of each row."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sides(t: pa.Array, i: pa.Array, label: pa.Array, k: pa.Array, s: pa.Array) -> pa.Array:
    """For a few documents: of each line the best scores as ingredient and as step and whether it is the title; of each document how many
    ingredients and steps are the best of some line."""
    docs, count = np.arange(len(t)), lambda x: np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)
    t_doc, s_doc = np.repeat(docs, count(t)), np.repeat(docs, count(s))
    lines, items = t.flatten(), s.flatten()
    t_size, s_size = count(lines), count(items)
    number = lambda x: np.asarray(pc.fill_null(x.flatten(), -1)).astype(np.int64)
    at, number_of, name = number(i), number(k), np.asarray(pc.fill_null(pc.index_in(label.flatten(), pa.array(LABELS)), -1))
    line, item, inter = overlaps(t_doc, t_size, np.asarray(lines.flatten()).astype(np.int64), s_doc, s_size, np.asarray(items.flatten()).astype(np.int64))
    group = _groups(at, t_doc)
    c, d = inter / t_size[line], inter / s_size[item]
    title = np.zeros(len(group) + 1, bool)
    title[group[line[(name[item] == 1) & (c >= W.TITLE_SHARE) & (d >= W.TITLE_SHARE)]]] = True
    fit = (c >= W.MATCH_SHARE) & ~title[group[line]]
    score = c + 0.5 * inter / s_size[item]
    best, hits = [], []
    for side in (2, 3):
        use = np.flatnonzero(fit & (name[item] == side))
        # the lowest k on ties
        use = use[np.lexsort((number_of[item[use]], -score[use], group[line[use]]))]
        g = group[line[use]]
        use = use[np.concatenate([[True], g[1:] != g[:-1]])[:len(use)]]
        of = np.full(len(group) + 1, np.nan)
        of[group[line[use]]] = score[use]
        best.append(of[group])
        doc, n = s_doc[item[use]], number_of[item[use]]
        _, first = np.unique(_groups(n, doc), return_index=True)
        hits.append(np.bincount(doc[first], minlength=len(docs)).astype(np.int64))
    of_line = pa.StructArray.from_arrays([pa.array(best[0], from_pandas=True), pa.array(best[1], from_pandas=True), pa.array(title[group])], names=["si", "ss", "title"])
    ends = np.concatenate([[0], np.cumsum(count(t))]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), of_line), *map(pa.array, hits)], names=["lines", "hi", "hs"])


_LINE = StructType([StructField("si", DoubleType()), StructField("ss", DoubleType()), StructField("title", BooleanType())])


@F.arrow_udf(StructType([StructField("lines", ArrayType(_LINE)), StructField("hi", LongType()), StructField("hs", LongType())]))
def _aligned(t: pa.Array, i: pa.Array, label: pa.Array, k: pa.Array, s: pa.Array) -> pa.Array:
    words = sum(np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (t, s)) * 16
    done = [_sides(*(x.slice(a, z - a) for x in (t, i, label, k, s))) for a, z in _parts(words, ALIGNED_WORDS)]
    return pa.concat_arrays(done) if done else pa.array([], _sides(t, i, label, k, s).type)


@F.arrow_udf(ArrayType(StructType([StructField(n, LongType()) for n in ("line", "item", "inter")])))
def _pairs(t: pa.Array, s: pa.Array, share: pa.Array) -> pa.Array:
    count = lambda x: np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)
    n, lines, items = (count(t), count(s)), t.flatten(), s.flatten()
    doc = [np.repeat(np.arange(len(t)), x) for x in n]
    line, item, inter = overlaps(doc[0], count(lines), np.asarray(lines.flatten()).astype(np.int64), doc[1], count(items), np.asarray(items.flatten()).astype(np.int64),
                                 share[0].as_py() if len(share) else 1.0)
    order = np.argsort(line, kind="stable")
    first = [np.cumsum(x) - x for x in n]
    at = doc[0][line[order]]
    made = pa.StructArray.from_arrays([pa.array(line[order] - first[0][at]), pa.array(item[order] - first[1][at]), pa.array(inter[order])], names=["line", "item", "inter"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(t) + 1)).astype(np.int32)), made)


def _by_row(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, ls, its): the lines and items of a document with hashes of their words (t, s). Texts are shuffled once, lines and items
    together, and hashed in the document's row, so what is sorted by document is the texts alone. Items of no document (null) meet no lines."""
    hashes = lambda c: F.transform(line_tokens(c), lambda w: F.xxhash64(w))
    both = by_document(lines.select("doc_id", F.struct("i", "line").alias("l")).unionByName(
        items.select("doc_id", F.struct("label", "k", "text").alias("it")), allowMissingColumns=True))
    met = both.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("it").isNull()).alias("_side")).agg(F.collect_list("l").alias("ls"), F.collect_list("it").alias("its"))
    return met.select("doc_id", F.transform("ls", lambda x: F.struct(x["i"].alias("i"), x["line"].alias("line"), hashes(x["line"]).alias("t"))).alias("ls"),
                      F.transform("its", lambda x: F.struct(x["label"].alias("label"), x["k"].alias("k"), hashes(x["text"]).alias("s"))).alias("its"))


def _overlaps(lines: DataFrame, items: DataFrame, share: float = W.MATCH_SHARE) -> DataFrame:
    """(doc_id, i, label, k, n_line, n_item, inter) of every line and saved item of a document where the item has at least ``share`` of the line's words."""
    d = _by_row(lines, items).select("doc_id", "ls", "its", _pairs("ls.t", "its.s", F.lit(share)).alias("ps"))
    line, item = F.get("ls", F.col("p.line")), F.get("its", F.col("p.item"))
    return d.select("doc_id", "ls", "its", F.explode("ps").alias("p")).select(
        "doc_id", line["i"].alias("i"), item["label"].alias("label"), item["k"].alias("k"), F.size(line["t"]).alias("n_line"), F.size(item["s"]).alias("n_item"), F.col("p.inter").alias("inter"))


def align(lines: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(doc_id, i, line), items(doc_id, label title/ingredient/step, k, text) ->
    (labels(doc_id, i, label), coverage(doc_id, cov_ing, cov_step)).

    The lines and items of a document meet in its row."""
    d = _by_row(lines, items).select("doc_id", "ls", F.transform("its", lambda x: F.struct(x["label"].alias("label"), F.size(x["s"]).alias("n"))).alias("its"),
                                              _aligned("ls.t", "ls.i", "its.label", "its.k", "its.s").alias("r"))
    each = F.zip_with("ls", "r.lines", lambda x, y: F.struct(x["i"].alias("i"), x["line"].alias("line"), y["si"].alias("si"), y["ss"].alias("ss"), y["title"].alias("is_title")))
    j = d.select("doc_id", F.inline_outer(each)).filter("line IS NOT NULL")
    closer = F.when(F.col("si") > F.col("ss"), "ingredient").otherwise("step")
    label = (F.when(F.col("is_title"), "title").when(F.col("si").isNull() & F.col("ss").isNull(), "other").when(F.col("ss").isNull(), "ingredient")
             .when(F.col("si").isNull(), "step"))
    # what is asked of the line's text is a column before the windows, so they sort no texts but for who wants the lines
    filled = L.fill_labels(j.select("doc_id", "i", "line", F.col("line").rlike(P.BARE_NUMBER).alias("_number"), label.alias("label"), closer.alias("best")))
    nxt = F.first(F.when(F.col("label") != "other", F.col("label")), ignorenulls=True).over(L.by_doc().rowsBetween(1, Window.unboundedFollowing))
    bare = (F.col("label") == "other") & F.col("_number") & (nxt == "step")
    labels = filled.withColumn("_bare", F.coalesce(bare, F.lit(False))).select("doc_id", "i", "line", F.when(F.col("_bare"), "step").otherwise(F.col("label")).alias("label"))
    count = lambda name: F.size(F.filter("its", lambda x: (x["label"] == name) & (x["n"] > 0))).cast("bigint")
    total = d.filter(F.exists("its", lambda x: x["n"] > 0)).select("doc_id", count("ingredient").alias("ni"), count("step").alias("ns"), F.col("r.hi").alias("hi"), F.col("r.hs").alias("hs"))
    share = lambda h, n: F.when(F.col(n) == 0, 1.0).otherwise(F.coalesce(F.col(h), F.lit(0)) / F.col(n))
    cov = total.select("doc_id", "ni", "ns", share("hi", "ni").alias("cov_ing"), share("hs", "ns").alias("cov_step"))
    return labels, cov


def examples(labels: DataFrame, coverage: DataFrame) -> DataFrame:
    """(doc_id, imported, weight): a text whose lines cover half of both sections is
    an imported example of weight 1; another whole record counts 0.3; no others."""
    n = labels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    e = coverage.join(n, "doc_id").filter("ni > 0 AND ns > 0")
    ok = (F.col("n") >= 3) & (F.col("cov_ing") >= W.COVERAGE) & (F.col("cov_step") >= W.COVERAGE)
    return e.select("doc_id", ok.alias("imported"), F.when(ok, 1.0).otherwise(W.PSEUDO_WEIGHT).alias("weight"))


# --- features ---------------------------------------------------------------------------

def _bucket(n: Column) -> Column:
    out = None
    for limit, name in ((1, "1"), (2, "2"), (3, "3"), (6, "4-6"), (12, "7-12"), (25, "13-25")):
        out = F.when(n <= limit, name) if out is None else out.when(n <= limit, name)
    return out.otherwise("26+")


def is_title(l: Column) -> Column:
    """Every run of letters starts with its only capital, and there is one."""
    return l.rlike(r"\p{L}") & ~l.rlike(r"(?<!\p{L})\p{Ll}") & ~l.rlike(r"(?<=\p{L})[\p{Lu}\p{Lt}]") & l.rlike(r"[\p{Lu}\p{Lt}]")


def shape(l: Column) -> Column:
    """Names of the facts that hold for a line."""
    opened, closed = (F.length(l) - F.length(F.replace(l, F.lit(b), F.lit(""))) for b in "()")
    facts = {**{n: f(l) for n, f in G.PREDICATES.items()}, "title_case": is_title(l), "verb": G.first_word(l).isin(P.STEP_VERBS),
             "steps_end": l.rlike(P.STEPS_END), "open_paren": opened > closed, "qtylead": l.rlike(P.QUANTITY_LEAD), "unit": l.rlike("(?iU)(?<!\\w)" + W.UNIT_PATTERN + "(?!\\w)"),
             "fraction": l.rlike(r"[¼½¾⅓⅔⅛⅜⅝⅞]|\d+/\d+"), "period": l.rlike(P.SENTENCE_END), "colon": F.rtrim(l).endswith(":"), "upper": G.is_upper(l),
             "lower_start": l.rlike(r"^\p{Ll}"), "bare_number": l.rlike(P.BARE_NUMBER), "byline": l.rlike(P.BYLINE), "numbered": l.rlike(P.NUMBERED_STEP),
             "ing_tail": l.rlike(W.INGREDIENT_TAIL), "url": l.rlike(r"(?i)https?://|www\.|\.com\b"), "price": l.rlike(r"\$\d")}
    return F.array_compact(F.array(F.concat(F.lit("len:"), _bucket(T.word_count(l))), *[F.when(hit, F.lit(f"is:{n}")) for n, hit in facts.items()]))


def line_features(lines: DataFrame) -> DataFrame:
    """lines(doc_id, i, line, rule) -> (doc_id, i, feats array<struct<name, value>>):
    words, pairs, letter triples, shape, place, neighbours and the rules' label."""
    w, every = L.by_doc(), Window.partitionBy("doc_id")
    d = by_document(lines).withColumns({"shape": shape(F.col("line")), "ws": T.tokens(F.regexp_replace("line", P.MARKER, ""))})
    rn, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(every)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"rn": rn, "cnt": n, **{f"{t}rule": F.lag("rule", o).over(w) for t, o in (("p", 1), ("n", -1), ("pp", 2), ("nn", -2))},
                       "pshape": F.lag("shape").over(w), "nshape": F.lead("shape").over(w),
                       "seen_ing": F.coalesce(F.max(F.array_contains("shape", "is:heading_ingredients")).over(before), F.lit(False)),
                       "seen_steps": F.coalesce(F.max(F.array_contains("shape", "is:heading_steps")).over(before), F.lit(False))})
    d = d.withColumn("folded", F.concat(F.lit(" "), T.fold(F.col("line")), F.lit(" ")))
    d = d.withColumn("scale", 1 / F.sqrt(F.greatest(F.size("ws"), F.lit(1)).cast("double")))
    one = lambda name, v=1.0: F.struct(name.alias("name"), (F.lit(v) if isinstance(v, float) else v).cast("double").alias("value"))
    num = lambda x: F.when(x.rlike(r"^\d+$"), "#").otherwise(x)
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    s = F.col("scale")
    words = F.transform("ws", lambda x: one(cat("w:", num(x)), s))
    pairs = F.when(F.size("ws") > 1, F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda j: one(cat("b:", F.element_at("ws", j), "_", F.element_at("ws", j + 1)), s)))
    folded = F.col("folded")
    # every place is a match of one letter that looks two letters ahead: a substring by its place would walk the line again each time
    threes = F.when(F.length(folded) < 3, F.array(folded)).otherwise(F.regexp_extract_all(folded, F.lit("(?s)(?=(.{3}))."), F.lit(1)))
    triples = F.transform(threes, lambda x: one(cat("c:", x), s * 0.3))
    flags = F.array_compact(F.array(
        one(cat("pos:", F.least(F.floor(10 * F.col("rn") / F.col("cnt")), F.lit(9)).cast("string"))), F.when(F.col("rn") == 0, one(F.lit("pos:first"))),
        F.when(F.col("rn") == F.col("cnt") - 1, one(F.lit("pos:last"))), F.when(F.col("seen_ing"), one(F.lit("after:head_ing"))),
        F.when(F.col("seen_steps"), one(F.lit("after:head_steps"))), one(cat("rule:", F.col("rule")), 2.0),
        F.when(F.size("ws") > 0, one(cat("first:", num(F.get("ws", F.lit(0)))))), F.when(F.size("ws") > 0, one(cat("last:", num(F.element_at("ws", -1))))),
        *[one(F.coalesce(cat(f"{t}rule:", F.col(f"{t}rule")), F.lit(f"{t}:none"))) for t in ("p", "n", "pp", "nn")],
        *[F.when(F.col(f"{t}rule").isNotNull(), one(cat(f"{t}rule_same:", (F.col(f"{t}rule") == F.col("rule")).cast("string")))) for t in ("p", "n")]))
    none = F.array().cast("array<string>")
    near = [F.transform(F.coalesce(f"{t}shape", none), _prefixer(f"{t}:")) for t in ("p", "n")]
    shapes = F.transform(F.concat("shape", *near), lambda x: one(x))
    return d.select("doc_id", "i", F.concat(words, F.coalesce(pairs, F.array().cast("array<struct<name:string,value:double>>")), triples, flags, shapes).alias("feats"))


def feature_cells(features: DataFrame) -> DataFrame:
    """(doc_id, i, name, value). The outer form: of the inner one the optimizer makes a filter on the array's size, moves it below
    the features and there folds the whole line again for each letter triple."""
    return features.select("doc_id", "i", F.inline_outer("feats")).filter("name IS NOT NULL")


def _prefixer(p: str):
    def add(x):
        return F.concat(F.lit(p), x)
    return add


def record_features(docs: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """(doc_id, name, value): words and pairs per field (prefix, weight), log-scaled,
    each document's values of length 3."""
    # words as columns of their own: inside a lambda the expression would run per word
    docs = by_document(docs.filter("doc_id IS NOT NULL").select("doc_id", *fields)).select("doc_id", *[T.tokens(F.col(c)).alias(f"_t_{c}") for c in fields])

    def of(c, prefix, weight):
        t = F.col(f"_t_{c}")
        good = lambda x: ~x.rlike(r"^\d+$")
        ws = F.transform(F.filter(t, lambda x: (F.length(x) > 1) & good(x)), lambda x: F.struct(F.concat(F.lit(prefix), x).alias("name"), F.lit(weight).alias("v")))
        two = F.when(F.size(t) > 1, F.filter(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda j: F.when(
            good(F.element_at(t, j)) & good(F.element_at(t, j + 1)),
            F.struct(F.concat(F.lit(prefix), F.element_at(t, j), F.lit("_"), F.element_at(t, j + 1)).alias("name"), F.lit(weight * 0.5).alias("v")))), lambda x: x.isNotNull()))
        return F.concat(ws, F.coalesce(two, F.array().cast("array<struct<name:string,v:double>>")))
    # the outer form: of the inner one the optimizer makes a filter that cuts the text into words again for each of its words
    cells = docs.select("doc_id", F.inline_outer(F.concat(*[of(c, p, w) for c, (p, w) in fields.items()]))).filter("name IS NOT NULL")
    tf = cells.groupBy("doc_id", "name").agg(F.log1p(F.sum("v")).alias("value"))
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))      # a document's own words
    return tf.withColumn("norm", norm).select("doc_id", "name", (F.lit(3.0) * F.col("value") / F.col("norm")).alias("value"))


#: Cells of rows that are summed at once.
SUMMED_CELLS = 500_000


def _row_sums(n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray, bias: np.ndarray) -> pa.StructArray:
    """The distinct columns of each row in order with the sums of their values; the bias takes its column's place, whatever fell there."""
    rows = np.arange(n)
    key = np.concatenate([row << 32 | col, rows << 32 | bias])
    found, at = np.unique(key, return_inverse=True)
    sums = np.bincount(at, np.concatenate([value, np.zeros(n)]), len(found))
    sums[np.searchsorted(found, rows << 32 | bias)] = 1.0
    ends = pa.array(np.searchsorted(found, np.arange(n + 1) << 32).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array((found & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(sums))], names=["cols", "vals"])


@F.arrow_udf(StructType([StructField("cols", ArrayType(IntegerType())), StructField("vals", ArrayType(DoubleType()))]))
def _summed(c: pa.Array, v: pa.Array, bias: pa.Array) -> pa.Array:
    # a few rows at a time: a batch of long lines has many times the cells of one of short lines
    sizes = np.asarray(pc.fill_null(pc.list_value_length(c), 0)).astype(np.int64)
    done = []
    for a, z in _parts(sizes, SUMMED_CELLS):
        few = sizes[a:z]
        done.append(_row_sums(z - a, np.repeat(np.arange(z - a), few), np.asarray(c.slice(a, z - a).flatten()).astype(np.int64),
                              np.asarray(v.slice(a, z - a).flatten()), np.asarray(bias.slice(a, z - a)).astype(np.int64)))
    return pa.concat_arrays(done) if done else _row_sums(0, *[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0, np.int64))


def record_words(docs: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """(doc_id, a column per field): the words of each text of a document, array<array<string>>. Texts are shuffled once to their document."""
    texts = by_document(docs.filter("doc_id IS NOT NULL").select("doc_id", *fields)).groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in fields])
    return texts.select("doc_id", *[F.transform(c, lambda x: T.tokens(x)).alias(c) for c in fields])


#: Words of the texts of documents that are counted at once.
COUNTED_WORDS = 2_000_000


def _counted(fields: tuple[pa.Array, ...], of: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, name's number, names, value) of every distinct name of each row, by row: words and pairs of each field (prefix, weight),
    log-scaled, a row's values of length 3. A field gives the words of each text of a row."""
    rows, names, weights = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0)]
    for field, (prefix, weight) in zip(fields, of, strict=True):
        count = lambda x: np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)
        texts = field.flatten()
        words = texts.flatten()
        text = np.repeat(np.arange(len(texts)), count(texts))
        row = np.repeat(np.arange(len(field)), count(field))[text]
        plain = ~np.asarray(pc.match_substring_regex(words, "^[0-9]+$")).astype(bool)
        one = np.flatnonzero(plain & (np.asarray(pc.utf8_length(words)) > 1))
        two = np.flatnonzero(plain[1:] & plain[:-1] & (text[1:] == text[:-1]))
        named = pc.binary_join_element_wise(pa.scalar(prefix), words, "")
        names += [named.take(pa.array(one)), pc.binary_join_element_wise(named.take(pa.array(two)), words.take(pa.array(two + 1)), "_")]
        rows += [row[one], row[two]]
        weights += [np.full(len(one), weight), np.full(len(two), weight * 0.5)]
    coded = pa.concat_arrays(names).dictionary_encode()
    key, at = np.unique(np.concatenate(rows) << 32 | np.asarray(coded.indices).astype(np.int64), return_inverse=True)
    value, row = np.log1p(np.bincount(at, np.concatenate(weights), len(key))), key >> 32
    norm = np.sqrt(np.bincount(row, value * value))
    return row, key & 0xFFFFFFFF, coded.dictionary, 3.0 * value / norm[row]


def _by_words(fields: tuple[pa.Array, ...], one, kind: pa.DataType) -> pa.Array:
    """``one`` of a few documents at a time."""
    words = sum(np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in fields)
    for k, x in enumerate(fields):
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0))])
        before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x.flatten()), 0))])
        words = words + before[ends[1:]] - before[ends[:-1]]
    done = [one(tuple(x.slice(a, z - a) for x in fields)) for a, z in _parts(words, COUNTED_WORDS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def record_columns(docs: DataFrame, fields: dict[str, tuple[str, float]], dim: int = W.HASH_COLUMNS, beside: DataFrame | None = None) -> DataFrame:
    """(doc_id, cols, vals): what ``hashed`` makes of ``record_features``, in the document's row; no word becomes a row of its own.
    Rows ``beside`` (doc_id, ...) are joined to the texts, so that the columns need not be shuffled to meet them."""
    of = list(fields.values())
    bias = zlib.crc32(b"__bias__") % dim
    kind = pa.struct([("cols", pa.list_(pa.int32())), ("vals", pa.list_(pa.float64()))])

    def few(columns: tuple[pa.Array, ...]) -> pa.Array:
        row, name, names, value = _counted(columns, of)
        col = np.array([zlib.crc32(x) % dim for x in names.cast(pa.binary()).to_pylist()], np.int64)
        found = _row_sums(len(columns[0]), row, col[name], value, np.full(len(columns[0]), bias))
        return pa.StructArray.from_arrays(found.flatten(), fields=list(found.type), mask=pa.array(np.bincount(row, minlength=len(found)) == 0))

    def columned(*columns: pa.Array) -> pa.Array:
        return _by_words(columns, few, kind)
    # not deterministic by name only: the filter would be moved below the count and have it made twice
    summed = F.arrow_udf(columned, "struct<cols:array<int>,vals:array<double>>").asNondeterministic()
    words, more = record_words(docs, fields), []
    if beside is not None:
        words, more = words.join(beside, "doc_id"), [c for c in beside.columns if c != "doc_id"]
    # null: a document without a feature
    return words.select("doc_id", *more, summed(*fields).alias("s")).filter("s IS NOT NULL").select("doc_id", *more, "s.cols", "s.vals")


def hashed(cells: DataFrame, keys: list[str], dim: int = W.HASH_COLUMNS) -> DataFrame:
    """(keys, col, value): stable hashed columns, collisions summed, plus the bias column. Of features in their row (keys, feats) as
    ``line_features`` gives them, (keys, cols, vals): no feature becomes a row of its own."""
    if "feats" in cells.columns:
        parts = cells.select(*keys, F.transform("feats", lambda x: F.pmod(F.crc32(x["name"]), F.lit(dim)).cast("int")).alias("c"), F.transform("feats", lambda x: x["value"]).alias("v"))
        g = parts.groupBy(*keys).agg(F.flatten(F.collect_list("c")).alias("c"), F.flatten(F.collect_list("v")).alias("v")).filter(F.size("c") > 0)
        return g.select(*keys, _summed("c", "v", F.pmod(F.crc32(F.lit("__bias__")), F.lit(dim)).cast("int")).alias("s")).select(*keys, "s.cols", "s.vals")
    h = cells.groupBy(*keys, F.pmod(F.crc32("name"), F.lit(dim)).cast("int").alias("col")).agg(F.sum("value").alias("value"))
    bias = F.pmod(F.crc32(F.lit("__bias__")), F.lit(dim)).cast("int")
    # the bias takes its column's place, whatever fell there
    row = F.concat(F.filter("cv", lambda x: x["col"] != bias), F.array(F.struct(bias.alias("col"), F.lit(1.0).alias("value"))))
    return h.groupBy(*keys).agg(F.collect_list(F.struct("col", "value")).alias("cv")).select(*keys, F.inline(row))


@F.pandas_udf(VectorUDT())
def _sparse(cols: pd.Series, values: pd.Series) -> pd.DataFrame:
    """The stored form of a sparse vector, straight from the Arrow batch."""
    return pd.DataFrame({"type": np.zeros(len(cols), dtype=np.int8), "size": np.full(len(cols), W.HASH_COLUMNS, dtype=np.int32), "indices": cols, "values": values})


def vectors(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, features): one sparse vector per row from its hashed cells."""
    if "cols" in cells.columns:
        return cells.select(*keys, _sparse("cols", "vals").alias("features"))
    c = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cv"))
    return c.select(*keys, _sparse(F.transform("cv", lambda x: x["col"]), F.transform("cv", lambda x: x["value"])).alias("features"))


# --- models ---------------------------------------------------------------------------------

def fold(c: Column, k: int, seed: str = "fold") -> Column:
    """A record's fold, the same in any run: whole records share one."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), c.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(k)).cast("bigint")


def softmax(train: DataFrame, l2: float = 1.0, max_iter: int = 50):
    """Weighted multinomial logistic regression on (features, label_index, weight).
    The penalty is per total weight, so it weakens as examples grow."""
    total = train.agg(F.sum("weight")).first()[0] or 1.0
    return LogisticRegression(family="multinomial", featuresCol="features", labelCol="label_index", weightCol="weight", regParam=l2 / total,
                              standardization=False, fitIntercept=False, maxIter=max_iter).fit(train)


def positive_weights(examples_: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, pos, neg, weight): positives count neg/pos, from 1 to 5."""
    g = examples_.groupBy(tag).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return g.withColumn("weight", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("neg") / F.greatest(F.col("pos"), F.lit(1)))))


def eligible_tags(record_tags: DataFrame, n_records: Column, known: DataFrame, most: int | None = None) -> DataFrame:
    """The tags with enough records with and without them; the ``most`` used of them where a number is given."""
    g = record_tags.groupBy("tag").agg(F.count_distinct("doc_id").alias("n"))
    able = g.filter((F.col("n") >= W.MIN_POSITIVE) & (n_records - F.col("n") >= W.MIN_NEGATIVE)).join(known, "tag", "left_semi")
    return able if most is None else able.orderBy(F.desc("n"), "tag").limit(most)


def fit_tag(train: DataFrame, pos_weight: float, l2: float = 1.0, max_iter: int = 50):
    t = train.withColumn("w", F.when(F.col("y") > 0, float(pos_weight)).otherwise(1.0)).withColumn("y", F.col("y").cast("double"))
    total = t.agg(F.sum("w")).first()[0] or 1.0
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=l2 / total, standardization=False,
                              fitIntercept=False, maxIter=max_iter).fit(t)


def out_of_fold(rows: DataFrame, tags: dict[str, float], folds: int, parallel: int = 4) -> DataFrame:
    """rows(doc_id, features, tags array) -> (doc_id, tag, p, truth): every record scored
    by a model that never saw its fold. One model per tag and fold; tags are at most
    50, each fit is a distributed job, a few run side by side.

    Each step of a fit sends a dense gradient per task, so the rows are in as many tasks as there are cores: what is sent does
    not grow with the rows."""
    data = rows.withColumn("fold", fold(F.col("doc_id"), folds)).coalesce(rows.sparkSession.sparkContext.defaultParallelism).persist()

    def one(job):
        tag, weight, k = job
        d = data.withColumn("y", F.array_contains("tags", tag).cast("int"))
        m = fit_tag(d.filter(F.col("fold") != k), weight)
        out = m.transform(d.filter(F.col("fold") == k))
        return out.select("doc_id", F.lit(tag).alias("tag"), vector_to_array("probability")[1].alias("p"), F.col("y").alias("truth"))
    with ThreadPool(parallel) as pool:
        parts = pool.map(one, [(t, w, k) for t, w in sorted(tags.items()) for k in range(folds)])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tag_report(scores: DataFrame, keyword: DataFrame, most_unused: int | None = None) -> DataFrame:
    """scores(doc_id, tag, p, truth), keyword(doc_id, tag): only what the keywords missed
    counts. (tag, status, threshold, best_precision); of the unused ones the ``most_unused`` best where a number is given."""
    extra = scores.join(keyword, ["doc_id", "tag"], "left_anti")
    r = (scores.select("tag").distinct().join(L.threshold(extra, "tag"), "tag", "left").join(L.best_precision(extra, "tag"), "tag", "left"))
    kept = r.filter("threshold IS NOT NULL").withColumn("status", F.lit("kept"))
    unused = r.filter("threshold IS NULL").withColumn("status", F.lit("not used"))
    if most_unused is not None:
        unused = unused.orderBy(F.coalesce("best_precision", F.lit(0.0)).desc(), "tag").limit(most_unused)
    return kept.unionByName(unused).select("tag", "status", "threshold", F.round("best_precision", 4).alias("best_precision"))


def transitions(labels: DataFrame) -> DataFrame:
    """(kind, a, b, p): start, transition and prior probabilities with one added to
    every count; labels(doc_id, i, label) of imported examples."""
    spark = labels.sparkSession
    d = labels.withColumns({"nxt": F.lead("label").over(L.by_doc()), "first": F.lag("label").over(L.by_doc()).isNull()})
    seen = d.select(F.inline(F.array_compact(F.array(
        F.when(F.col("first"), F.struct(F.lit("start").alias("kind"), F.lit("-").alias("a"), F.col("label").alias("b"))),
        F.when(F.col("nxt").isNotNull(), F.struct(F.lit("step").alias("kind"), F.col("label").alias("a"), F.col("nxt").alias("b"))),
        F.struct(F.lit("prior").alias("kind"), F.lit("-").alias("a"), F.col("label").alias("b"))))))
    ones = [("start", "-", l) for l in LABELS] + [("prior", "-", l) for l in LABELS] + [("step", a, b) for a in LABELS for b in LABELS]
    c = seen.unionAll(spark.createDataFrame(ones, "kind string, a string, b string")).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("kind", "a")))   # 24 rows


#: Lines of a block of a text, whose scores are composed as one matrix.
PATH_BLOCK = 128


def best_path(emissions: DataFrame, probs: dict[tuple[str, str, str], float], block: int = PATH_BLOCK) -> DataFrame:
    """(doc_id, i, label): the most likely label sequence per document; the first label wins among equals. emissions(doc_id, i, p array<double> by label).

    A text is cut into blocks of lines. A block is a max-plus matrix (from the label before it to its last label), and
    the matrices of a text in order give the scores before each block. With these a block finds the pointers back
    from each line to the one before, and their composition, one label for each label, leads from the text's end to the end of
    each block. So no row holds more than a block of lines or a text's matrices, and the work is linear in the lines."""
    k = range(len(LABELS))
    low = -1e300
    log = lambda kind, a, b: F.lit(math.log(probs[(kind, a, b)]))
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs])
    step = [[math.log(probs[("step", a, b)]) for b in LABELS] for a in LABELS]
    emit = F.array(*[F.log(F.col("p")[j] + 1e-9) - log("prior", "-", LABELS[j]) for j in k])
    cells = emissions.select("doc_id", F.floor(F.col("i") / block).alias("b"), F.struct("i", emit.alias("e")).alias("x"))
    blocks = cut_lineage(cells.groupBy("doc_id", "b").agg(F.array_sort(F.collect_list("x")).alias("xs")))

    def onward(scores, e, j):
        """Score of label j on a line after these scores of the line before."""
        return F.array_max(F.array(*[scores[a] + F.lit(step[a][j]) for a in k])) + e[j]

    # one row of the matrix for each label before the block
    unit = lambda a: numbers([0.0 if x == a else low for x in k])
    row = lambda a: F.aggregate("xs", unit(a), lambda s, x: F.array(*[onward(s, x["e"], j) for j in k]))
    first = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), F.array(*[log("start", "-", LABELS[j]) + F.element_at("xs", 1)["e"][j] for j in k]),
                        lambda s, x: F.array(*[onward(s, x["e"], j) for j in k]))
    matrices = blocks.select("doc_id", F.struct("b", F.array(*[row(a) for a in k]).alias("m"), first.alias("f")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("bs"))

    def through(acc, x):
        last = F.element_at(acc, -1)
        return F.array_append(acc, F.array(*[F.array_max(F.array(*[last[a] + x["m"][a][j] for a in k])) for j in k]))
    ends = F.aggregate(F.slice("bs", F.lit(2), F.size("bs")), F.array(F.element_at("bs", 1)["f"]), through)
    before = matrices.withColumn("ends", ends).select("doc_id", F.posexplode("bs").alias("n", "x"), "ends").select(
        "doc_id", F.col("x.b").alias("b"), F.when(F.col("n") > 0, F.get("ends", F.col("n") - 1)).alias("entry"))

    # pointers of each line: for each label the best label of the line before; none on the first line of a text
    def best_before(scores, j):
        return F.array_max(F.array(*[F.struct((scores[a] + F.lit(step[a][j])).alias("s"), F.lit(-a).alias("a")) for a in k]))

    def point(acc, x):
        found = [best_before(acc["s"], j) for j in k]
        return F.struct(F.array(*[f["s"] + x["e"][j] for j, f in zip(k, found)]).alias("s"), F.array_append(acc["ps"], F.array(*[(-f["a"]).cast("int") for f in found])).alias("ps"))
    none = F.array().cast("array<array<int>>")
    opened = F.struct(F.array(*[log("start", "-", LABELS[j]) + F.element_at("xs", 1)["e"][j] for j in k]).alias("s"), F.array_append(none, F.array(*[F.lit(j) for j in k])).alias("ps"))
    begun = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), opened, point)
    going = F.aggregate("xs", F.struct(F.col("entry").alias("s"), none.alias("ps")), point)
    scored = cut_lineage(blocks.join(before, ["doc_id", "b"]).withColumn("r", F.when(F.col("entry").isNull(), begun).otherwise(going)).select("doc_id", "b", F.transform("xs", lambda x: x["i"]).alias("is"), "r"))

    # the label before the block for each label at its end
    back = F.aggregate(F.reverse("r.ps"), F.array(*[F.lit(j) for j in k]), lambda to, p: F.transform(to, lambda j: p[j]))
    maps = scored.select("doc_id", F.struct("b", back.alias("back"), F.col("r.s").alias("s")).alias("x")).groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("bs"))
    top = F.array_max(F.transform(F.element_at("bs", 1)["s"], lambda s, j: F.struct(s.alias("s"), (-j).alias("j"))))
    exits = F.aggregate("bs", F.array((-top["j"]).cast("int")), lambda acc, x: F.array_append(acc, x["back"][F.element_at(acc, -1)]))
    out = maps.withColumn("exits", exits).select("doc_id", F.posexplode("bs").alias("n", "x"), "exits").select("doc_id", F.col("x.b").alias("b"), F.get("exits", F.col("n")).alias("exit"))
    # within the block, from its end to its start: the last label, then what the pointers name
    walk = F.aggregate(F.reverse(F.slice("r.ps", F.lit(2), F.size("r.ps"))), F.array("exit"), lambda acc, p: F.array_append(acc, p[F.element_at(acc, -1)]))
    names = F.array(*map(F.lit, LABELS))
    return scored.join(out, ["doc_id", "b"]).withColumn("path", F.reverse(walk)).select(
        "doc_id", F.inline(F.zip_with("is", "path", lambda i, j: F.struct(i.alias("i"), F.element_at(names, j + 1).alias("label")))))


# --- decisions -------------------------------------------------------------------------------

def content_accuracy(pairs: DataFrame) -> DataFrame:
    """pairs(truth, pred) -> right, counted, accuracy over lines either side puts in the recipe."""
    counted = (F.col("truth") != "other") | (F.col("pred") != "other")
    return pairs.agg(F.count_if(counted & (F.col("truth") == F.col("pred"))).alias("right"), F.count_if(counted).alias("counted")).withColumn(
        "accuracy", F.coalesce(F.try_divide("right", "counted"), F.lit(0.0)))


def adoption(scored: DataFrame) -> DataFrame:
    """scored(doc_id, truth, learned, rules) of imported records -> one decision row."""
    counted = lambda c: (F.col("truth") != "other") | (F.col(c) != "other")
    acc = lambda c: F.coalesce(F.try_divide(F.count_if(counted(c) & (F.col("truth") == F.col(c))), F.count_if(counted(c))), F.lit(0.0))
    d = scored.agg(F.count_distinct("doc_id").alias("records"), acc("learned").alias("learned"), acc("rules").alias("rules"))
    status = F.when(F.col("records") < W.MIN_IMPORTED, "not_enough_data").when(F.col("learned") < F.col("rules") + W.MIN_GAIN, "rules_better").otherwise("active")
    return d.withColumn("status", status)


def safeguarded(rules: DataFrame, model: DataFrame) -> DataFrame:
    """rules, model(doc_id, ingredients, steps): the model's result unless it loses a
    section, the rules found parts, or two or more measured lines are lost."""
    j = rules.select("doc_id", F.col("ingredients").alias("ri"), F.col("steps").alias("rs")).join(
        model.select("doc_id", F.col("ingredients").alias("mi"), F.col("steps").alias("ms")), "doc_id", "left")
    norm = lambda a: F.transform(a, lambda x: T.squeeze(F.lower(x)))
    measured = F.filter("ri", lambda x: x.rlike(P.QTY_START))
    lost = F.size(F.filter(norm(measured), lambda x: ~F.array_contains(norm(F.col("mi")), x)))
    why = (F.when(F.col("mi").isNull(), "no result").when((F.size("mi") == 0) & (F.size("ri") > 0), "no ingredients").when((F.size("ms") == 0) & (F.size("rs") > 0), "no steps")
           .when(F.exists("ri", T.is_part_name), "parts").when(lost >= 2, "measured lines lost").otherwise("model"))
    return j.select("doc_id", why.alias("outcome"), F.when(why == "model", F.col("mi")).otherwise(F.col("ri")).alias("ingredients"))


def uncertain(probs: DataFrame) -> DataFrame:
    """probs(doc_id, i, label, p): section lines below the sure mark."""
    return probs.filter(F.col("label").isin("ingredient", "step") & (F.col("p") < W.UNSURE_BELOW))


def publish(model, root: str, spark, report: dict) -> str:
    """Writes a new generation and commits a pointer to it. Nothing is overwritten: a reader finds the newest
    pointer, so it sees the old generation or the new one, whole; of two writers each gets a generation of its own."""
    path = f"{root}/gen-{uuid.uuid4().hex}"
    model.write().save(path)
    manifest.update(spark, root, lambda old: {"path": path, "report": report, "before": (old or {}).get("path")})
    return path


def current_model(root: str, spark) -> str | None:
    found = manifest.newest(spark, root)[1]
    return found["path"] if found else None
