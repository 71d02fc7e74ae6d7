"""Features and alignment shuffle texts once, and no rows of words after that."""
import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quern.operators import learn as M


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rng = random.Random(4)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    return spark.createDataFrame([(d, " ".join(rng.choice(words) for _ in range(30))) for d in range(60)], "doc_id long, text string")


def test_hashed_features_are_shuffled_once(spark):
    cells = M.hashed(M.record_features(texts(spark), {"text": ("s:", 0.5)}), ["doc_id"], 16)
    assert plan_of(cells).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(cells)
    rows = cells.collect()
    bias = spark.range(1).select(F.pmod(F.crc32(F.lit("__bias__")), F.lit(16)).cast("int")).first()[0]
    assert [r["value"] for r in rows if r["col"] == bias] == [1.0] * 60
    assert len({(r["doc_id"], r["col"]) for r in rows}) == len(rows)


def test_alignment_makes_no_row_per_word(spark):
    lines = spark.createDataFrame([(d, i, t) for d in (1, 1, None) for i, t in enumerate(["Big Pie", "two eggs", "mix the eggs well"])], "doc_id long, i long, line string")
    items = spark.createDataFrame([(1, "title", 0, "big pie"), (1, "ingredient", 0, "two eggs"), (1, "step", 0, "mix the eggs well"), (None, "step", 0, "two eggs")],
                                  "doc_id long, label string, k long, text string")
    labels, coverage = M.align(lines, items)
    assert "explode" not in plan_of(labels)
    got = sorted(map(tuple, labels.filter("doc_id = 1").select("i", "label").collect()))
    assert got == [(i, l) for i, l in enumerate(["title", "ingredient", "step"]) for _ in range(2)]
    assert {r["label"] for r in labels.filter("doc_id IS NULL").collect()} == {"other"}
    assert [tuple(r) for r in coverage.filter("doc_id = 1").select("ni", "ns", "cov_ing", "cov_step").collect()] == [(1, 1, 1.0, 1.0)]


def test_alignment_shuffles_texts_once(spark):
    lines = spark.createDataFrame([(d, i, t) for d in (1, 2, None) for i, t in enumerate(["Big Pie", "two eggs", "1", "mix the eggs well"])], "doc_id long, i long, line string")
    items = spark.createDataFrame([(1, "step", 0, "mix the eggs well"), (3, "step", 0, "mix"), (None, "step", 0, "two eggs")], "doc_id long, label string, k long, text string")
    labels, coverage = M.align(lines, items)
    plan = plan_of(labels.select("doc_id", "i", "label"))
    # lines and items go to their document together; the windows afterwards sort no texts
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    assert "RLIKE" in plan and "line#" not in plan.split("RLIKE")[0]
    assert {(r["doc_id"], r["i"]): r["label"] for r in labels.collect()} == {(d, i): "step" if d == 1 and i > 1 else "other" for d in (1, 2, None) for i in range(4)}
    assert sorted((r["doc_id"] or 0, r["cov_step"]) for r in coverage.collect()) == [(0, 0.0), (1, 1.0), (3, 0.0)]


def test_letter_triples(spark):
    lines = spark.createDataFrame([(1, 0, "a😀b c"), (1, 1, "é")], "doc_id long, i long, line string").withColumn("rule", F.lit("step"))
    f = M.line_features(lines)
    assert "substring(folded" not in plan_of(f)
    got = {r["i"]: sorted(x["name"][2:] for x in r["feats"] if x["name"].startswith("c:")) for r in f.collect()}
    assert got == {0: sorted([" a😀", "a😀b", "😀b ", "b c", " c "]), 1: [" e "]}


def test_line_features_are_hashed_in_their_row(spark):
    rng = random.Random(5)
    rows = [(d, i, " ".join(rng.choice(["egg", "Mix", "the", "2 cups", "oven."]) for _ in range(6)), "step") for d in (1, 1, 2, 3, None) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, i long, line string, rule string")
    one = M.line_features(d)
    apart = M.hashed(M.feature_cells(one), ["doc_id", "i"], 64)
    inside = M.hashed(one, ["doc_id", "i"], 64)
    assert plan_of(inside).count("Exchange hashpartitioning") <= 1 and "Generate" not in plan_of(inside)
    cells = {(r["doc_id"], r["i"], c): v for r in inside.collect() for c, v in zip(r["cols"], r["vals"], strict=True)}
    want = {(r["doc_id"], r["i"], r["col"]): r["value"] for r in apart.collect()}
    assert cells.keys() == want.keys() and all(abs(cells[k] - v) < 1e-9 for k, v in want.items())
    vector = {(r["doc_id"], r["i"]): r["features"] for r in M.vectors(M.hashed(one, ["doc_id", "i"]), ["doc_id", "i"]).collect()}
    assert len(vector) == 20 and all(list(v.indices) == sorted(set(v.indices)) for v in vector.values())


def test_record_features_are_counted_in_their_row(spark):
    rows = [(1, "Eggs eggs 12 b a_b"), (1, "a b c"), (2, "7 8"), (3, None), (4, ""), (5, "x"), (None, "two eggs"), (6, "é 3 Ünder é1 ４ x\nsalt salt salt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, t in rows:
        ws = re.findall(r"\w+", "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c)))
        plain = [not re.fullmatch("[0-9]+", w) for w in ws]
        found = [(w, 0.5) for w, ok in zip(ws, plain) if ok and len(w) > 1] + [(f"{a}_{b}", 0.25) for a, b, p, q in zip(ws, ws[1:], plain, plain[1:]) if p and q]
        for name, v in found if d is not None else []:
            at = want.setdefault(d, {})
            at["s:" + name] = at.get("s:" + name, 0) + v
    for d, at in want.items():
        norm = math.sqrt(sum(math.log1p(v) ** 2 for v in at.values()))
        want[d] = {n: 3 * math.log1p(v) / norm for n, v in at.items()}
    got = {}
    for r in M.record_features(docs, {"text": ("s:", 0.5)}).collect():
        got.setdefault(r["doc_id"], {})[r["name"]] = r["value"]
    assert {d: set(x) for d, x in got.items()} == {d: set(x) for d, x in want.items()}
    assert all(abs(got[d][n] - v) < 1e-12 for d, x in want.items() for n, v in x.items())
    many = spark.range(100).hint("merge").selectExpr("id AS doc_id", "array('t') AS tags")
    columns = M.record_columns(docs, {"text": ("s:", 0.5)}, 16, many)
    assert plan_of(columns).count("Exchange hashpartitioning") == 2 and "Generate" not in plan_of(columns)
    cells = {(r["doc_id"], r["col"]): r["value"] for r in M.hashed(M.record_features(docs, {"text": ("s:", 0.5)}), ["doc_id"], 16).collect()}
    inside = columns.collect()
    assert all(list(r["cols"]) == sorted(set(r["cols"])) for r in inside) and len(inside) == len(want)
    inside = {(r["doc_id"], c): v for r in inside for c, v in zip(r["cols"], r["vals"])}
    assert set(inside) == set(cells) and all(abs(inside[k] - v) < 1e-12 for k, v in cells.items())


def test_a_fit_has_no_more_tasks_than_cores(spark):
    docs = spark.createDataFrame([(d, "fish soup" if d % 2 else "apple pie") for d in range(40)], "doc_id long, text string")
    rows = M.vectors(M.record_columns(docs, {"text": ("s:", 0.5)}), ["doc_id"]).withColumn("tags", F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("fish"))).otherwise(F.array().cast("array<string>")))
    scores = M.out_of_fold(rows.repartition(16), {"fish": 1.0}, 2)
    assert "Coalesce" in plan_of(scores)
    assert {r["doc_id"]: r["p"] > 0.5 for r in scores.collect()} == {d: d % 2 == 1 for d in range(40)}


def test_hashed_columns_are_counted_in_the_document(spark, tmp_path):
    """The same cells as from a row per word, without a shuffle or a sort of words."""
    from quern.plans import learning, registry
    from quern.model import Library
    texts = ["two words and two more 12 words", "", None, "a b", "one", "two words and two more 12 words", "12 34"]
    rows = [(d, t, "en", "s", 1) for d, t in zip([1, 2, 3, 4, 5, 1, None], texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["ml3_hashed_columns"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "Window" not in plan
    want = M.hashed(learning.features(Library(spark, str(tmp_path))), ["doc_id"]).withColumn("value", F.round("value", 6))
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 10


def test_cells_of_long_lines_are_summed_a_few_rows_at_a_time(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rng = random.Random(3)
    rows = [[rng.randrange(50) for _ in range(n)] for n in (0, 3, 900, 5, 40, 0, 2_000, 7)]
    c, v = pa.array(rows, pa.list_(pa.int32())), pa.array([[float(x) for x in r] for r in rows], pa.list_(pa.float64()))
    bias = pa.array([7] * len(rows), pa.int32())
    at_once, one = [], M._row_sums
    monkeypatch.setattr(M, "_row_sums", lambda n, row, col, value, bias: at_once.append(len(col)) or one(n, row, col, value, bias))
    monkeypatch.setattr(M, "SUMMED_CELLS", 1_000, raising=False)
    got = M._summed.func(c, v, bias).to_pylist()
    assert got == [{"cols": sorted({*r, 7}), "vals": [1.0 if k == 7 else float(k * r.count(k)) for k in sorted({*r, 7})]} for r in rows]
    assert sum(at_once) == sum(map(len, rows)) and sorted(at_once)[-2:] == [948, 2_000]
    assert M._summed.func(c.slice(0, 0), v.slice(0, 0), bias.slice(0, 0)).to_pylist() == [] and np.isfinite(at_once).all()
