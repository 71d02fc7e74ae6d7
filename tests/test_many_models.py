"""Many models in one pass against models fitted one by one."""
import random

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quern.operators import learn, many


def frames(spark, n=160, dim=60):
    rng = random.Random(7)
    cells, labels = [], []
    for d in range(n):
        tags = [t for t in ("a", "b", "c") if rng.random() < {"a": 0.5, "b": 0.25, "c": 0.1}[t]]
        for c in rng.sample(range(3, dim), 12):
            cells.append((d, c, rng.random()))
        cells += [(d, k, 1.5 * rng.random()) for k, t in enumerate("abc") if t in tags or rng.random() < 0.2]
        labels.append((d, tags))
    cells += [(n, 5, 1.0)]
    labels += [(n, None)]
    return spark.createDataFrame(cells, "doc_id long, col int, value double"), spark.createDataFrame(labels, "doc_id long, tags array<string>")


POSITIVE = {"a": 1.0, "b": 2.5, "c": 5.0}


def plain_fit(x, y, weight, l2):
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (weight * (p - y)) + l2 * w
        w -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + l2 * np.eye(len(w)), g)
    return w


def test_every_model_is_its_own_optimum(spark):
    cells, labels = frames(spark)
    rows = many.sparse_rows(cells, labels, 3).cache()
    made = many.fit_many(rows, POSITIVE, 3, l2=1.0, dim=60, close=1e-5)
    data = rows.collect()
    x = np.zeros((len(data), 60))
    for k, r in enumerate(data):
        x[k, r["cols"]] = r["vals"]
    at = np.array([r["fold"] for r in data])
    assert made.passes < 80 and set(at) == {0, 1, 2}
    p = {(r["doc_id"], r["tag"]): r["p"] for r in many.scores(rows, made).collect()}
    for t in POSITIVE:
        y = np.array([t in (r["tags"] or []) for r in data], float)
        for f in range(3):
            use = at != f
            want = plain_fit(x[use], y[use], np.where(y[use] > 0, POSITIVE[t], 1.0), 1.0)
            assert np.abs(made.of(t, f) - want).max() < 2e-3
            for k in np.flatnonzero(~use):
                assert abs(p[data[k]["doc_id"], t] - 1 / (1 + np.exp(-(x[k] @ want)))) < 1e-3
    rows.unpersist()


def test_decisions_of_single_fits(spark):
    cells, labels = frames(spark)
    rows = many.sparse_rows(cells, labels, 0)
    got = {(r["doc_id"], r["tag"]): r["p"] for r in many.scores(rows, many.fit_many(rows, POSITIVE, close=1e-5)).collect()}
    vectors = learn.vectors(cells, ["doc_id"]).join(labels.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))), "doc_id")
    for t, weight in POSITIVE.items():
        train = vectors.withColumn("y", F.array_contains("tags", t).cast("int"))
        one = learn.fit_tag(train, weight, max_iter=200).transform(train).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()
        assert all(abs(got[r["doc_id"], t] - r["p"]) < 5e-3 for r in one)


def test_passes_do_not_grow_with_tags(spark):
    cells, labels = frames(spark)
    labels = labels.withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.transform(F.sequence(F.lit(0), F.lit(46)), lambda k: F.concat(F.lit("t"), F.pmod(F.xxhash64("doc_id", k), F.lit(60)).cast("string")))))
    rows = many.sparse_rows(cells, labels, 5).cache()
    one = many.fit_many(rows, {"a": 1.0}, 5, dim=60)
    all_of_them = many.fit_many(rows, {"a": 1.0, "b": 1.0, "c": 1.0} | {f"t{k}": 1.0 for k in range(47)}, 5, dim=60)
    assert all_of_them.weights.shape == (60, 250) and all_of_them.passes <= one.passes + 12
    rows.unpersist()


def test_more_tags_than_one_run_fits(spark):
    cells, labels = frames(spark)
    rows = {most: {(r["doc_id"], r["tag"]): (r["p"], r["truth"]) for r in many.out_of_fold(cells, labels, POSITIVE, 2, most=most, dim=60, close=1e-6).collect()} for most in (2, 500)}
    assert rows[2].keys() == rows[500].keys() and len(rows[2]) == 161 * 3
    assert all(abs(p - rows[500][k][0]) < 1e-3 and truth == rows[500][k][1] for k, (p, truth) in rows[2].items())


def test_every_able_tag_gets_a_model(spark, tmp_path):
    """Sixty sources: all have a line in the report, not the fifty most used."""
    from quern.plans import registry
    docs = [(d, f"text of number {d % 60} and {d}", ["en", "fr"][d % 2], f"source{d % 60:02}", 20) for d in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, d % 2, int(d % 5 == 0)) for d in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = [r["tag"] for r in registry.queries()["ml10_many_tags"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([*(f"source:source{k:02}" for k in range(60)), "lang:en", "lang:fr", "quality", "toxic"])
