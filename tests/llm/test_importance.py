import math
import random

import numpy as np

from quern.llm.importance import keep_share, kth_largest, log_ratios, resampled
from quern.llm.ngrams import counted, ngram_buckets

from .common import empty, odd_texts, table


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 100) for _ in range(500)] + [5.0] * 300 + [-1e9, 1e9, 5.000000001]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 300, len(values)):
        assert kth_largest(keys, k, bins=64) == ordered[k - 1]
    assert kth_largest(keys, len(values) + 1) is None
    assert kth_largest(spark.createDataFrame([(3.0,)] * 9, "key double"), 4) == 3.0
    assert kth_largest(keys.limit(0), 1) is None


def test_counts(spark):
    texts = odd_texts()
    rows = table(spark, texts).selectExpr("CAST(coalesce(text, '') AS BINARY) AS data", "true AS every", "doc_id % 2 = 0 AS even")
    got = counted(rows, ["every", "even"], 512)
    for k, part in enumerate((texts, texts[::2])):
        bucket, _, _ = ngram_buckets([(t or "").encode() for t in part], 512)
        assert (got[k] == np.bincount(bucket, minlength=512)).all()


def make(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(170)]
    bad = ["*** ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(30)]
    texts = good + bad
    labels = spark.createDataFrame([(i, int(i < 170)) for i in range(0, 200, 2)], "doc_id long, quality int")
    return texts, labels


def test_sample(spark):
    texts, labels = make(spark)
    docs = table(spark, texts)
    ratios = log_ratios(docs, labels)
    share = keep_share(labels)
    assert share == 1 - 0.8 * 0.15
    found = resampled(docs, ratios, share).select("row.*", "log_weight", "key", "kept").toDF(*docs.columns, "log_weight", "gumbel_key", "is_kept").collect()
    assert len(found) == 200
    for r in found:     # the weight is the sum of the ratios of its n-grams
        bucket, _, _ = ngram_buckets([r["text"].encode()], len(ratios))
        assert math.isclose(r["log_weight"], ratios[bucket].sum(), abs_tol=1e-5)
    kept = {r["doc_id"] for r in found if r["is_kept"]}
    best = sorted(found, key=lambda r: -r["gumbel_key"])[:math.ceil(share * 200)]
    assert kept == {r["doc_id"] for r in best} and set(range(170)) <= kept


def test_gumbel_noise_samples_in_proportion(spark):
    """Without any ratio a sample is uniform, and another identifier draws otherwise."""
    docs = table(spark, [f"t{k}" for k in range(4000)])
    kept = [r["doc_id"] for r in resampled(docs, np.zeros(64), 0.25).filter("kept").select("row.doc_id").collect()]
    assert len(kept) == 1000 and abs(np.mean(kept) - 2000) < 150


def test_odd_tables(spark):
    texts, labels = make(spark)
    odd = table(spark, odd_texts() + [None, None], ids=[*range(len(odd_texts())), None, None])
    ratios = log_ratios(odd, labels.filter("doc_id < 0"))
    assert not ratios.any() and keep_share(labels.limit(0)) == 1.0
    assert resampled(odd, ratios, 1.0).filter("kept").count() == len(odd_texts()) + 2
    assert resampled(empty(spark), ratios, 0.5).collect() == []
    assert log_ratios(odd, spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 1)], "doc_id long, quality int")).any()
