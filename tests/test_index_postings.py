"""Live postings come straight from the segments."""
import random

from pyspark.sql import functions as F

from quern.operators import index as IX


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rng = random.Random(4)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    return spark.createDataFrame([(d, " ".join(rng.choice(words) for _ in range(30))) for d in range(60)], "doc_id long, text string")


def test_live_postings_are_not_put_in_blocks_again(spark, tmp_path):
    index = IX.SearchIndex.build(texts(spark), {"text": 1.0}, str(tmp_path)).change(gone=spark.range(0, 5).select(F.col("id").alias("doc_id")))
    p = index.postings()
    assert "collect_list" not in plan_of(p)
    assert {r[0] for r in p.select("doc_id").distinct().collect()} == set(range(5, 60))


def test_a_changed_index_puts_no_block_together_again(spark, tmp_path, monkeypatch):
    """The best of a changed index are those of a new one; marked documents are left out of what is opened."""
    docs = texts(spark)
    changed = docs.filter("doc_id % 7 = 1").select("doc_id", F.concat("text", F.lit(" bal cel bal")).alias("text"))
    live = docs.filter("doc_id % 7 <> 1 AND doc_id >= 5").unionByName(changed.filter("doc_id >= 5"))
    index = IX.SearchIndex.build(docs, {"text": 1.0}, f"{tmp_path}/a").change(changed).change(gone=spark.range(0, 5).select(F.col("id").alias("doc_id")))
    fresh = IX.SearchIndex.build(live, {"text": 1.0}, f"{tmp_path}/b")
    q = spark.createDataFrame([(1, "ba ce"), (2, "bal -cin"), (3, "f"), (4, "bal zzz"), (5, "cel bal cin")], "qid long, q string")
    want = sorted(map(tuple, fresh.top(q, 8).collect()))
    monkeypatch.setattr(IX.SearchIndex, "blocks", None)
    assert sorted(map(tuple, index.top(q, 8).collect())) == want and len(want) > 20


def test_blocks_shuffle_no_more_than_postings(spark):
    p = spark.createDataFrame([(d, 10 + d, "w", float(d % 3 + 1)) for d in range(300)], "doc_id long, dl long, term string, wtf double")
    made = IX.blocks_of(p)
    assert not [x for x in plan_of(made).splitlines() if " / " in x.partition("partial_collect_list")[2]]
    rows = sorted(made.collect(), key=lambda r: -r["posts"][0]["wtf"] / (r["posts"][0]["wtf"] + r["posts"][0]["dl"] / 100))
    strong = [x["wtf"] / (x["wtf"] + x["dl"] / 100) for r in rows for x in r["posts"]]
    assert [r["n"] for r in rows] == [128, 128, 44] and strong == sorted(strong, reverse=True)
    assert all(r["top_wtf"] == max(x["wtf"] for x in r["posts"]) and r["low_dl"] == min(x["dl"] for x in r["posts"]) for r in rows)
