"""A lexicon as a trie and as a join gives the same rows."""
import random

from pyspark.sql import functions as F

from quern.operators import lexicon as LX


def names(rng, n):
    words = [a + b for a in "bcdf" for b in ("a", "e", "o")]
    return sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(n)}), words


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_annotations(spark, monkeypatch):
    rng = random.Random(3)
    found, words = names(rng, 60)
    lexicon = spark.createDataFrame([(n, k) for k, n in enumerate(found)] + [("Ba-Be", 99), ("", 100)], "name string, mask int")
    lines = spark.createDataFrame([(" ".join(rng.choice(words) + rng.choice(["", "", "s", "es", "x", ","]) for _ in range(rng.randint(0, 9))),) for _ in range(300)] + [("",), ("BA be",)], "line string").distinct()
    def both():
        return rows(LX.annotate(lines, "line", F.lower("line"), lexicon, "name", ["name", "mask"]))
    trie = both()
    monkeypatch.setattr(LX, "FEW", 3)
    assert both() == trie and len(trie) > 200


def test_keywords(spark, monkeypatch):
    rng = random.Random(5)
    found, words = names(rng, 40)
    lexicon = spark.createDataFrame([(f"t{k % 7}", "c", k, n) for k, n in enumerate(found)] + [("t0", "c", -1, "Bä Cé")], "tag_name string, category string, ord int, keyword string")
    docs = spark.createDataFrame([(d, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for d in range(120)] + [(500, None), (501, "xx BA-CE!"), (None, "ba ce")], "doc_id long, text string")
    def both():
        return rows(LX.keyword_hits(docs, "doc_id", "text", lexicon))
    trie = both()
    monkeypatch.setattr(LX, "FEW", 3)
    assert both() == trie and len(trie) > 100


def test_no_gram_is_shuffled(spark):
    lexicon = spark.createDataFrame([("ba be", 1)], "name string, mask int")
    plan = LX.annotate(spark.range(10).select(F.lit("ba be").alias("line")), "line", F.col("line"), lexicon, "name", ["mask"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_empty_lexicon(spark):
    lexicon = spark.createDataFrame([], "name string, mask int")
    assert LX.annotate(spark.createDataFrame([("ba",)], "line string"), "line", F.col("line"), lexicon, "name", ["mask"]).collect() == []
