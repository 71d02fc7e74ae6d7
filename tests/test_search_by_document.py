"""A search shuffles postings once and hits never."""
import random
import re

from pyspark.sql import functions as F

from quern.operators import search as S
from quern.session import cut_lineage, kept_by_document


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_again(df):
    """Shuffles that Spark had to add."""
    return re.findall(r"hashpartitioning\([^)]*\), ENSURE_REQUIREMENTS", plan_of(df))


def texts(spark):
    rng = random.Random(4)
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    return spark.createDataFrame([(d, " ".join(rng.choice(words) for _ in range(30))) for d in range(60)], "doc_id long, text string")


def test_search_keeps_postings_with_their_document(spark):
    docs = texts(spark)
    ix = cut_lineage(S.postings(docs, ["text"]))
    q = spark.createDataFrame([(1, "ba ce"), (2, "bal -cel"), (3, "fa")], "qid long, q string")
    hits = S.search(q, docs, ix, {"text": 1.0}, typos=False)
    assert not dealt_again(hits)
    held = {r["doc_id"]: set(r["text"].split()) for r in docs.collect()}
    starts = lambda d, w: any(x.startswith(w) for x in held[d])
    want = ({(1, d) for d in held if starts(d, "ba") and starts(d, "ce")} | {(2, d) for d in held if starts(d, "bal") and "cel" not in held[d]}
            | {(3, d) for d in held if starts(d, "fa")})
    assert {(r["qid"], r["doc_id"]) for r in hits.collect()} == want and want
    w = S.parse(q).filter("NOT leave_out").withColumn("prefix", F.col("word"))
    assert not dealt_again(S.excerpts(w, ix, S.vocabulary_of(ix), docs, ["text"]))


def test_kept_postings_are_not_shuffled_whatever_number_of_terms_a_word_starts(spark):
    """More terms than a table that is sent to the tasks may have."""
    docs = spark.createDataFrame([(d, " ".join(f"ba{d}x{k}" for k in range(2_000)) + " ce") for d in range(60)], "doc_id long, text string")
    ix = kept_by_document(S.postings(docs, ["text"]))
    q = spark.createDataFrame([(1, "ba ce"), (2, "ba7 ce -ba7x5"), (3, "zz")], "qid long, q string")
    hits = S.search(q, docs, ix, {"text": 1.0}, typos=False)
    assert not re.findall(r"hashpartitioning\([^)]*\)", plan_of(hits))
    assert {(r["qid"], r["doc_id"]) for r in hits.collect()} == {(1, d) for d in range(60)}
    q = spark.createDataFrame([(1, "ba ce"), (2, "ba7x ce")], "qid long, q string")
    w = S.parse(q).withColumn("prefix", F.col("word"))
    found = S.excerpts(w, ix, S.vocabulary_of(ix), docs, ["text"])
    assert not dealt_again(found) and len(re.findall("REPARTITION_BY_NUM", plan_of(found))) <= 2      # the texts, in the first plan and in the last one
    shown = {(r["qid"], r["doc_id"]): r["excerpt"] for r in found.collect()}
    assert shown.keys() == {(1, d) for d in range(60)} | {(2, 7)} and shown[2, 7] == " ".join(f"\x02ba7x{k}\x03" for k in range(10))


def test_prefixes_of_one_word_count_a_term_once(spark):
    """A word and its corrections may start the same terms."""
    docs = spark.createDataFrame([(1, "tomato tomatoes tom"), (2, "tomatoes"), (3, "other")], "doc_id long, text string")
    ix = S.postings(docs, ["text"])
    prefixes = spark.createDataFrame([(7, 0, "tomat"), (7, 0, "tomato"), (7, 0, "oth"), (8, 0, "tom"), (9, 0, "")], "qid long, n long, prefix string")
    n, lengths = F.lit(3), S.document_lengths(ix)
    got = {(r["qid"], r["doc_id"]) for r in S.matches(prefixes, ix, {"text": 1.0}, n, lengths, F.lit(2.0)).collect()}
    assert got == {(7, 1), (7, 2), (7, 3), (8, 1), (8, 2)}
    one = {r["doc_id"]: r["score"] for r in S.matches(prefixes.filter("qid = 8"), ix, {"text": 1.0}, n, lengths, F.lit(2.0)).collect()}
    two = {r["doc_id"]: r["score"] for r in S.matches(prefixes.filter("prefix <> 'oth' AND qid = 7"), ix, {"text": 1.0}, n, lengths, F.lit(2.0)).collect()}
    assert one[2] == two[2] and one[1] > two[1]      # three words of the first text, two of them


def test_misspelt_words_go_to_the_vocabulary(spark):
    """The deletion keys of the terms are not shuffled."""
    vocab = spark.createDataFrame([(w, 1) for w in ("tomato", "potato", "onion", "onions", "garlic")], "term string, docs long")
    words = spark.createDataFrame([("tomatto",), ("onoin",), ("gralic",)], "word string")
    found = S.fuzzy(words, vocab)
    assert not re.findall(r"hashpartitioning\(key", plan_of(found))
    assert {(r["word"], r["term"], r["d"]) for r in found.collect()} == {("tomatto", "tomato", 1), ("onoin", "onion", 1), ("gralic", "garlic", 1)}
