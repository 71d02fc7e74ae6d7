import hashlib
from collections import defaultdict

from quern.llm.content_sort import LOWER, UPPER, exact_groups, keep_one

from .common import empty, odd_texts, table

FOLD = str.maketrans(UPPER, LOWER)


def wanted(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    return {(i, hashlib.sha256(t.encode()).hexdigest(), max(ids), len(ids), i == max(ids)) for t, ids in groups.items() for i in ids}


def test_against_plain_groups(spark):
    texts = odd_texts() + ["Hot"] * 30 + ["hot", "İ", "i̇", "STRASSE", "straße"]
    found = exact_groups(table(spark, texts)).collect()
    assert len(found) == len(texts)
    assert {tuple(r) for r in found} == wanted(enumerate(texts))


def test_group_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = ["same"] * 4000 + [f"t{k}" for k in range(50)]
        found = exact_groups(table(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in found} == wanted(enumerate(texts))


def test_null_and_repeated_identifiers(spark):
    docs = table(spark, ["x", "X", None, "", "y", "y"], ids=[None, 4, None, None, 9, 9])
    found = sorted(exact_groups(docs).select("id", "keep_id", "group_size", "kept").collect(), key=repr)
    assert [tuple(r) for r in found if r["keep_id"] == 4] == [(4, 4, 2, True), (None, 4, 2, False)]
    assert sum(r["kept"] for r in found) == 3
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr) == sorted([(4, "x"), (None, ""), (9, "y")], key=repr)


def test_keep_one(spark):
    texts = odd_texts()
    kept = keep_one(table(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in wanted(enumerate(texts)) if w[4]}


def test_empty(spark):
    assert exact_groups(empty(spark)).collect() == []
    assert keep_one(empty(spark)).collect() == []
