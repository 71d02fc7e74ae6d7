"""The stored index against plain ranking, and its upkeep."""
import math
import random
import threading
from collections import Counter
from pathlib import Path

import pytest

from quern.functions import words as W
from quern.operators import index as IX, manifest

WEIGHTS = {"title": 10.0, "body": 3.0}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("ab", "ac", "ba", "bo", "ca") for b in ("de", "do", "fi", "gu", "ka", "zz")]
    return {k: (" ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words[:10] if k % 3 else words, k=rng.randint(0, 40)))) for k in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()], "doc_id long, title string, body string")


def ranked(docs, queries, k):
    """Plain BM25 of whole texts; a word is all the terms that it starts."""
    tf = {d: Counter() for d in docs}
    for d, texts in docs.items():
        for text, weight in zip(texts, WEIGHTS.values()):
            for w in text.split():
                tf[d][w] += weight
    dl = {d: sum(len(t.split()) for t in texts) for d, texts in docs.items()}
    mean, out = sum(dl.values()) / len(dl), []
    for qid, q in queries.items():
        wanted, without = [w for w in q.split() if w[0] != "-"], [w[1:] for w in q.split() if w[0] == "-"]
        hits = [{d: s for d in docs if (s := sum(x for t, x in tf[d].items() if t.startswith(w)))} for w in wanted]
        score = {}
        for d in docs:
            if any(t in {x + e for x in without for e in ("", "s", "es", "x")} for t in tf[d]) or not all(d in h for h in hits):
                continue
            score[d] = round(sum(max(math.log((len(docs) - len(h) + 0.5) / (len(h) + 0.5)), 1e-6) * h[d] * (W.BM25_K1 + 1)
                                 / (h[d] + W.BM25_K1 * (1 - W.BM25_B + W.BM25_B * dl[d] / mean)) for h in hits), 6)
        best = sorted(score, key=lambda d: (-score[d], -d))[:k]
        out += [(qid, d, r + 1) for r, d in enumerate(best)]
    return sorted(out)


QUERIES = {1: "ab", 2: "abde bo", 3: "a b", 4: "cafi -abde", 5: "zzz", 6: "boka boka", 7: "a -ba -acdo", 8: "bazz ca ab"}


def top(index, spark, k):
    q = spark.createDataFrame(list(QUERIES.items()), "qid long, q string")
    return sorted((r["qid"], r["doc_id"], r["rank"]) for r in index.top(q, k).collect())


def files(root):
    return {str(p) for p in Path(root).rglob("*.parquet")}


def test_top_k_equals_the_full_ranking(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 4)
    monkeypatch.setattr(IX, "PART_ROWS", 50)      # commoner terms are cut into parts
    docs = corpus(400, 1)
    index = IX.SearchIndex.build(frame(spark, docs), WEIGHTS, f"file://{tmp_path}/ix")
    for k in (1, 5, 1000):
        assert top(index, spark, k) == ranked(docs, QUERIES, k)
    assert index.blocks().filter("n > 4").count() == 0 and index.blocks().count() > 600


def test_weak_blocks_are_not_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 8)
    docs = {k: ("rare", "filler " * (2 + k % 50)) if k < 300 else ("", "rare " + "filler " * 400) if k < 900 else ("", "other") for k in range(3000)}
    index = IX.SearchIndex.build(frame(spark, docs), WEIGHTS, f"file://{tmp_path}/ix")
    scored = []
    plain = IX.SearchIndex._scored
    monkeypatch.setattr(IX.SearchIndex, "_scored", lambda self, c, *a: scored.append(c.count()) or plain(self, c, *a))
    q = spark.createDataFrame([(1, "rare")], "qid long, q string")
    found = [r["doc_id"] for r in index.top(q, 6).orderBy("rank").collect()]
    assert found == [250, 200, 150, 100, 50, 0]
    assert sum(scored) < 100


def test_changes_touch_no_earlier_file(spark, tmp_path):
    docs = corpus(200, 2)
    root = tmp_path / "ix"
    first = IX.SearchIndex.build(frame(spark, docs), WEIGHTS, f"file://{root}")
    before = files(root)
    new = {k: (f"changed {docs[k][0]}", docs[k][1]) for k in range(0, 200, 60)} | {500: ("abde", "new text")}
    gone = [7, 8, 60, 999]
    second = first.change(frame(spark, {k: v for k, v in new.items()}), spark.createDataFrame([(x,) for x in gone if x != 60], "doc_id long"))
    third = second.change(gone=spark.createDataFrame([(60,)], "doc_id long"))
    left = {k: v for k, v in (docs | new).items() if k not in gone}
    assert before <= files(root) and top(third, spark, 20) == ranked(left, QUERIES, 20)
    assert top(first, spark, 20) == ranked(docs, QUERIES, 20)            # an earlier state can still be read
    rebuilt = IX.SearchIndex.build(frame(spark, left), WEIGHTS, f"file://{tmp_path}/other")
    rows = lambda i: sorted(map(tuple, i.postings().select("doc_id", "dl", "term", "wtf").collect()))
    assert rows(third) == rows(rebuilt) == rows(third.compact())
    again = IX.SearchIndex(spark, f"file://{root}").change(frame(spark, {60: ("abde", "back")}))
    assert again.state["segments"][1:] and top(again, spark, 20) == ranked(left | {60: ("abde", "back")}, QUERIES, 20)


def test_empty_index(spark, tmp_path):
    index = IX.SearchIndex.build(spark.createDataFrame([], "doc_id long, title string, body string"), WEIGHTS, f"file://{tmp_path}/ix")
    assert top(index, spark, 5) == []
    with pytest.raises(FileNotFoundError):
        IX.SearchIndex(spark, f"file://{tmp_path}/none")


def test_two_writers_take_different_numbers(spark, tmp_path):
    root, got = f"file://{tmp_path}/m", []
    assert manifest.newest(spark, root) == (0, None)

    def write(n):
        got.append(manifest.update(spark, root, lambda old: {"seen": [*(old or {"seen": []})["seen"], n]})[0])
    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    number, content = manifest.newest(spark, root)
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and number == 6 and sorted(content["seen"]) == list(range(6))
    assert not manifest.commit(spark, root, 6, {"seen": []})
