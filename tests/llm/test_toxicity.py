import os
import random
import zlib

import numpy as np

from quern.llm import q_toxicity
from quern.llm.toxicity import Scorer, WINDOW, fit, labelled_sample, plain, score_texts, telling_words, windows

from .common import empty, odd_texts, table

DATA = os.environ.get("QUERN_LLM_TEST_DATA", "/root/testdata/sf0.01")


def test_windows_cover_the_text():
    data = plain("word " * 100)
    cut = windows(data)
    assert all(len(w) <= WINDOW for w in cut)
    assert {i for n, w in enumerate(cut) for i in range(n * 32, n * 32 + len(w))} == set(range(len(data)))
    assert windows(plain("")) and windows(plain(None))


def test_windows_with_something_in_common_are_compressed():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100)]
    usual, telling = plain(" ".join(words)), b" horrible nonsense "
    scorer = Scorer(usual, telling)
    grams = {telling[i:i + 4] for i in range(len(telling) - 3)}
    gained = 0
    for _ in range(50):
        t = " ".join(rng.choice([*words, "horrible", "nonsense"] if rng.random() < 0.1 else words) for _ in range(80))
        saved = scorer.savings(t)
        for w, s in zip(windows(plain(t)), saved, strict=True):
            if any(w[i:i + 4] in grams for i in range(len(w) - 3)):
                assert s == max(0, scorer._base.length(w) - scorer._both.length(w))
            gained += s >= 4 and (b"horrible" in w or b"nonsense" in w)
            assert s < 4 or any(w[i:i + 4] in grams for i in range(len(w) - 3))
    assert gained >= 3


def test_copies_do_not_make_words_typical():
    toxic = [plain("one strange text full of qqqq words")] * 50 + [plain(f"a{k} vile b{k}") for k in range(50)]
    assert telling_words(toxic, [plain(f"plain {k}") for k in range(100)]) == [b"vile"]


def rare_lexicon():
    """Toxic and ordinary texts of the same words; each of 40 more is in a twentieth of the toxic ones, late in some."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    telling = ["".join(rng.choice("qrstuvwxyz") for _ in range(7)) for _ in range(40)]
    texts = []
    for k in range(1800):
        body = [rng.choice(words) for _ in range(60 if k % 100 else 5_000)]
        if k < 600:
            body[-10], body[-5] = telling[k % 40], telling[(k // 40 * 7 + k + 3) % 40]
        texts.append((" ".join(body), int(k < 600)))
    return texts, telling


def test_a_lexicon_of_rare_words_is_found():
    texts, telling = rare_lexicon()
    assert max(sum(w in t for t, y in texts if y) for w in telling) < 0.06 * 600
    found = telling_words([plain(t) for t, y in texts if y], [plain(t) for t, y in texts if not y])
    assert set(found) == {w.encode() for w in telling}
    rng = random.Random(6)
    rng.shuffle(texts)
    model = fit(texts[:1400])
    scorer = Scorer(model.ordinary, model.toxic, model.thresholds)
    right = [(float(((np.array(scorer.features(t)) - model.mean) / model.spread) @ model.weights[:-1] + model.weights[-1]) >= 0) == y for t, y in texts[1400:]]
    assert np.mean(right) > 0.95


def test_near_copies_do_not_make_words_typical():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    base = [rng.choice(words) for _ in range(40)] + ["qqqq"]
    toxic = [plain(" ".join(w if rng.random() > 0.05 or w == "qqqq" else rng.choice(words) for w in base)) for _ in range(50)]
    ordinary = [plain(" ".join(rng.choice(words) for _ in range(40))) for _ in range(300)]
    found = telling_words(toxic, ordinary)
    assert len(found) <= 1 and all(b" " in u for u in found)      # a pair whose text has edits on both sides may stay


def test_the_sample_has_whole_texts(spark):
    docs = table(spark, ["word " * 8_000 + f"end{k}" for k in range(10)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    assert all(t[-4:-1] == "end" for t, _ in labelled_sample(docs, labels))


def test_held_out_accuracy(spark):
    rows = q_toxicity.run(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    usual = np.mean([labels[r["doc_id"]] == 0 for r in held])
    clean = np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == 0])
    assert right > usual and clean < 0.03


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark):
    docs = table(spark, [f"text {k}" for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels)
    assert {t for t, _ in sample} == {f"text {k}" for k in range(40) if zlib.crc32(str(k).encode()) % 5}
    assert all(int(t.split()[1]) % 2 == y for t, y in sample)
    assert len(labelled_sample(docs, labels, per_class=3)) == 6


def test_odd_tables(spark):
    texts = odd_texts()
    assert fit([("a", 1)]) is None and fit([]) is None
    model = fit([("vile words here %d" % k, 1) for k in range(20)] + [("kind words there %d" % k, 0) for k in range(20)])
    found = score_texts(table(spark, texts), model).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["id"]: r["score"] for r in found}
    assert by[0] == by[1] and by[5] == by[6] == by[7]
    assert {r["score"] for r in score_texts(table(spark, texts), None).collect()} == {0.0}
    assert score_texts(empty(spark), model).collect() == []
