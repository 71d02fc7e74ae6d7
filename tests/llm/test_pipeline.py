import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from quern.llm import queries
from quern.llm.bpe import Splitter, replay, vocabulary

from .common import odd_texts
from .test_content_sort import wanted
from .test_minhash import plain_classes

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        ids = [i for i, _ in before]
        if name == "exact_dedup":
            assert kept[name] == {w[0] for w in wanted(before) if w[4]}
        if name == "near_dedup":
            classes = plain_classes([t for _, t in before])
            assert kept[name] == {ids[c] for c in classes}
        if name == "tokens":
            ranks, merges, _ = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            split = Splitter(public_tokenizers.PATTERN)
            want = {i: np.array([x for w in replay([w.encode() for w in split.words(t or "")], ranks, merges) for x in w], np.uint32).tobytes() for i, t in before}
            got = docs.collect()
            assert {r["doc_id"]: bytes(r["ids"]) for r in got} == want
            assert all(r["decoded_sha256"] == hashlib.sha256((dict(before)[r["doc_id"]] or "").encode()).hexdigest() for r in got)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1]
    assert np.mean([i in kept["quality"] for i in good]) > 0.97


def test_odd_documents(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, id int"
    texts = odd_texts()
    docs = spark.createDataFrame([(n, t, None, "s", None, "r", None, 1) for n, t in enumerate(texts)] + [(None, None, None, None, None, None, None, None)] * 2, columns)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert name == "tokens" or out.columns == docs.columns
            assert out.count() <= len(texts) + 2


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5
