"""Documents to a tokenised training mixture: each stage is one operator over what the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again, so a lost executor costs tasks of one stage at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.bpe import decode, encode
from quern.llm.content_sort import keep_one
from quern.llm.importance import keep_share, log_ratios, resampled
from quern.llm.minhash import near_classes
from quern.llm.mixing import classifier, mixed_documents
from quern.llm.q_mixing import DOMAINS, WEIGHTS, domains_of
from quern.llm.scratch import new_path

#: SQL can't express the models and samples of the stages; tests hold run() against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the importance sample go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resampled(docs, log_ratios(docs, labels), keep_share(labels)).filter("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays. An identifier with several rows goes
    only if none of them is kept."""
    classes = near_classes(docs)
    gone = classes.groupBy("id").agg(F.max("kept").alias("stays")).filter("NOT stays").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture draws it."""
    labels = domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = mixed_documents(docs, classifier(docs, labels, DOMAINS), WEIGHTS)
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its number of tokens, their ids, and digests of the ids and of the bytes they stand for."""
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
