"""Query of the mixture; it has no SQL (an iterated fit)."""
from pyspark.sql import functions as F

from quern.llm.mixing import classifier, mixed_documents, mixture_of

NAME = "op2_mixing"
#: Domains by the labels, and the shares of tokens that the mixture is to have; of the first one a fifth more than there is.
DOMAINS = ["good", "poor", "toxic"]
WEIGHTS = [0.95, 0.04, 0.01]
#: A document is drawn three times at most. (The pipeline keeps rates at 1 or less: it has just taken copies out.)
HOW = {"max_rate": 3.0, "margin": 1.2}


def domains_of(labels):
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor")
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").alias("domain"))


def run(spark, path):
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = classifier(docs, domains_of(labels), DOMAINS)
    mixture = mixture_of(docs, model, WEIGHTS, **HOW)
    made = mixed_documents(docs, model, WEIGHTS, mixture=mixture)
    p = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    totals = [F.lit(round(v, 3)).alias(f"{name}_{d}") for d, pair in zip(DOMAINS, mixture.report(), strict=True) for name, v in zip(("wanted", "reached"), pair, strict=True)]
    return made.select("row.doc_id", F.col("tokens").alias("n_tokens"), *p, "rate", "copies", *totals)


SQL = None
