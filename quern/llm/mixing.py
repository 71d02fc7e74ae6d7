"""Mixing to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains.
Projected gradient descent then finds a rate of 0 or more for each document, such that the
expected tokens of the domains meet their targets in least squares while rates stay
close to 1. A step needs one sum over all documents, of as many numbers as there are
domains; a document's rate is a function of its posterior and of these sums, so nothing
is written between steps and nothing but the sums comes to the driver.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.ngrams import counted, log_shares, rows_with, sums_by_text
from quern.llm.scratch import settled, text_of

#: Bound of the labelled texts of each domain that the classifier is counted on.
TEXTS_PER_DOMAIN = 10_000
#: Pull of the rates towards 1, against a squared miss of 1.
PULL = 0.02
#: The descent ends when no rate moves by more than MOVE in a step, or after STEPS.
STEPS, MOVE = 60, 2e-3
MAX_RATE = 1.0
#: The wanted tokens of the domain that is needed whole, against what there is of it.
MARGIN = 1.01
#: Documents that a task of a step reads: some 10 MB.
ROWS = 250_000


@dataclass
class Classifier:
    domains: list[str]
    log_share: np.ndarray
    prior: np.ndarray

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Naive Bayes posteriors and the tokens of each text. Neighbouring n-grams depend on each
        other, so evidence counts as the square root of its number."""
        sums, tokens = sums_by_text(texts, self.log_share)
        z = sums / np.sqrt(np.maximum(tokens, 1))[:, None] + self.prior
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), tokens


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
               domain_col: str = "domain", per_domain: int = TEXTS_PER_DOMAIN) -> Classifier:
    """Fitted on at most ``per_domain`` texts of each domain, by a hash of the identifier; the priors are
    the shares of the domains among all labels. A domain without labels has the prior of half a label."""
    marks = labelled.filter(F.col(domain_col).isin(domains)).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("_domain"))
    found = {r["_domain"]: r["n"] for r in marks.groupBy("_domain").agg(F.count("*").alias("n")).collect()}     # a row per domain
    few = None
    for d in domains:
        part = marks.filter(F.col("_domain") == d).orderBy(F.xxhash64("_id"), "_id").limit(per_domain)
        few = part if few is None else few.unionByName(part)
    few = settled(few)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("data")).join(F.broadcast(few), "_id")
    flags = [f"d{k}" for k in range(len(domains))]
    counts = counted(rows.select("data", *((F.col("_domain") == d).alias(f) for d, f in zip(domains, flags, strict=True))), flags)
    # smoothed by the shares of all domains together
    whole = np.exp(log_shares(counts.sum(axis=0)))
    prior = np.array([found.get(d, 0) + 0.5 for d in domains])
    return Classifier(domains, log_shares(counts + 1_000 * whole, 0.0), np.log(prior / prior.sum()))


@dataclass
class Mixture:
    """Targets as shares of all tokens, and the misses of each step so far, each as a part of its target."""
    targets: np.ndarray
    step: float = 1.0
    pull: float = PULL
    max_rate: float = MAX_RATE
    misses: list[np.ndarray] = field(default_factory=list)
    #: expected shares after the last step, as parts of all tokens there are, and the largest move of a rate in it
    reached: np.ndarray | None = None
    moved: float = 0.0
    total: float = 0.0

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors ``p`` after the steps so far, all from 1."""
        return self.rates_and_move(p)[0]

    def rates_and_move(self, p: np.ndarray) -> tuple[np.ndarray, float]:
        r, move = np.ones(len(p)), 0.0
        for k, miss in enumerate(self.misses):
            after = np.clip(r - self.step * (p @ miss + self.pull * (r - 1)), 0, self.max_rate)
            if k + 1 == len(self.misses) and len(p):
                move = float(np.abs(after - r).max())
            r = after
        return r, move

    def report(self) -> list[tuple[float, float]]:
        """Wanted and reached tokens of each domain."""
        reached = self.reached if self.reached is not None else np.zeros(len(self.targets))
        return [(float(a * self.total), float(b * self.total)) for a, b in zip(self.targets, reached, strict=True)]


def _shares(compact: DataFrame, mixture: Mixture, total: float) -> tuple[np.ndarray, float]:
    """Expected token shares of the domains at the present rates, and the largest move of a rate in the last step."""
    n = len(mixture.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, moved = np.zeros(n), 0.0
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, n)
            m = batch.column("tokens").to_numpy()
            rates, move = mixture.rates_and_move(p)
            sums += (m * rates) @ p
            moved = max(moved, move)
        yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array(sums), pa.array([moved] * n)], names=["domain", "tokens", "moved"])
    made, moved = np.zeros(n), 0.0
    for r in compact.mapInArrow(run, "domain int, tokens double, moved double").groupBy("domain").agg(
            F.sum("tokens").alias("tokens"), F.max("moved").alias("moved")).collect():   # a row per domain
        made[r["domain"]], moved = r["tokens"], max(moved, r["moved"])
    return made / total, moved


def fitted(compact: DataFrame, weights: list[float], whole: int = 0, budget: float | None = None, steps: int = STEPS,
           pull: float = PULL, max_rate: float = MAX_RATE, margin: float = MARGIN, move: float = MOVE) -> Mixture:
    """The mixture for documents (tokens, p).

    ``weights`` are the wanted shares of the domains, above 0. ``budget`` is the wanted
    number of tokens as a share of those there are; by default it is such that ``margin`` times what there is of domain
    number ``whole`` is needed, which holds its rates at or above 1 where ``max_rate`` allows it. Misses count relative to
    their targets, so a small domain matters as a large one does. The descent ends when no rate moves by more than
    ``move``, or after ``steps``; the mixture's report tells wanted and reached tokens. Without tokens there
    are no steps: all rates are 1.
    """
    w = np.array(weights) / np.sum(weights)
    total = float(compact.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return Mixture(w, pull=pull, max_rate=max_rate)
    there, _ = _shares(compact, Mixture(w), total)
    if budget is None:
        budget = margin * there[whole] / w[whole]
    targets = w * budget
    # the Hessian's largest eigenvalue is at most its largest row sum
    mixture = Mixture(targets, 1 / (float(np.max(there / targets)) + pull), pull, max_rate, reached=there, total=total)
    for _ in range(steps):
        mixture.misses.append(mixture.reached / targets - 1)
        mixture.reached, mixture.moved = _shares(compact, mixture, total)
        if mixture.moved < move:
            break
    return mixture


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text", mixture: Mixture | None = None) -> DataFrame:
    """(row, tokens, p): the tokens of each whole text and its posteriors, and its ``rate`` in a
    mixture. A text without tokens has the priors."""
    def make(texts: list[bytes]) -> list:
        p, n = model.posteriors(texts)
        p = np.round(p, 9)
        return [n, list(p), *([np.round(mixture.rates(p), 9)] if mixture else [])]
    fields = [("tokens", "bigint", pa.int64()), ("p", "array<double>", pa.list_(pa.float64()))]
    return rows_with(docs, text_col, [*fields, *([("rate", "double", pa.float64())] if mixture else [])], make)


def mixture_of(docs: DataFrame, model: Classifier, weights: list[float], text_col: str = "text", **how) -> Mixture:
    """The mixture for documents. Every step reads their tokens and posteriors alone, ROWS documents in a task."""
    compact = settled(with_posteriors(docs.select(text_col), model, text_col).select("tokens", "p"))
    return fitted(compact.coalesce(compact.count() // ROWS + 1), weights, **how)


def mixed_documents(docs: DataFrame, model: Classifier, weights: list[float], id_col: str = "doc_id", text_col: str = "text",
                    mixture: Mixture | None = None, **how) -> DataFrame:
    """(row, tokens, p, rate, copies), where row is a struct of all columns: how often a document is
    in the mixture (one fitted here, or the one given), its rate rounded up or down at random with the rate as mean. The draw depends
    on identifier and text only. Null texts are empty, texts without tokens count nothing and
    have the rate of their priors; an empty table gives an empty one."""
    mixture = mixture or mixture_of(docs, model, weights, text_col, **how)
    draw = (F.pmod(F.xxhash64(f"row.{id_col}", f"row.{text_col}", F.lit("mix")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return with_posteriors(docs, model, text_col, mixture).withColumn("copies", F.floor(F.col("rate") + draw).cast("bigint"))
