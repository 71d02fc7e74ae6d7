import numpy as np

from quern.llm.mixing import Mixture, classifier, fitted, mixed_documents

from .common import empty, odd_texts, table

DOMAINS = ["a", "b", "c"]


def compact_of(spark, p, tokens):
    return spark.createDataFrame([(int(m), [float(x) for x in row]) for m, row in zip(tokens, p, strict=True)], "tokens long, p array<double>").repartition(3)


def test_fit_against_one_array(spark):
    rng = np.random.default_rng(1)
    p, tokens = rng.dirichlet([2, 1, 0.3], 400), rng.integers(0, 500, 400)
    tokens[0] = 40_000          # one document with a third of all
    made = fitted(compact_of(spark, p, tokens), [0.8, 0.15, 0.05], steps=15)
    # the same descent over all documents at once
    share = tokens @ p / tokens.sum()
    w = np.array([0.8, 0.15, 0.05])
    targets = w * 1.01 * share[0] / 0.8
    step, r = 1 / (np.max(share / targets) + made.pull), np.ones(400)
    for _ in range(15):
        miss = ((tokens * r) @ p / tokens.sum()) / targets - 1
        r = np.clip(r - step * (p @ miss + made.pull * (r - 1)), 0, 1)
    assert np.allclose(made.rates(p), r, atol=1e-7)


def test_fit_is_the_least_squares_solution(spark):
    """No projected step changes the rates any more, and targets that can be met are met."""
    rng = np.random.default_rng(2)
    p, tokens = rng.dirichlet([0.2, 0.2, 0.2], 300), rng.integers(1, 300, 300)
    made = fitted(compact_of(spark, p, tokens), [0.6, 0.3, 0.1], budget=0.5, steps=50, pull=0.05)
    r = made.rates(p)
    share = (tokens * r) @ p / tokens.sum()
    moved = np.clip(r - made.step * (p @ (share / made.targets - 1) + made.pull * (r - 1)), 0, 1)
    assert np.abs(moved - r).max() < 5e-3
    assert np.allclose(share, made.targets, rtol=0.08)
    assert r.min() >= 0 and r.max() <= 1


def test_rates_above_one(spark):
    p, tokens = np.array([[1.0, 0], [0, 1.0]]), np.array([10, 90])
    made = fitted(compact_of(spark, p, tokens), [0.5, 0.5], budget=0.6, max_rate=5, steps=50, pull=1e-3)
    assert np.allclose(made.rates(p), [3, 1 / 3], atol=0.05)


def test_documents(spark):
    texts = ["alpha beta gamma"] * 30 + ["delta *** epsilon"] * 30 + ["zeta, eta; theta"] * 30 + [t for t in odd_texts() if len(t or "") < 5000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, DOMAINS[i // 30]) for i in range(0, 90, 2)] + [(1, None), (None, "a")], "doc_id long, domain string")
    model = classifier(docs, labels, DOMAINS)
    found = {r["doc_id"]: r for r in mixed_documents(docs, model, [0.9, 0.05, 0.05]).select("row.doc_id", "tokens", "p", "copies").collect()}
    assert len(found) == len(texts)
    for k in range(90):
        assert int(np.argmax(found[k]["p"])) == k // 30
    copies = [sum(found[k]["copies"] for k in range(30 * d, 30 * d + 30)) for d in range(3)]
    assert copies[0] == 30 and copies[1] < 15 and copies[2] < 15
    assert found[90]["tokens"] == 0 and np.allclose(found[90]["p"], np.exp(model.prior), atol=1e-6)


def test_no_tokens_no_labels_no_rows(spark):
    docs = table(spark, [None, "", ""])
    none = spark.createDataFrame([], "doc_id long, domain string")
    model = classifier(docs, none, DOMAINS)
    assert np.allclose(np.exp(model.prior), 1 / 3)
    assert [r["copies"] for r in mixed_documents(docs, model, [1, 1, 1]).collect()] == [1, 1, 1]
    assert mixed_documents(empty(spark), model, [1, 1, 1]).collect() == []
    assert Mixture(np.ones(2)).rates(np.ones((3, 2)) / 2).tolist() == [1, 1, 1]


def test_descent_ends_when_rates_stand_still(spark):
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([3, 0.5, 0.2], 300), rng.integers(1, 300, 300)
    made = fitted(compact_of(spark, p, tokens), [0.9, 0.08, 0.02], max_rate=3, margin=1.2, steps=400)
    assert made.moved < 2e-3 and 3 < len(made.misses) < 400
    (wanted, reached), *rest = made.report()
    assert abs(reached / wanted - 1) < 0.02 and np.isclose(reached, (tokens * made.rates(p)) @ p[:, 0])


def test_a_scarce_domain_is_raised_within_its_bound(spark):
    p, tokens = np.array([[0.98, 0.02]] * 50 + [[0.05, 0.95]] * 2), np.full(52, 100)
    made = fitted(compact_of(spark, p, tokens), [0.5, 0.5], max_rate=3, steps=200)
    rates = made.rates(p)
    assert np.allclose(rates[50:], 3) and rates.max() <= 3
    wanted, reached = made.report()[1]
    assert reached < wanted        # the bound keeps it short, and the report says so
