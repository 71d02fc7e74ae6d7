"""Best label sequences over blocks, and case folders."""
import json
import math
import random
import time

from pyspark.sql import functions as F

from quern.operators import learn
from quern.sources import cases

LABELS = learn.LABELS


def probabilities(seed):
    rng = random.Random(seed)
    def share(kind, a, names):
        w = [rng.random() + 0.05 for _ in names]
        return {(kind, a, b): x / sum(w) for b, x in zip(names, w)}
    out = share("start", "-", LABELS) | share("prior", "-", LABELS)
    for a in LABELS:
        out |= share("step", a, LABELS)
    return out


def plain(rows, probs):
    """One line after the other, with pointers back."""
    lg = lambda *k: math.log(probs[k])
    emit = lambda p, j: math.log(p[j] + 1e-9) - lg("prior", "-", LABELS[j])
    k = range(4)
    scores, pointers = [lg("start", "-", LABELS[j]) + emit(rows[0], j) for j in k], []
    for p in rows[1:]:
        best = [max(k, key=lambda a, j=j: (scores[a] + lg("step", LABELS[a], LABELS[j]), -a)) for j in k]
        scores = [scores[best[j]] + lg("step", LABELS[best[j]], LABELS[j]) + emit(p, j) for j in k]
        pointers.append(best)
    at = max(k, key=lambda j: (scores[j], -j))
    path = [at]
    for best in reversed(pointers):
        at = best[at]
        path.append(at)
    return [LABELS[j] for j in reversed(path)]


def test_blocks_give_the_path_of_one_pass(spark):
    rng, probs = random.Random(4), probabilities(1)
    docs = {d: [[rng.random() for _ in range(4)] for _ in range(n)] for d, n in enumerate([1, 2, 3, 4, 7, 16, 40, 131])}
    gaps = {d: sorted(rng.sample(range(3 * len(ps)), len(ps))) for d, ps in docs.items()}     # line numbers need not follow each other
    e = spark.createDataFrame([(d, i, p) for d, ps in docs.items() for i, p in zip(gaps[d], ps)], "doc_id long, i long, p array<double>")
    want = {(d, i): l for d, ps in docs.items() for i, l in zip(gaps[d], plain(ps, probs))}
    for block in (1, 3, 128):
        assert {(r["doc_id"], r["i"]): r["label"] for r in learn.best_path(e, probs, block).collect()} == want


def test_long_texts_cost_in_proportion(spark):
    probs, took = probabilities(2), []
    for n in (20_000, 20_000, 100_000):
        e = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(97)) / 97.0).alias("p"))
        t = time.time()
        assert learn.best_path(e, probs).groupBy("label").count().agg(F.sum("count")).first()[0] == n
        took.append(time.time() - t)
    assert took[2] < 8 * max(took[1], 2)


def folders(tmp_path, n=20):
    for k in range(n):
        f = tmp_path / f"c{k:03d}"
        f.mkdir()
        (f / "input.txt").write_text(f"text {k} é")
        (f / "meta.json").write_text(json.dumps({"type": "text", "language": "en", "checked": k % 2 == 0}))
        if k % 3:
            (f / "expected.json").write_text("{}")
    (tmp_path / "no-meta").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "meta.json").write_text("{")
    (tmp_path / "loose.txt").write_text("x")


def test_case_folders(spark, tmp_path):
    cases.register(spark)
    folders(tmp_path)
    d = spark.read.format("case_folders").option("group", 6).load(str(tmp_path))
    assert d.rdd.getNumPartitions() == 4
    rows = {r["case_id"]: r for r in d.collect()}
    assert len(rows) == 20 and rows["c004"]["input"] == "text 4 é" and rows["c004"]["checked"] and rows["c003"]["expected"] is None
    assert [r["case_id"] for r in d.filter("case_id IN ('c001', 'c019', 'none')").orderBy("case_id").collect()] == ["c001", "c019"]


def test_a_filter_reads_no_other_folder(tmp_path):
    folders(tmp_path)
    reader = cases.CaseReader(str(tmp_path), 64)
    left = list(reader.pushFilters([cases.EqualTo(("case_id",), "c002"), cases.EqualTo(("lang",), "en")]))
    assert left == [cases.EqualTo(("lang",), "en")] and [p.names for p in reader.partitions()] == [["c002"]]


def test_cases_written_and_read_back(spark, tmp_path):
    cases.register(spark)
    rows = [("a1", "url", "fr", True, "<p>é</p>", '{"x":1}'), ("a2", "text", None, None, "", None)]
    spark.createDataFrame(rows, cases.SCHEMA).write.format("case_folders").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "a1").iterdir()) == ["expected.json", "input.html", "meta.json"]
    assert sorted(map(tuple, spark.read.format("case_folders").load(str(tmp_path / "out")).collect())) == rows
    assert spark.read.format("case_folders").load(str(tmp_path / "empty")).collect() == []


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(9)
    words = [a + b + c for a in "bcdf" for b in "aeo" for c in "lm"]
    text = lambda n: " ".join(rng.choice(words + ["common"] * 12) for _ in range(n))
    lines = [(d, i, text(rng.randint(0, 7))) for d in range(3) for i in range(40)]
    items = [(d, l, k, text(rng.randint(0, 12))) for d in range(3) for k in range(25) for l in ("ingredient", "step")] + [(0, "title", 0, lines[3][2])]
    found = learn._overlaps(spark.createDataFrame(lines, "doc_id long, i long, line string"), spark.createDataFrame(items, "doc_id long, label string, k long, text string"))
    want = set()
    for d, i, line in lines:
        t = set(line.split())
        for e, l, k, s in items:
            both = len(t & set(s.split()))
            if d == e and t and both >= 0.75 * len(t):
                want.add((d, i, l, k, both, len(t), len(set(s.split()))))
    got = [tuple(r[c] for c in ("doc_id", "i", "label", "k", "inter", "n_line", "n_item")) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
