"""Skewed keys, connected groups, streams, sources and model publishing."""
import json
import random

from pyspark.sql import functions as F

from quern.operators import dedupe as D, learn as M, selection as S
from quern.plans.skew import running_totals, salted_lookup
from quern.sources import exchange as X, pages as PG
from quern.streaming import streams as ST


def test_salted_lookup_hot_key(spark):
    left = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    out = salted_lookup(left, right, ["k"])
    assert out.count() == 3000 and out.filter("k = 0").first()["c"] == 1000


def test_running_totals_equals_plain_sum(spark):
    rng = random.Random(5)
    rows = [(("hot" if i % 3 == 0 else f"k{i % 7}"), rng.randrange(1000) / 1000 + i / 1e6, 1) for i in range(400)]
    d = running_totals(spark.createDataFrame(rows, "k string, p double, v int"), ["k"], F.desc("p"), F.floor((1 - F.col("p")) * 64), {"total": F.col("v")})
    for r in d.collect():
        assert r["total"] == sum(v for k, p, v in rows if k == r["k"] and p >= r["p"])


def test_groups_of_a_long_chain_and_many_copies(spark):
    # a chain: link i and title i alternate; a mass of copies; loners without keys
    rows = [(i, f"t{i // 2}", f"http://x.org/{(i + 1) // 2}") for i in range(40)] + [(100 + i, "copy", None) for i in range(200)] + [(900 + i, "!!", None) for i in range(3)]
    got = D.groups(D.keyed(spark.createDataFrame(rows, "id long, title string, source_url string"))).collect()
    by = {}
    for r in got:
        by.setdefault(r["group_id"], set()).add(r["id"])
    assert by == {0: set(range(40)), 100: set(range(100, 300))}


def test_lookup_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"name {rng.randrange(4)}", rng.choice([None, f"http://x.org/{rng.randrange(5)}"])) for i in range(60)]
    k = D.keyed(spark.createDataFrame(rows, "id long, title string, source_url string"))
    got = {}
    for r in D.lookup(k, k).orderBy("probe_id", "rank").collect():
        got.setdefault(r["probe_id"], []).append((r["id"], r["reason"]))
    for i, t, u in rows:
        link = [(j, "link") for j, _t, v in rows if j != i and u and v == u]
        title = [(j, "title") for j, s, v in rows if j != i and s == t and not (u and v == u)]
        assert got.get(i, []) == (link + title)[:5]


def test_weighted_draw_follows_the_weights(spark):
    # exponential keys over many seeds: five stars beat one star about 1.5 to 1
    d = spark.range(20000).select(F.col("id"), S.unit_hash("a", F.col("id")).alias("u"), S.unit_hash("b", F.col("id")).alias("v"))
    wins = d.filter(-F.ln("u") / 1.2 < -F.ln("v") / 0.8).count()
    assert 1.35 < wins / (20000 - wins) < 1.65


def _quota(events, limit, width):
    log, out = [], []
    for us, eid in sorted(events):
        log = [t for t in log if us - t <= width]
        out.append((eid, len(log) < limit))
        if len(log) <= limit:
            log.append(us)
    return dict(out)


def test_quota_stream_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, 1700000000 + rng.randrange(300), "hot" if i % 3 else f"u{i % 4}") for i in range(300)]
    spark.createDataFrame(rows, "event_id long, s long, who string").select("event_id", F.timestamp_seconds("s").alias("ts"), "who").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, who string").parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["accepted"] for r in ST.run_to_end(ST.quota(stream, "who", limit=5, seconds=30)).collect()}
    want = {}
    for who in {r[2] for r in rows}:
        want |= _quota([(s * 1_000_000, e) for e, s, w in rows if w == who], 5, 30_000_000)
    assert got == want


def test_intake_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    msgs = [{"msg_id": str(i % 6), "ts": "2024-01-01T00:00:00Z", "subject": "recipe" if i % 2 else "bad", "attempts": i % 3} for i in range(9)]
    (src / "a.json").write_text("\n".join(map(json.dumps, msgs)))
    schema = "msg_id string, ts timestamp, subject string, attempts int"
    handle = lambda b: b.withColumn("status", F.when(F.col("subject") == "recipe", "ok").when(F.col("attempts") == 0, "transient").otherwise("failed"))
    for _ in range(2):    # the second run finds nothing new
        ST.intake(ST.message_source(spark, str(src), schema), handle, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    n = sum(spark.read.parquet(str(tmp_path / "out" / k)).count() for k in ("good", "retry", "failed"))
    assert n == 6


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(i, 1700000000 + s) for i, s in enumerate([0, 10, 119, 300, 419, 540, 1000])]
    spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    batch = ST.debounced(spark.read.parquet(str(tmp_path / "e")), None, "ts", 120).select("n").collect()
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "e"))
    closed = ST.run_to_end(ST.debounce_stream(stream, "ts", watermark="0 seconds").select("n")).collect()
    assert sorted(r["n"] for r in batch) == [1, 1, 2, 3]
    assert sorted(r["n"] for r in closed) == [1, 2, 3]    # the last burst is still open


def test_page_tiers(spark):
    ld = ('<script type="application/ld+json">{"@context":"x","@graph":[{"@type":["Recipe"],"name":"Pie","recipeIngredient":["1 cup <i>flour</i>",""],'
          '"recipeInstructions":[{"@type":"HowToSection","name":"Crust","itemListElement":[{"@type":"HowToStep","text":"Roll."}]},"Bake."],"recipeYield":[8]}]}</script>')
    heads = "<h1>Soupe</h1><h2>Ingrédients</h2><ul><li>1 pois</li></ul><h2>Temps de préparation : 20 min</h2><p>x</p><h2>Préparation</h2><p>Cuire.</p>"
    rows = [(1, ld), (2, heads), (3, "<p>nothing</p>"), (4, '<script type="application/ld+json">{broken</script>' + heads)]
    got = {r["page_id"]: r for r in PG.records(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1]["title"] == "Pie" and got[1]["ingredients"] == ["1 cup flour"] and got[1]["steps"] == ["Crust:", "Roll.", "Bake."]
    assert got[2]["method"] == "headings" and got[2]["ingredients"] == ["1 pois"] and got[2]["steps"] == ["Cuire."] and got[2]["title"] == "Soupe"
    assert 3 not in got and got[4]["method"] == "headings"


def test_case_folders(spark, tmp_path):
    for case, checked in (("p001", True), ("p002", False)):
        d = tmp_path / case
        d.mkdir()
        (d / "meta.json").write_text(json.dumps({"type": "text", "language": "fr", "checked": checked}))
        (d / "input.txt").write_text("un\ndeux")
        (d / "expected.json").write_text('{"title": "x"}')
    got = {r["case_id"]: (r["type"], r["checked"], r["input"]) for r in X.read_cases(spark, str(tmp_path)).collect()}
    assert got == {"p001": ("text", True, "un\ndeux"), "p002": ("text", False, "un\ndeux")}


def test_model_is_published_whole(spark, tmp_path):
    d = spark.createDataFrame([(i, f"w{i % 3}", 1.0) for i in range(12)], "doc_id long, name string, value double")
    rows = M.vectors(M.hashed(d, ["doc_id"]), ["doc_id"]).withColumn("y", (F.col("doc_id") % 3 == 0).cast("int"))
    root = str(tmp_path / "models")
    first = M.publish(M.fit_tag(rows, 2.0, max_iter=3), root, spark, {"status": "active"})
    second = M.publish(M.fit_tag(rows, 2.0, max_iter=3), root, spark, {"status": "active"})
    assert first != second and M.current_model(root, spark) == second
