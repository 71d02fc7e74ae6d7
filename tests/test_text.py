"""Golden rows for text rules, keys and amounts."""
import difflib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from quern.functions import amounts as A, text as T
from quern.operators import enrich as E, evaluate as V, learn as M, search as S, segment as G


def values(spark, fn, inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    d = spark.createDataFrame(rows, "i int, x string").select("i", fn(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(d.collect(), key=lambda r: r["i"])]


def test_link_keys(spark):
    got = values(spark, T.link_key, ["https://www.Example.com/a/?utm_source=x&b=2&a=1#f", "http://example.com:80/a", "https://example.com:80/a/", "http://x:443443/", "ftp://x/", None, "http://u:p@h.org/?ref=1"])
    assert got == ["example.com/a?a=1&b=2", "example.com/a", "example.com:80/a", None, None, None, "h.org"]


def test_title_keys(spark):
    assert values(spark, T.title_key, ["Crêpes!", "crepes", "  ", "Pâté_en  croûte", "Weißbrot"]) == ["crepes", "crepes", None, "pate en croute", "weissbrot"]


@pytest.mark.parametrize("line,want", [
    ("2 cups flour", ("2", "cup", "flour")), ("1 ½ tsp salt", ("1 ½", "tsp", "salt")), ("1 (15 oz) can diced tomatoes", ("1", "can", "diced tomatoes (15 oz)")),
    ("- 3 c. à soupe d'huile", ("3", "tbsp", "huile")), ("1 tasse de farine", ("1", "cup", "farine")), ("1-2 cloves garlic", ("1-2", "clove", "garlic")),
    ("salt to taste", (None, None, "salt to taste")), ("1,5 kg porc", ("1,5", "kg", "porc")), ("2 eggs", ("2", None, "eggs")), ("1 boîte (540 ml) de pois chiches", ("1", "can", "pois chiches (540 ml)")),
])
def test_item_lines(spark, line, want):
    r = A.with_parsed(spark.createDataFrame([(line,)], "raw_line string"), "raw_line").first()
    assert (r["quantity"], r["unit"], r["name"]) == want


def test_durations(spark):
    assert values(spark, A.iso_duration, ["1 hr 20 min", "45", "1 h 30", "PT1H20M", "pt5m", "soon", "2 jours", "90 minutes"]) == [
        "PT1H20M", "PT45M", "PT1H30M", "PT1H20M", "PT5M", None, "PT48H", "PT1H30M"]
    assert values(spark, A.ddhhmm_minutes, ["00:01:30", "01:30", "00:99:00", "24:00", "61:00:00", "x"]) == [90, 90, None, None, None, None]


def test_scaled_lines(spark):
    lines = ["1 1/2 cups flour", "½ tsp salt", "250 g beurre", "1,000 g rice", "Salt to taste", "1-2 eggs", "1,5 l eau", "1 lb 8 oz beef", "Sauce:"]
    d = E.scaled(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), "line", 2.0)
    got = [(r["shown"], r["kept"]) for r in sorted(d.collect(), key=lambda r: r["i"])]
    assert got == [("3 cups flour", False), ("1 tsp salt", False), ("500 g beurre", False), ("1,000 g rice", True), ("Salt to taste", False), ("2-4 eggs", False),
                   ("3 l eau", False), ("1 lb 8 oz beef", True), ("Sauce:", False)]


def test_weights_and_volumes(spark):
    lines = ["1 cup flour", "2 tbsp brown sugar", "1 cup gravel", "2 eggs", "1 cup cooked rice", "1 cup water or broth"]
    d = E.to_grams(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), "line", E.densities(spark))
    got = {r["i"]: (r["ingredient"], None if r["grams_low"] is None else round(r["grams_low"], 2), r["kept"]) for r in d.collect()}
    assert got[0] == ("flour", 120.0, False) and got[1] == ("brown sugar", 26.62, False)
    assert got[2] == (None, None, True) and got[3] == (None, None, False) and got[4][2] is True and got[5][1] == 227.0
    v = E.to_volume(spark.createDataFrame([("240 g flour",), ("8 g flour",)], "line string"), "line", E.densities(spark)).collect()
    assert {(r["kitchen_amount"], r["kitchen_unit"]) for r in v} == {(2.0, "cup"), (1.0, "tbsp")}


def test_seasons(spark):
    lines = ["2 cups strawberries", "1 pomme de terre", "2 pommes", "1 sweet potato", "frozen blueberries", "3 carottes, tranchées", "1/2 chou-fleur", "2 cups (500 ml) leeks"]
    d = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["line"]: r["mask"] for r in E.season_masks(d, "line", E.produce_calendar(spark)).collect()}
    months = lambda *m: sum(1 << (x - 1) for x in m)
    assert got.get("2 cups strawberries") == months(6, 7, 8, 9, 10) and got.get("1 pomme de terre") == 0 and got.get("2 pommes") == months(9, 10)
    assert got.get("1 sweet potato") == months(11, 12) and "frozen blueberries" not in got and got.get("3 carottes, tranchées") == months(7, 8, 9, 10, 11)
    assert got.get("1/2 chou-fleur") == months(7, 8, 9) and got.get("2 cups (500 ml) leeks") == months(9)


def test_keyword_tags(spark):
    docs = [(1, "Beef stew chicken stock onions simmer"), (2, "Fried rice oyster sauce"), (3, "Tomato salad"), (4, "Moules a gateau beurre"), (5, "Bœuf poêlé"), (6, "lamb roast")]
    d = E.keyword_tags(spark.createDataFrame(docs, "doc_id long, text string"), E.tag_lexicon(spark))
    got = {}
    for r in d.collect():
        got.setdefault(r["doc_id"], set()).add(r["tag_name"])
    assert got[1] == {"Beef", "Stovetop"} and 2 not in got and got[3] == {"Vegetarian"} and got[4] == {"Vegetarian"} and got[5] == {"Beef"} and got[6] == {"Oven"}


def _osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORDS = ["chicken", "chiken", "chikcen", "tomato", "tomatoe", "otmato", "ca", "abc", "pepper", "peper", "berries", "berry", "quorkleberry", "quorklebery", "uqorkleberyr", ""]


def test_osa_distance(spark):
    pairs = list(itertools.product(WORDS, WORDS))
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r["d"] == _osa(r["a"], r["b"]) for r in d.collect())


def test_corrections_against_brute_force(spark):
    vocab = {"chicken": 9, "tomato": 5, "tomatillo": 1, "pepper": 7, "peppers": 2, "quorkleberries": 3, "berry": 4, "thicken": 1, "kitchen": 2}
    words = ["chiken", "tomatoe", "pepepr", "chikc", "cat", "zzzzzz", "quorkleberrise", "pepp"]

    def brute(w):
        k = 0 if len(w) < 4 else 1 if len(w) < 8 else 2
        if k == 0 or any(t.startswith(w) for t in vocab):
            return []
        best = {t: _osa(w, t) for t in vocab if abs(len(t) - len(w)) <= k and _osa(w, t) <= k}
        best |= {t: k + 1 for t in vocab if t[0] == w[0] and len(t) > len(w) and t not in best and _osa(w, t[:len(w)]) <= 1}
        return [t for _d, _n, t in sorted((d, -vocab[t], t) for t, d in best.items())[:3]]
    v = spark.createDataFrame(list(vocab.items()), "term string, docs long")
    got = {}
    for r in S.corrections(spark.createDataFrame([(w,) for w in words], "word string"), v).orderBy("rank").collect():
        got.setdefault(r["word"], []).append(r["term"])
    assert got == {w: brute(w) for w in words if brute(w)}


def test_hashed_columns(spark):
    d = spark.createDataFrame([(1, "w:salt", 2.0)], "doc_id long, name string, value double")
    got = {r["col"]: r["value"] for r in M.hashed(d, ["doc_id"]).collect()}
    assert got == {zlib.crc32(b"w:salt") % 2 ** 15: 2.0, zlib.crc32(b"__bias__") % 2 ** 15: 1.0}


def test_best_path_against_brute_force(spark):
    import math
    import random
    rng = random.Random(3)
    dist = lambda: [x / 10 for x in (lambda c: [c[0], c[1] - c[0], c[2] - c[1], 10 - c[2]])(sorted(rng.sample(range(1, 10), 3)))]
    start, prior, step = dist(), dist(), [dist() for _ in range(4)]
    probs = {("start", "-", l): start[i] for i, l in enumerate(M.LABELS)} | {("prior", "-", l): prior[i] for i, l in enumerate(M.LABELS)}
    probs |= {("step", a, b): step[i][j] for i, a in enumerate(M.LABELS) for j, b in enumerate(M.LABELS)}
    emissions = {doc: [dist() for _ in range(5)] for doc in range(4)}
    rows = [(doc, i, p) for doc, ps in emissions.items() for i, p in enumerate(ps)]
    got = {}
    for r in M.best_path(spark.createDataFrame(rows, "doc_id long, i long, p array<double>"), probs).orderBy("doc_id", "i").collect():
        got.setdefault(r["doc_id"], []).append(r["label"])

    def score(path, ps):
        e = lambda i, j: math.log(ps[i][j] + 1e-9) - math.log(prior[j])
        return math.log(start[path[0]]) + e(0, path[0]) + sum(math.log(step[a][b]) + e(i + 1, b) for i, (a, b) in enumerate(zip(path, path[1:])))
    for doc, ps in emissions.items():
        top = max(score(p, ps) for p in itertools.product(range(4), repeat=5))
        assert score([M.LABELS.index(l) for l in got[doc]], ps) == pytest.approx(top)


def test_similarity(spark):
    rows = [("a", "title", "Soup", "soup"), ("a", "prep_time", "35 min", "PT35M"), ("a", "cook_time", "35", "36 min"), ("b", "steps", "Mix.\nBake well.", "Mix.\nBake."), ("b", "title", "", "x")]
    got = {(r["case_id"], r["field"]): r["score"] for r in V.score_pairs(spark.createDataFrame(rows, "case_id string, field string, got string, want string")).collect()}
    assert got == {("a", "title"): 1.0, ("a", "prep_time"): 1.0, ("a", "cook_time"): 0.0, ("b", "title"): 0.0,
                   ("b", "steps"): round(difflib.SequenceMatcher(None, "mix.\nbake well.", "mix.\nbake.", autojunk=False).ratio(), 4)}


def test_language(spark):
    assert values(spark, T.guess_language, ["Mélanger la farine et le beurre", "Mix the flour and butter", "", "et the"]) == ["fr", "en", "en", "en"]


def test_line_predicates(spark):
    assert values(spark, G.PREDICATES["heading_steps"], ["Instructions", "Préparation :", "Step 1", "Method 2 steps"]) == [True, True, False, True]
    assert values(spark, G.numbered_step, ["1. Mix", "3 Eggs", "Step 2 Bake it", "2 Cook until the sauce is thick."]) == [True, False, True, True]
