"""Long, wide and odd input goes through whole."""
import json

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.amounts import with_parsed
from quern.operators import learn, lexicon, search, selection
from quern.sources import pages


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first()["r"]


def test_long_names_match(spark):
    name = " ".join(f"word{k}" for k in range(14))
    lex = spark.createDataFrame([("t", "c", 0, name)], "tag_name string, category string, ord int, keyword string")
    docs = spark.createDataFrame([(1, f"before {name} after")], "doc_id long, text string")
    assert lexicon.keyword_hits(docs, "doc_id", "text", lex).count() == 1


def test_long_line_keeps_its_name(spark):
    line = spark.createDataFrame([("2 cups " + "x" * 3000,)], "raw string")
    assert "x" * 3000 in [v for v in with_parsed(line, "raw").first().asDict().values() if isinstance(v, str) and not v.startswith("2 cups")]


def test_every_wanted_tag_counts(spark):
    names = [f"t{k}" for k in range(51)]
    records = spark.createDataFrame([(1,), (2,)], "id long")
    bridge = spark.createDataFrame([(1, n) for n in names[:50]] + [(2, n) for n in names], "recipe_id long, tag_name string")
    assert [r["id"] for r in selection.with_all_tags(records, bridge, names).collect()] == [2]


def test_entities(spark):
    text = "&eacute;&#233;&#x27;&frac12; &amp;lt; &amp;amp; &#38;lt; &unknown; &#1114112; &nbsp;&copy;"
    assert one(spark, text, T.unescape) == "éé'½ &lt; &amp; &lt; &unknown; &#1114112;  ©"
    assert one(spark, None, T.unescape) is None


def test_hidden_links(spark):
    html = "<a href='https://a.org/x'>one</a> <a href=https://b.org/y>two</a> <a href=\"https://c.org\">https://c.org</a>"
    assert one(spark, html, T.html_to_text) == "one https://a.org/x two https://b.org/y https://c.org"


def test_long_markdown_line_and_links(spark):
    assert one(spark, "**" + "b" * 3000 + "**", T.markdown_to_text) == "b" * 3000
    url = "https://example.org/" + "p" * 2500
    assert one(spark, f"see {url}", T.links_in) == [url]
    assert one(spark, f"{url}?token=1", T.redact_links) == f"{url}?…"


def test_all_words_of_a_query(spark):
    q = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "qid long, q string")
    assert search.parse(q).count() == 20 and search.parse(q, most_words=12).count() == 12


def test_generations(spark, tmp_path):
    root, model = f"file://{tmp_path}/models", StringIndexer(inputCol="a", outputCol="b")
    assert learn.current_model(root, spark) is None
    first = learn.publish(model, root, spark, {})
    assert learn.current_model(root, spark) == first
    second = learn.publish(model, root, spark, {"n": 2})
    assert learn.current_model(root, spark) == second != first


def test_sections_inside_sections(spark):
    section = lambda name, *parts: {"@type": "HowToSection", "name": name, "itemListElement": list(parts)}

    def nested(n):
        out = "deep"
        for k in reversed(range(n)):
            out = section(f"s{k}", out)
        return out
    cases = [section("Dough:", section("Inner", "mix", {"text": "rest"}), "bake"), [[["q"]]], [section("E"), section("F", section("G")), "end"],
             section("a", section("b", section("c", section("d", "deep")))), 7, None, nested(5), nested(9), nested(30),
             {"@type": "HowToSection", "name": "one", "itemListElement": {"@type": "HowToStep", "text": "alone"}}, "a\n<b>b</b>\n\n"]
    rows = spark.createDataFrame([(n, json.dumps(c)) for n, c in enumerate(cases)], "n int, j string").select("n", F.try_parse_json("j").alias("v"))
    made, problems = pages.flat_steps(rows, "v")
    found = {r["n"]: r["steps"] for r in made.collect()}
    deep = lambda n: [*(f"s{k}:" for k in range(n)), "deep"]
    assert found == {0: ["Dough:", "Inner:", "mix", "rest", "bake"], 1: ["q"], 2: ["end"], 3: ["a:", "b:", "c:", "d:", "deep"], 4: ["7"], 5: [],
                     6: deep(5), 7: deep(9), 8: deep(30), 9: ["one:", "alone"], 10: ["a", "b"]}
    assert problems.count() == 0
    made, problems = pages.flat_steps(rows, "v", most_depth=5)
    assert [r["n"] for r in problems.collect()] == [7, 8] and made.count() == len(cases)


def test_recipes_inside_lists_and_graphs(spark):
    recipe = {"@type": ["Thing", "Recipe"], "name": "x"}
    deep = recipe
    for _ in range(40):
        deep = [{"@graph": [deep]}]
    cases = [recipe, [recipe, recipe], {"@graph": recipe}, {"mainEntity": [recipe]}, deep, {"a": 1}, [], "text"]
    rows = spark.createDataFrame([*((n, json.dumps(c)) for n, c in enumerate(cases)), (90, "{broken"), (91, None)], "k int, j string")
    found, problems = pages.recipe_objects(rows, "k", "j")
    assert sorted(r["k"] for r in found.collect()) == [0, 1, 1, 2, 3, 4]
    assert [(r["k"], r["problem"]) for r in problems.collect()] == [(90, "not readable as JSON")]
    found, problems = pages.recipe_objects(rows, "k", "j", most_depth=20)
    assert {r["k"] for r in problems.collect()} == {4, 90} and found.count() == 5
