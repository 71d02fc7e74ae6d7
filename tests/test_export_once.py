"""What an export and its way back name more than once is computed once."""
from pyspark.sql import functions as F

from quern.functions import amounts as A
from quern.sources import exchange as X, pages as PG


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_duration_is_read_once(spark):
    d = spark.createDataFrame([("1 hr 20 min",), ("45",), ("1 h 30",), ("0 h 0",), ("soon",), ("1,5 days",), ("0 min",), (None,)], "t string")
    one = d.select(A.iso_duration(F.col("t")).alias("iso"), "t")
    assert plan_of(one).count("regexp_extract_all") == 2
    assert [r["iso"] for r in one.collect()] == ["PT1H20M", "PT45M", "PT1H30M", None, None, "PT36H", None, None]


def test_an_exported_object_is_made_once(spark):
    r = spark.createDataFrame([(1, "Pie }", ["1 egg"], ["Mix.", "Top:", "Bake }"], "4", "1 h 30", None, None, "http://a.b/c", "so }", True, 3, ["x"])],
                              "id long, title string, ingredients array<string>, steps array<string>, servings string, prep_time string, cook_time string, total_time string, "
                              "source_url string, notes string, favorite boolean, tastiness_rating int, tags array<string>").withColumn("created_at", F.lit("2020-01-02").cast("timestamp"))
    out = X.to_schema_org(r)
    assert plan_of(out.select("id", "body")).count("https://schema.org") == 1
    back = X.from_schema_org(out, "id", "body", F.current_timestamp()).first()
    assert (back["title"], back["steps"], back["prep_time"], back["notes"], back["ingredients"]) == ("Pie }", ["Mix.", "Top:", "Bake }"], "1 h 30", "so }", ["1 egg"])


def test_steps_of_every_form(spark):
    texts = ['["a", {"text": "b"}, {"name": "c"}, {"@type": "HowToSection", "name": "S", "itemListElement": {"text": "d"}}, [["e"]], 5, null, {"text": ["f"]}]',
             '{"name": "T", "itemListElement": [{"@type": ["HowToSection"], "name": "U", "text": "g", "itemListElement": ["h"]}]}', '{"@type": "HowToSection", "name": "V"}', '"i<br>j\\nk"', "{}", "null"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, j string").select("id", F.try_parse_json("j").alias("v"))
    got = {r["id"]: r["steps"] for r in PG.flat_steps(d, "v")[0].collect()}
    assert got == {0: ["a", "b", "c", "S:", "d", "e", "5", '["f"]'], 1: ["T:", "U:", "h"], 2: [], 3: ["i j", "k"], 4: [], 5: []}
