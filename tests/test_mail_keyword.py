"""Messages without the keyword are not taken apart."""
from quern.sources import mail


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_messages_with_the_keyword_are_taken_apart(spark):
    raw = spark.createDataFrame([(1, "Subject: =?utf-8?q?Recette_=C3=A9t=C3=A9?=\n\nbody"), (2, "Subject: other\n\nbody"), (3, None), (4, " ")], "id long, raw string")
    found = mail.messages(raw, "raw", "ÉTÉ")
    assert plan_of(found).count("EvalPython") == 2
    assert [(r["id"], r["subject"], r["plain"]) for r in found.collect()] == [(1, "Recette été", "body")]
