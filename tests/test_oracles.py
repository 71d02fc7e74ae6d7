"""Every registered query against its SQL twin on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

PATH = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
# slow twins of operators that a quicker twin or a test of their own covers; check.py runs them, too
SLOW = {"agg2_facet_order", "agg12_transitions", "agg14_content_accuracy", "enr3_keyword_tags", "enr13_volume_to_mass", "enr14_mass_to_volume", "flt8_out_of_season", "ml8_training_examples",
        "ml9_adoption", "seg10_message_source", "set4_bulk_auto_tag", "src4_tier_fallback", "src12_export_round_trip", "udf1_pluggable_segmenter", "udf3_user_keywords"}
NAMES = [n for n in entry.queries() if n in SQL and not n.startswith("op") and n not in SLOW]


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    status, _n, _t, note = compare(spark, duck, PATH, name, entry.queries()[name], SQL[name])
    if status == "rows only":
        pytest.skip("no SQL twin")
    assert status == "ok", note


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "tastiness_rating", "actual_cook_time_minutes", "tags_text"]
