"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""
from __future__ import annotations

import json
import os
import time

from quern.plans import registry
from quern.session import local_session

HEADLINE = [
    "flagship", "flt6_all_of_tags", "flt8_in_season", "flt10_picker_predicate", "srt1_sort_rating", "srt3_top_k_per_group",
    "agg1_facet_counts", "agg3_library_check", "agg6_content_rollup", "joi3_duplicate_lookup", "joi5_duplicate_groups",
    "src9_bulk_import", "joi12_latest_state", "enr1_line_structure", "enr3_keyword_tags", "enr5_language_guess", "enr7_link_keys",
    "enr13_volume_to_mass", "agg9_vocabulary", "sch3_prefix_all_words", "sch6_commonest_with_prefix", "win2_precision_threshold",
    "win7_wrapped_lines", "win13_sliding_quota", "st4_debounced_bursts", "src23_page_text", "agg13_evaluation_report",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries, times = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()   # the JVM is up before the first clock
    for name in HEADLINE:
        t = time.perf_counter()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
