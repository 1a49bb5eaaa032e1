"""Time the headline queries and print one JSON line.

Each query runs in full (the result goes to a no-op sink) on local[$BENCH_CPUS] over $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import time

from homespell.plans.catalog import QUERIES
from homespell.session import build_session

HEADLINE = (
    "a5_stream_sanitize", "a6_union_markets", "b18_repeat_sale_features", "c2_analysis_universe",
    "d3_link_episodes", "d5_later_window_purge", "e4_quarterly_median", "e7_episode_summary",
    "e9_weighted_valuation_metrics", "e10_weighted_median", "e12_roc_auc", "e18_policy_scorecard",
    "e19_downside_cvar", "e23_compress_distribution", "e25_conformal_radius", "f1_prior_sale",
    "f3_dedupe_keep_last", "f6_km_curve", "f7_survival_curve", "f11_even_sample", "i1_person_period",
    "k1_evaluate_policy", "k3_offer_grid", "l2_stream_source_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
