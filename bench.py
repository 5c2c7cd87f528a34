"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans import all_queries  # noqa: E402
from panelspark.session import local_session  # noqa: E402

HEADLINE = (
    "feature_store", "panel_rolling", "dedupe_last", "diverse_pool", "agreement", "flags",
    "ranking_metrics", "calibration", "concordance", "cohorts", "tail_comparison",
    "h2h_record", "h2h_dist", "weaknesses", "entity_pair_corr", "shared_fixture_corr",
    "residual_structure", "quantile_vectors", "quantile_moments", "percentile_in_forecast",
    "best_xi", "settlement", "league_table", "ownership_latest",
    "explorer", "best_swap", "gbt_forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))


if __name__ == "__main__":
    main()
