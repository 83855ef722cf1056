"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quantgap.plans.queries import QUERIES
from quantgap.session import get_session

HEADLINE = [
    "w2_by_origin",
    "cell_summary",
    "w2_weighted",
    "w2_prices",
    "w2_guarded",
    "w2_curve",
    "tail_w2",
    "ecdf",
    "quantile_map",
    "counterfactual_w2",
    "rendement_share",
    "translation_dispersion",
    "origin_reweight",
    "bootstrap_w2",
    "bootstrap_ci",
    "nonresponse_balance",
    "bracket_mid_percentile",
    "conditional_stats",
    "prepared_sample",
    "harmonised_waves",
    "wls_cells",
    "pmm_pooled",
    "path_effects",
    "wald_equal",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session("quantgap-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["group_count"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}
        )
    )


if __name__ == "__main__":
    main()
