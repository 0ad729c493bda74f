"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from assize.plans import catalogue
from assize.session import local_session

HEADLINE = (
    "rarity_alerts", "loo_rate_by_member", "loo_distribution", "chi2_vs_group", "affinity_pairs", "monthly_rolling_rate", "cusum_breakpoints", "streak_effect_3_5",
    "velocity_percentiles", "peer_percentile_flags", "rate_after_change", "proximity_buckets", "shared_neighbour_pairs", "connected_components_of_pairs",
    "entity_match_deterministic", "entity_match_cascade", "donor_rollup", "flow_cube", "flow_history_running", "compound_signals", "evidence_bundles", "column_profile", "events_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # starts the session; not timed
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
