"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores; BENCH_ONLY, a comma list of name prefixes, narrows it.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "a3_flag_calibration", "a6_check_calibration", "a8_tier_regret", "a12_trial_arms", "j1_repair_join", "j2_file_repair_join",
    "a14_usage_totals", "a15_exact_quantiles", "w1_follow_up", "w2_fail_streaks", "s1_read_events", "s7_read_sessions", "w3_prompt_outcomes",
    "p6_risk_flags", "j3_resolve_imports", "g2_build_edges", "r1_impact_ranking", "r4_catalog_search",
    "j9_prediction_verdicts", "a28_change_risk", "a32_change_checks", "j14_owner_approval", "a16_retrieval_board", "a18_history_board",
    "w6_verify_ledger", "a39_receipts", "p20_data_access",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]

    from tallywake.plans import registry
    from tallywake.session import local_session

    spark = local_session(cpus, shuffle_partitions=cpus, app="bench")
    queries = registry.queries()
    # One small read starts the workers, so the first query is not charged for it.
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in HEADLINES:
        if only and not any(name.startswith(p) for p in only):
            continue
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
