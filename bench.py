"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from tickerloom import session  # noqa: E402
from tickerloom.catalog import load  # noqa: E402

HEADLINE = (
    "w_market_score", "t_bars_asof", "j_asof_latest", "j_nth_after", "j_evidence_stats", "j_cooldown_anti", "j_fuzzy_keyword",
    "a_contributions", "a_total_score", "a_profit_summary", "a_penalty_smooth", "d_yield_records", "d_strategy_grid",
    "k_capped_topk", "f_exact_dedup", "f_cosine", "f_news_quality", "d_bootstrap_ci", "sink_merge_cache", "st_bucket_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session.local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries, _ = load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
