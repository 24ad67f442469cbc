"""Times the headline queries and prints one JSON line.

Every query runs once untimed and then BENCH_RUNS times (default 1), of which the median counts. Environment: BENCH_SF_DIR
(default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names separated by commas, 'all' for every registered
query).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sigloft.catalog import QUERIES, load_all  # noqa: E402
from sigloft.session import local_session  # noqa: E402

HEADLINE = [
    "mispricing_score", "keyword_velocity", "entity_velocity", "keyword_title_route", "odds_deltas", "latest_per_key",
    "sentiment_15m", "asof_backward_24h", "asof_offsets", "event_study_stats", "first_touch_exit", "signal_backtest",
    "kelly_sizing", "theme_caps", "position_ledger", "exit_decisions", "fill_resolution", "candidate_selection",
    "change_eligibility", "code_lookup_enrich", "decayed_retrieval", "lexicon_sentiment", "max_drawdown", "merge_upsert",
    "stream_tumbling",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    load_all()
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/nation.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
