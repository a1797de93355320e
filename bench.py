"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Each query is run BENCH_RUNS times (default 3) after one warm-up; the median counts. All result columns are
computed and thrown away by the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pastward.plans.registry import all_queries
from pastward.session import local_session

HEADLINE = [
    "base_match_features", "home_form", "style_form", "mature_style_features", "head_to_head_prior", "latest_team_state",
    "player_period_features", "player_prior_features", "elo_ratings", "standings_before_match", "pressure_features",
    "scoreline_predictions", "evaluation_by_season", "calibration_candidates", "selected_draw_rule", "season_stage",
    "ranking_report", "identity_map", "conditional_uniqueness", "undominated_players", "master_match_features", "upserted_players",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench")
    registered = all_queries()
    times = {}
    for name in HEADLINE:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
