"""Time the headline queries on one Spark session and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the number of local cores. Each
stage of the season chain is timed on top of the written tables before it, so the sum is
the time of the whole chain; the other queries start from the source tables.
"""

from __future__ import annotations

import json
import os
import time

from courtlens.catalog import queries as catalog
from courtlens.catalog.queries import QUERIES
from courtlens.plans import models
from courtlens.plans.season import SeasonTables
from courtlens.session import build_session, close
from courtlens.sources import shaped

CHAIN = [
    "player_master", "teams", "clean_pbp", "rally_table", "contest_master", "rally_pass",
    "first_ball_season", "team_strength", "player_season_features", "rally_win_probability",
    "win_probability_metrics", "team_phase_context", "player_event_credit", "server_toughness",
    "serve_receive_player_value", "player_rankings", "ranking_role_audit", "top25_rankings_by_role",
]
DIRECT = [
    "clean_names", "display_teams", "player_stats", "team_stats", "kills_cross_tab", "player_sheet",
    "top_teams_by_blocks", "kills_by_location", "rebuilt_contest_ids", "running_totals_hot_keys",
    "dense_ranks", "top_per_group", "player_opportunities", "replacement_values",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("courtlens-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.read.parquet(f"{folder}/events.parquet"))
    times: dict[str, float] = {}
    made = SeasonTables(
        shaped.roster(spark, folder), shaped.player_box(spark, folder),
        shaped.team_box(spark, folder), shaped.pbp(spark, folder), catalog._FITTED, "logistic",
    )
    for name in CHAIN:
        t = time.perf_counter()
        run(getattr(made, name))
        times[name] = round(time.perf_counter() - t, 3)
    for name in DIRECT:
        t = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[f"q_{name}"] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    run(models.win_probability(made.rally_table, "mlp", catalog._FITTED))
    times["rally_win_probability_mlp"] = round(time.perf_counter() - t, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    close(spark)
    spark.stop()


if __name__ == "__main__":
    main()
