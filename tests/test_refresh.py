"""Published seasons brought up to date: what is built, what stands, what goes."""

import pytest

from courtlens import config
from courtlens.catalog.queries import fixed_curve
from courtlens.config import DEFAULT
from courtlens.plans.refresh import SeasonStore
from courtlens.sources import readers, sinks

NAMES = ["2022-2023", "2023-2024"]


def put(spark, folder, season, players, kinds=("players", "player_match", "team_match", "pbp")):
    frames = {
        "players": spark.createDataFrame([("1", "Alpha", "B10", str(i), p, "S") for i, p in enumerate(players)],
                                         "teamid string, team string, conference string, number string, player string, pos string"),
        "player_match": spark.createDataFrame([], "contestid string, date string, team string, opponent string, player string, location string, s string, kills string"),
        "team_match": spark.createDataFrame([("1", "9/1/2022", "Alpha", "Beta", "W 3-1", "Home", "30", "10", "80")],
                                            "contestid string, date string, team string, opponent string, result string, location string, kills string, errors string, total_attacks string"),
        "pbp": spark.createDataFrame([], ", ".join(f"`{c}` string" for c in config.PBP_COLUMNS if c != "season")),
    }
    for kind in kinds:
        sinks.save_csv(frames[kind], folder, config.SOURCE_FILES[kind].format(year=season[:4]))


@pytest.fixture()
def store(spark, tmp_path):
    for s in NAMES:
        put(spark, f"{tmp_path}/in", s, ["Ann", "Bea"])
    return SeasonStore(spark, f"{tmp_path}/in", f"{tmp_path}/out", DEFAULT, fixed_curve, ["player_master"])


def players(store):
    return sorted((r.season, r.player) for r in store.table("player_master").select("season", "player").collect())


def test_only_changed_seasons_are_built(spark, store, tmp_path):
    assert {r.season: r.status for r in store.state().collect()} == dict.fromkeys(NAMES, "absent")
    assert players(store) == [(s, p) for s in NAMES for p in ("Ann", "Bea")]       # built because it was not there
    assert store.refresh() == dict.fromkeys(NAMES, "fresh")
    put(spark, store.source, NAMES[0], ["Ann", "Cleo"], ["players"])
    put(spark, store.source, "2024-2025", ["Dee"])
    put(spark, store.source, "2025-2026", ["Eve"], ["players"])                    # three files of it are missing
    assert store.refresh() == {NAMES[0]: "stale", NAMES[1]: "fresh", "2024-2025": "absent"}
    assert players(store) == [(NAMES[0], "Ann"), (NAMES[0], "Cleo"), (NAMES[1], "Ann"), (NAMES[1], "Bea"), ("2024-2025", "Dee")]
    assert set(store.refresh().values()) == {"fresh"}
    # a season that has no rows left loses its old ones, and only that season
    put(spark, store.source, NAMES[0], [], ["players"])
    assert store.refresh()[NAMES[0]] == "stale"
    assert {s for s, _ in players(store)} == {NAMES[1], "2024-2025"}
    assert set(store.refresh().values()) == {"fresh"}


def test_other_settings_and_tables_make_seasons_stale(spark, store):
    store.refresh()
    other = SeasonStore(spark, store.source, store.target, DEFAULT.but(min_rallies=7), fixed_curve, ["player_master"])
    assert {r.status for r in other.state().collect()} == {"stale"}
    more = SeasonStore(spark, store.source, store.target, DEFAULT, fixed_curve, ["player_master", "team_strength"])
    assert set(more.refresh().values()) == {"stale"} and readers.saved(spark, store.target, "team_strength")
    assert {r.status for r in store.state().collect()} == {"fresh"}                # it asks for fewer tables


def test_nothing_to_combine_below_two_seasons(spark, tmp_path):
    for n, name in ((1, "one"), (2, "two")):
        out = f"{tmp_path}/{name}"
        rows = spark.createDataFrame([(s, "Alpha", 1.0) for s in NAMES[:n]], "season string, team_clean string, x double")
        sinks.save_seasons(rows, out, "team_phase_context", NAMES[:n])
        store = SeasonStore(spark, f"{tmp_path}/none", out, DEFAULT, fixed_curve, ["team_phase_context", "team_strength"])
        assert store.combine() == ({} if n == 1 else {"team_phase_context": 2})
        assert readers.saved(spark, out, "team_phase_context_all_seasons") == (n == 2)
