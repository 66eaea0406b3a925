"""A small hand-made set, and one test per odd rule of the log."""

import pytest
from pyspark.sql import functions as F

from courtlens.plans import firstball, playbyplay, rallies, roster, serving

ROSTER = [  # team, player, number, pos
    ("Alpha", "Ann One", 1, "S"), ("Alpha", "Amy Two", 2, "MB"), ("Alpha", "Ada Three", 3, "L/DS"),
    ("Beta", "Bea One", 1, "OH"), ("Beta", "Bo Two", 2, "DS"), ("Beta", "Bo Two", 22, "RS"),
]
LOG = [  # score away-home, team, event, player: Beta away at Alpha
    ("0-0", "Alpha", "Serve", "Ann One"), ("0-0", "Beta", "Reception", "Bea One"),
    ("0-0", "Beta", "Set", "Bea One"), ("1-0", "Beta", "Kill", "Bea One"),
    ("1-0", "Beta", "Serve", "Bea One"), ("1-0", "Alpha", "Reception", "Ada Three"),
    ("", "Alpha", "Attack", "Amy Two"), ("1-1", "Alpha", "First ball kill", "Amy Two"),
    ("1-1", "Alpha", "Serve", "Ann One"), ("2-1", "Beta", "Service error", "Ann One"),
    ("2-1", "Umpire", "Timeout", ""), ("2-1", "Beta", "Serve", "Bea One"),
    ("2-2", "Alpha", "Reception error", "Bea One"),
    ("4-2", "Beta", "Ace", "Bea One"),
]


def log(spark, touches=LOG, contest="7", set_no="1"):
    rows = [("2024-2025", i, "08/30/2024", contest, set_no, "Beta", "Alpha", s, "", "", t, e, p, "")
            for i, (s, t, e, p) in enumerate(touches)]
    cols = "season string, file_row bigint, date string, contestid string, set_no string, away_team string, home_team string, score string, rally string, rally_event string, team string, event string, player string, description string"
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="module")
def master(spark):
    rows = [("2024-2025", t, "Conf", n, p, pos) for t, p, n, pos in ROSTER]
    return roster.player_master(spark.createDataFrame(
        rows, "season string, team string, conference string, number int, player string, pos string"))


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([("alpha",), ("beta",)], "team_clean string")


@pytest.fixture(scope="module")
def clean(spark, master, teams):
    return playbyplay.clean_pbp(log(spark), master, teams).cache()


def test_rally_boundaries_and_scores(clean):
    r = {x.rally_id: x for x in rallies.rally_table(clean).collect()}
    assert [r[i].rally_rows for i in sorted(r)] == [4, 4, 2, 3, 1]
    assert (r[1].point_winner_side, r[2].point_winner_team, r[3].point_winner_side) == ("away", "alpha", "away")
    assert r[2].any_non_numeric_score and not r[1].any_non_numeric_score
    # the row that scores ends its rally; a one-row rally moves no point
    assert r[5].point_delta_total == 0 and r[5].point_winner_side == "unknown" and r[5].any_multi_point_jump
    assert r[4].server_player_clean == "bea one" and r[4].serve_row == 11       # skips the timeout
    assert r[4].unresolved_actor_rows == 1
    assert r[1].terminal_event_family == "kill"


def test_actor_comes_from_the_roster_first(clean):
    by = {x.file_row: x for x in clean.collect()}
    assert by[9].team_clean == "beta" and by[9].actor_team == "alpha"           # error row names the winner
    assert by[9].actor_team_source == "roster_home"
    assert by[10].actor_team is None and by[10].actor_team_source == "unresolved"


def test_set_and_contest_state(clean):
    last = rallies.rally_table(clean).orderBy(F.col("rally_id").desc()).first()
    assert last.is_set_terminal and last.away_sets_after == 1 and last.home_match_win == 0
    assert (last.set_after, last.score_home_after_state, last.score_away_after_state) == (2, 0, 0)
    c = rallies.contest_master(rallies.rally_table(clean)).first()
    assert (c.sets, c.rallies, c.away_sets_total) == (1, 5, 1)


def test_first_row_of_a_set_has_no_delta(spark, master, teams):
    d = playbyplay.clean_pbp(log(spark, [("0-1", "Alpha", "Serve", "Ann One"), ("0-1", "Beta", "Dig", "Bea One")]), master, teams)
    assert {(x.d_home, x.rally_id) for x in d.collect()} == {(0, 1)}


def test_tied_sets_are_no_home_win(spark, master, teams):
    d = playbyplay.clean_pbp(log(spark, [("0-0", "Alpha", "Serve", "Ann One")]), master, teams)
    assert rallies.rally_table(d).first().home_match_win == 0


def test_identical_touches_collapse_unless_asked(spark, master, teams):
    twice = [LOG[0], LOG[1], LOG[1]]
    assert playbyplay.clean_pbp(log(spark, twice), master, teams).count() == 2
    assert playbyplay.clean_pbp(log(spark, twice), master, teams, dedup=False).count() == 3


def test_duplicate_roster_names_fan_out_the_role_join(spark, master, teams):
    d = playbyplay.clean_pbp(log(spark, [("0-0", "Beta", "Dig", "Bo Two")]), master, teams)
    assert sorted(x.role_family for x in d.collect()) == ["libero_ds", "opposite"]
    fb = spark.createDataFrame([("2024-2025", "beta", "bo two", 7, 2, 2, 0, 1, 1, 0, 1)],
        "season string, team_clean string, player_clean string, contestid int, fb_receptions int, fb_clean_receptions int, fb_reception_errors int, fb_attacks int, fb_kills int, fb_middle_attacks int, fb_receive_point_wins int")
    assert firstball.per_player_season(fb).first().fb_receptions == 2          # summed before the lookup
    assert firstball.with_display(firstball.per_player_season(fb), master).count() == 2


def test_chunked_log_equals_plain(spark, master, teams, clean):
    d = playbyplay.clean_pbp(log(spark), master, teams, chunk=3)
    assert sorted(map(tuple, d.collect()), key=repr) == sorted(map(tuple, clean.collect()), key=repr)


def test_first_ball(clean):
    table = rallies.rally_table(clean)
    p = {x.rally_id: x for x in firstball.rally_pass(rallies.event_table(clean), table).collect()}
    assert p[1].first_ball_attack and p[1].first_ball_kill and not p[1].first_ball_middle_attack
    assert p[2].first_ball_middle_attack and p[2].receive_point_win and p[2].passer_player_clean == "ada three"
    assert p[3].receiving_team is None and not p[3].first_ball_attack
    assert p[4].reception_error and not p[4].first_ball_attack
    hot = firstball.rally_pass(rallies.event_table(clean), table, hot=True)
    assert sorted(map(tuple, hot.collect()), key=repr) == sorted(map(tuple, p.values()), key=repr)


def test_server_profile(clean):
    s = {x.player_clean: x for x in serving.server_toughness(rallies.rally_table(clean)).collect()}
    assert s["ann one"].serve_rallies == 2 and s["ann one"].serve_errors == 1 and s["ann one"].serve_points_won == 0
    assert s["bea one"].serve_rallies == 2 and s["bea one"].forced_reception_errors == 1


def test_missing_number_gives_null_uid(spark):
    m = roster.player_master(spark.createDataFrame(
        [("2024-2025", "A", "P", None)], "season string, team string, player string, number string")).first()
    assert m.player_uid is None and m.number_clean is None and m.role_family == "unknown"


def test_unparsed_result_is_a_played_loss(spark):
    tm = spark.createDataFrame([("2024-2025", "a", "W 3-1"), ("2024-2025", "a", "Ppd"), ("2024-2025", "b", "L 1-3")],
                               "season string, team_clean string, result string")
    out = {r.team_clean: r for r in roster.team_strength(tm).collect()}
    assert out["a"].matches == 2 and out["a"].win_pct == 0.5 and out["a"].sets_for == 3


def test_blocks_stay_null_when_a_part_is(spark):
    from courtlens.plans import marts
    row = [("p", "A", "B", "Away", 0.1, None, 2, 1, 1, 1, 1, 1, 1)]
    d = spark.createDataFrame(row, "player string, team string, opponent string, location string, hit_pct double, block_solos int, block_assists int, kills int, assists int, aces int, digs int, errors int, total_attacks int")
    out = marts.cleaned_player_box(d).first()
    assert out.blocks is None and out.block_solos == 0 and out.is_away == 1
