"""Season files with their own headers, quoted line breaks, and models that keep every rally."""

import pytest
from pyspark.sql import functions as F

from courtlens.catalog.queries import fixed_curve
from courtlens.config import DEFAULT
from courtlens.operators import ordered
from courtlens.plans import models
from courtlens.sources import readers


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_every_file_has_its_own_header(spark, tmp_path):
    write(tmp_path, "wvb_playerseason_div1_2023.csv", "Team,Player,Pos,Number\nA,Ann,S,1\nA,TEAM,,\n")
    write(tmp_path, "wvb_playerseason_div1_2024.csv", "number,extra,player,team\n7,x,Bea,B\n")
    for kind in ("playermatch", "teammatch"):
        write(tmp_path, f"wvb_{kind}_div1_2023.csv", "team,kills\nA,1\nA,1\n")
        write(tmp_path, f"wvb_{kind}_div1_2024.csv", "kills,team,season\n2,B,2024-2025\n")
    got = readers.read_box_tables(spark, str(tmp_path), ["2023-2024", "2024-2025"])
    rows = sorted((r.season, r.team, r.player, r.number, r.pos, r.extra) for r in got["players"].collect())
    assert rows == [("2023-2024", "A", "Ann", "1", "S", None), ("2024-2025", "B", "Bea", "7", None, "x")]
    assert sorted((r.season, r.team, r.kills) for r in got["player_match"].collect()) == [("2023-2024", "A", "1"), ("2024-2025", "B", "2")]
    assert got["team_match"].count() == 3


def test_a_bad_season_fails_loudly(spark, tmp_path):
    for kind in ("playerseason", "playermatch", "teammatch"):
        write(tmp_path, f"wvb_{kind}_div1_2023.csv", "team,player,season\nA,Ann,2023\n")
    with pytest.raises(Exception, match="no season"):
        readers.read_box_tables(spark, str(tmp_path), ["2023-2024"])["players"].collect()


def test_quoted_line_breaks_and_order(spark, tmp_path):
    write(tmp_path, "wvb_pbp_div1_2023.csv", 'date,contestid,set,event,description\n01/02/2023,1,1,Serve,"one\ntwo, ""x"""\n01/02/2023,1,1,Kill,b\n')
    write(tmp_path, "wvb_pbp_div1_2024.csv", "event,set,contestid,date,description,more\nDig,2,5,01/02/2024,c,z\n")
    got = readers.read_pbp(spark, str(tmp_path), ["2023-2024", "2024-2025"]).orderBy("file_row").collect()
    assert [(r.season, r.event, r.set_no, r.contestid, r.description) for r in got] == [
        ("2023-2024", "Serve", "1", "1", 'one\ntwo, "x"'), ("2023-2024", "Kill", "1", "1", "b"), ("2024-2025", "Dig", "2", "5", "c")]


def test_seasons_with_one_header_share_a_scan(spark, tmp_path):
    folder, every = tmp_path / "a b", [f"{y}-{y + 1}" for y in range(2010, 2022)]
    folder.mkdir()
    for s in every:
        more, extra = ("", "") if s < "2019" else (",more", ",m")
        write(folder, f"wvb_pbp_div1_{s[:4]}.csv", f"contestid,set,event{more}\n" + "".join(f"{s[:4]},{n},e{n}{extra}\n" for n in range(4)))
        for kind in ("playerseason", "playermatch", "teammatch"):
            write(folder, f"wvb_{kind}_div1_{s[:4]}.csv", f"team,player{more}\nT{s},P{extra}\n")
    log = readers.read_pbp(spark, str(folder), every)
    rows = log.orderBy("file_row").collect()
    assert [(r.season, r.contestid, r.set_no, r.event) for r in rows] == [(s, s[:4], str(n), f"e{n}") for s in every for n in range(4)]
    one = readers.read_pbp(spark, str(folder), every[3:4]).collect()
    assert sorted(r.file_row for r in one) == sorted(r.file_row for r in rows if r.season == every[3])
    box = readers.read_box_tables(spark, str(folder), every)["team_match"]
    assert sorted((r.season, r.team, r.more) for r in box.collect()) == [(s, f"T{s}", "m" if s >= "2019" else None) for s in every]
    assert box._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


STATE = {"set_no": 1, "home_sets_before": 0, "away_sets_before": 0, "score_home_start": 3, "score_away_start": 2,
         "server_side": "home", "set_after": 1, "home_sets_after": 0, "away_sets_after": 0, "score_home_after_state": 4,
         "score_away_after_state": 2, "server_side_after": "home"}


def test_unfitted_seasons_keep_their_rallies(spark):
    kind = "season string, rally_id int, " + ", ".join(f"{c} {'string' if 'side' in c else 'int'}" for c in STATE)
    rallies = spark.createDataFrame(
        [("2023-2024", i, *{**STATE, "score_home_start": i % 25}.values()) for i in range(40)]
        + [("2024-2025", i, *STATE.values()) for i in range(5)], kind)
    train = rallies.filter("season = '2023-2024'").select(
        "season", (F.col("rally_id") % 2).cast("double").alias("label"), *[c.alias(n) for n, c in models.wp_state("before").items()])
    fitted = models.fit_mlp(train, DEFAULT.but(mlp_max_iter=5))
    got = models.score_mlp(rallies, fitted)
    assert got.count() == 45 and got.filter("home_wp_before is null").count() == 5
    assert got.filter("home_wp_after is not null").count() == 40
    none = models.score_mlp(rallies, {})
    assert none.count() == 45 and none.filter("home_wp_before is null and home_wp_after is null").count() == 45
    assert fixed_curve(rallies).count() == 45


def test_split_reads_several_date_forms(spark):
    days = [(i, f"{1 + i % 12}/{1 + i}/2023", f"2023-{1 + i % 12:02d}-{1 + i:02d}") for i in range(20)]
    split = lambda rows: {(r.contestid, r.split) for r in ordered.chronological_split(
        spark.createDataFrame([("s", c, d, 1) for c, d in rows], "season string, contestid int, date string, n int"),
        "contestid", "date", ["n"], ["season"], 0.7, 0.85).collect()}
    by_date = split([(i, a) for i, a, _ in days])
    assert by_date == split([(i, b) for i, _, b in days])
    by_id = split([(i, "no date") for i, _, _ in days])
    assert by_id != by_date and {c for c, s in by_id if s == "train"} == set(range(14))
    assert {c for c, s in by_date if s == "train"} == {i for i, _, _ in sorted(days, key=lambda x: x[2])[:14]}
