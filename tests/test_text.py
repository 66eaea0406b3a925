import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import resolve
from courtlens.sources import seasons as S


def one(spark, expr, value, t="string"):
    return spark.createDataFrame([(value,)], f"x {t}").select(expr(F.col("x"))).first()[0]


def plain_clean(s):
    s = unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()
    s = re.sub("['`]", "", s.replace("&", " and "))
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s/@().,#:-]", " ", s)).strip()


def test_clean_name_matches_unicode_definition(spark):
    texts = ["Zoë  Müller", "O'Brien & Sons", None, "", "ﬁne ½ №5 ㎏", "𝐀𝐁c", " x ", "a\tb\n", "İstanbul",
             "tab\x1fsep", "p1-2", "Straße", "x" * 50_000 + " É"]
    chars = [chr(c) for c in range(1, 0x110000) if unicodedata.decomposition(chr(c))]
    texts += ["".join(chars[i:i + 60]) for i in range(0, len(chars), 60)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", T.clean_name(F.col("s")).alias("c")).collect()
    assert all(plain_clean(r.s) == r.c for r in rows)


def test_team_text(spark):
    assert one(spark, T.clean_team, "vs. Penn") == ". penn"
    strip = lambda v: one(spark, T.strip_opponent_noise, v)
    assert strip("@ #12 Ohio State, Columbus") == "ohio state"
    assert strip("at Iowa Fall Classic 2024") == "iowa fall"
    show = lambda v: one(spark, T.display_team, v)
    assert show("#3 Miami (FL)") == "Miami"
    assert show("Team 10") == "Team 10"
    assert show("Utah @ Boise St.") == "Utah"
    assert show("UT-Dallas 09-12 5 PM") == "UT Dallas"
    assert show("@") is None


@pytest.mark.parametrize("event,description,family", [
    ("first ball kill", "", "kill"), ("ace", "", "ace"), ("", "service ace by x", "ace"),
    ("service error", "", "service_error"), ("", "ball handling error by x", "set_error"),
    ("serve", "", "serve"), ("", "x serves", "serve"), ("", "x serves an ace", "admin"),
    ("", "reception by x", "reception"), ("kill", "attack by x", "attack"), ("kill", "", "kill"),
    ("block error", "", "block_error"), ("timeout", "", "admin"), (None, None, "admin"),
])
def test_event_family(spark, event, description, family):
    df = spark.createDataFrame([(event, description)], "e string, d string")
    assert df.select(T.event_family(F.col("e"), F.col("d"))).first()[0] == family


def test_headers(spark):
    df = spark.createDataFrame([(None, "b", 1)], "`Team` string, ` team ` string, `Hit Pct!` int")
    out = T.standardize_columns(df)
    assert out.columns == ["team", "hit_pct"] and out.first() == ("b", 1)
    assert T.header_name("TotalAttacks") == "total_attacks"


def test_composite_id_is_null_with_any_null(spark):
    df = spark.createDataFrame([("a", None)], "a string, b string")
    assert df.select(T.composite_id(F.col("a"), F.col("b"))).first()[0] is None


def test_numbers(spark):
    assert one(spark, lambda c: N.number(c), " 12.5 ") == 12.5
    assert one(spark, lambda c: N.number(c), "n/a") is None
    assert one(spark, lambda c: N.number(c), "NaN") is None
    assert one(spark, N.loose_bool, "YES") is True
    assert one(spark, N.loose_bool, None) is False
    xs = [i / 40 for i in range(-320, 321)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", N.erf(F.col("x")).alias("e")).collect()
    assert max(abs(r.e - math.erf(r.x)) for r in got) < 2e-15


def test_resolver_order_and_ambiguity(spark):
    teams = spark.createDataFrame(
        [("miami (fl)",), ("miami (oh)",), ("ohio st.",), ("utrgv",), ("penn st.",), ("st. johns (ny)",), ("iowa",)],
        "team_clean string")
    raw = ["UT Rio Grande Valley", "Miami Ohio", "Miami", "ohio-st", "Saint X", "penn st. behrend", "St. Johns",
           "Northern Iowa", "iowans", None, ""]
    got = {r.raw: r.canonical for r in resolve.name_map(
        spark.createDataFrame([(x,) for x in raw], "raw string"), teams).collect()}
    assert got["UT Rio Grande Valley"] == "utrgv"          # alias
    assert got["Miami Ohio"] == "miami (oh)"               # alias before fuzzy
    assert got["Miami"] == "miami"                         # two candidates: kept as it is
    assert got["ohio-st"] == "ohio st."                    # same letters
    assert got["penn st. behrend"] == "penn st."           # known name inside
    assert got["St. Johns"] == "st. johns (ny)"            # known name continues the text
    assert got["Northern Iowa"] == "iowa" and got["iowans"] == "iowans"
    assert got["Saint X"] == "saint x"


def brute_hits(names, teams):
    hits = set()
    for val in names:
        for team in teams:
            squash = lambda s: re.sub("[^a-z0-9]", "", s)
            inside = re.search(rf"(?<!\w){re.escape(team)}(?!\w)", val)
            if squash(val) == squash(team) or team.startswith((val + " ", val + "(")) or inside:
                hits.add((val, team))
    return hits


def test_fuzzy_joins_equal_the_pairwise_definition(spark):
    import random
    rng = random.Random(3)
    parts = ["st.", "state", "ohio", "(oh)", "a&m", "new-york", "tech", "u", "miami", "#4"]
    make = lambda: " ".join(rng.choices(parts, k=rng.randint(1, 4)))
    names, teams = {make() for _ in range(150)}, {make() for _ in range(80)} | {"(oh) u", "st. (oh)"}
    got = resolve.fuzzy_hits(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame([(t,) for t in teams], "team_clean string"))
    assert {(r.name, r.team_clean) for r in got.collect()} == brute_hits(names, teams)


def test_seasons(spark):
    assert S.wanted(["2023-2024,2022-2023"]) == ["2023-2024", "2022-2023"]
    assert S.wanted(span=("2022-2023", "2024-2025")) == ["2022-2023", "2023-2024", "2024-2025"]
    assert S.wanted() == ["2025-2026"]
    assert S.wanted(found=["2025-2026", "2022-2023"]) == ["2022-2023", "2025-2026"]
    for bad in ("2023", "2023-2025", "x"):
        with pytest.raises(ValueError):
            S.Season.parse(bad)
    with pytest.raises(ValueError):
        S.between("2025-2026", "2024-2025")
    df = spark.createDataFrame([("2023-2024",), ("2023-2025",), (None,), ("abc",)], "season string")
    assert S.checked(df.filter("season = '2023-2024'")).count() == 1
    with pytest.raises(Exception, match="no season"):
        S.checked(df).collect()
