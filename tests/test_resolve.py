"""Fuzzy names by the inverted index against every pair looked at in turn."""

import random
import re
import time

from courtlens.operators import resolve


def brute(names, teams):
    """Pairs where the known name stands in the text between word boundaries (ASCII words)."""
    word = re.compile(r"[A-Za-z0-9_]")
    out = set()
    for n in names:
        for t in teams:
            at = n.find(t) if t else -1
            while at >= 0:
                end = at + len(t)
                if (at == 0 or not word.match(n[at - 1])) and (end == len(n) or not word.match(n[end])):
                    out.add((n, t))
                    break
                at = n.find(t, at + 1)
    return out


def hits(spark, names, teams):
    n = spark.createDataFrame([(x,) for x in names], "name string")
    t = spark.createDataFrame([(x,) for x in teams], "team_clean string")
    return {tuple(r) for r in resolve.inside_hits(n, t).collect()}


def test_inside_hits_match_all_pairs(spark):
    rng = random.Random(4)
    words = ["st", "st.", "state", "north", "miami", "(oh)", "a", "&", "-", "tech", "x_1", "'"]
    text = lambda n: rng.choice([" ", "  ", "."]).join(rng.choice(words) for _ in range(n))
    names = {text(rng.randrange(0, 9)) for _ in range(300)} | {"", "miamiohio", "state", " state", "a(oh)", "(oh)", "((", "st)(st"}
    teams = {text(rng.randrange(1, 4)) for _ in range(120)} | {"", "(oh)", "(", ")(", "state", "miami (oh)"}
    assert hits(spark, names, teams) == brute(names, teams)


def test_fuzzy_hits_of_nothing(spark):
    n, t = (spark.createDataFrame([], f"{c} string") for c in ("name", "team_clean"))
    assert resolve.fuzzy_hits(n, t).count() == 0
    assert resolve.fuzzy_hits(spark.createDataFrame([("a b",)], "name string"), t).count() == 0


def test_long_text_takes_time_in_proportion(spark):
    teams = [f"team {i} of {i % 7}" for i in range(400)]
    long = " ".join(f"w{i}" for i in range(10_000)) + " team 33 of 5 " + " ".join(f"v{i}" for i in range(10_000))
    hits(spark, ["warm up"], teams)
    begun = time.perf_counter()
    assert hits(spark, [long], teams) == {(long, "team 33 of 5")}
    assert time.perf_counter() - begun < 10   # seconds for the whole job; pairs of word boundaries would be 2 * 10^8
