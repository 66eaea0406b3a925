"""Host rules, line runs and SimHash against brute force, with their edge cases."""

import collections
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from courtlens.llm import op3_host_rules as rules
from courtlens.llm import op9_simhash as sim
from courtlens.llm import op10_line_dedup as lines
from courtlens.llm.common import components

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], KIND)


def brute_measures(t):
    w = WORD.findall(t or "")
    win = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {p for i, x in enumerate(zip(w, w[1:], w[2:])) if win[x] > 1 for p in (i, i + 1, i + 2)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(hit), failed)


def test_measures_match_brute_force(spark):
    rng = random.Random(3)
    pick = lambda n, k: " ".join(rng.choice("abcdefghij"[:k]) for _ in range(n))
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a", "a a a a", "é ñ ß", "x y z x y z", pick(300, 2), pick(300, 10),
             "l1 a\n\nl1 a\n \nl2", "*# <|>", "word " * 5000, "\n".join(pick(7, 9) for _ in range(60))]
    got = rules.report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()}
    assert found == {i: brute_measures(t) for i, t in enumerate(texts)}


def test_host_verdict(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "poor") for i in range(90)] + [(90 + i, good + str(i), "poor") for i in range(10)]
    rows += [(200 + i, good, "fine") for i in range(80)] + [(300, good, None), (301, "bad", None), (302, good, "single"), (302, good, "single")]
    got = rules.report(docs(spark, rows))
    by = {(r.source, r.base_failed): r for r in got.collect()}
    assert got.count() == len(rows)
    assert not by["poor", False].kept and by["fine", False].kept and by["single", False].host_docs == 2
    assert by[None, False].host_docs == 2 and by[None, False].host_failed_docs == 1
    kept = rules.keep(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got.where("kept").collect())
    assert rules.report(docs(spark, [])).count() == 0 and rules.keep(docs(spark, [])).count() == 0


def brute_lines(rows, need):
    """Line runs by the definition: every run of enough words goes that any earlier place holds, but for the lines of that place."""
    seqs, gone = {}, collections.defaultdict(set)
    for i, t in rows:
        if t is not None:
            seqs[i] = [(p, " ".join(WORD.findall(x)), len(WORD.findall(x))) for p, x in enumerate(t.split("\n")) if WORD.search(x)]
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s)):
            for o in (o for o in sorted(seqs) if o <= i):
                for b in range(a if o == i else len(seqs[o])):
                    words = n = 0
                    while a + n < len(s) and b + n < len(seqs[o]) and s[a + n][1] == seqs[o][b + n][1]:
                        words, n = words + s[a + n][2], n + 1
                        start = max(a, b + n) if o == i else a
                        if words >= need and start < a + n:
                            gone[i] |= set(range(s[start][0], s[a + n - 1][0] + 1))
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}


@pytest.mark.parametrize("seed", range(4))
def test_line_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(25)]
    block = "\n".join(rng.choice(pool) for _ in range(9))
    rows += [(100 + i, f"own line {i}\n{block}\nend {i}") for i in range(6)] + [(200, None), (201, "")]
    got = lines.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]), min_words=10)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 10)


def test_line_runs_meet_any_earlier_place(spark):
    w, t = " ".join(f"w{i}" for i in range(55)), "a short tail of few words"
    rows = [(1, w), (2, f"{w}\n{t}"), (3, f"{w}\n\n{t}"), (4, f"head\n{t}\n{w}"), (5, f"x y\n{t}\n{w}\n{t}\nz")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, [(i, x, "s") for i, x in rows])).collect()}
    assert got == {1: w, 2: t, 3: "", 4: f"head\n{t}", 5: "x y\nz"} == brute_lines(rows, 50)


@pytest.mark.parametrize("part", [1, 10**9])
def test_line_runs_with_all_keys_or_none_hot(spark, monkeypatch, part):
    monkeypatch.setattr(lines, "HOT_PART", part)
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(9)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 18)))) for i in range(20)]
    got = lines.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows]), min_words=15)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows, 15)


def test_line_runs_edges(spark):
    long = "\n".join(f"line {i} " + "w " * 10 for i in range(3000))
    same = "p " * 60
    rows = [(1, long, "s"), (2, long, "s"), (3, same, "s"), (4, f"a b\n{same}\nc d", "s"), (5, same, "s"), (5, same, "s"), (None, "z", None)]
    got = lines.dedup_lines(docs(spark, rows).withColumn("places", F.lit(1)), deleted="n", length="n_chars")
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and "places" in got.columns
    assert found[1].text == long and found[2].text == "" and found[2].n == 3000 and found[2].n_chars == 0
    assert found[3].text == same and found[4].text == "a b\nc d" and found[5].text == "" and found[None].text == "z"
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def fingerprint(t):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
    s = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=3):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    rows += [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "ÄB Ab"), (10_004, "one")]
    got = sim.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    fps = [fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{fps[i]:016x}", rows[r][0]) for i, r in enumerate(brute_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want


@pytest.mark.parametrize("hot", [20_000, 8])
def test_fingerprint_links_near_the_limit(spark, monkeypatch, hot):
    monkeypatch.setattr(sim, "HOT_SEGMENT", hot)
    rng = random.Random(1)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64)
        fps.append(base)
        for n in (1, 2, 3, 3, 4, 5):
            x = base
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.append(x)
    low = rng.getrandbits(32)  # many with one lower half
    fps += [low | (rng.getrandbits(6) * 0x2040811) << 32 for _ in range(60)]
    fps = sorted(set(x - (1 << 64) if x >> 63 else x for x in fps))
    got = sim.fingerprint_classes(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    want = brute_components([x & (1 << 64) - 1 for x in fps])
    assert {r["fp"]: r["class"] for r in got.collect()} == {x: fps[r] for x, r in zip(fps, want)}


def test_keep_one(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(3, t, "s"), (1, t, "s"), (1, t, "s"), (9, "other " + t[::-1], "s"), (None, None, "s"), (None, "", None), (7, "solo word here", "s")]
    kept = sim.keep_one(docs(spark, rows).withColumn("fingerprint", F.lit("x")))
    assert kept.columns[-1] == "fingerprint"
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 7, 9]
    assert sim.keep_one(docs(spark, [])).count() == 0 and sim.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(260)]
    nodes = sorted({x for p in links for x in p})
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
