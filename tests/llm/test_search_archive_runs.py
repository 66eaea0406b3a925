"""Ranked search, the WARC archive and periodic runs against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.llm import op11_ranked_search as ranked
from courtlens.llm import op12_warc_archive as warc
from courtlens.llm import op13_periodic_runs as periods
from courtlens.session import run_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- ranked search -----------------------------------------------------------

def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(ts) for _, ts in own), sum(len(ts) for _, ts in own)
    df = collections.Counter(w for _, ts in own for w in set(ts))
    out = []
    for item, text in items:
        scored = []
        for i, ts in own:
            tf, score = collections.Counter(ts), 0
            for w in terms(text):
                if tf[w]:
                    m = 100 - 75 + (75 * len(ts) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (
                        (10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, r, i, s) for r, (_, _, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


def found(df):
    return [tuple(r) for r in df.collect()]


def same(a, b):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r)))
    return order(a) == order(b)


def test_search_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ñu", "x1", "É", "delta", "日本", "gamma", "e", "Zz"]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)]
    docs += [(i, docs[0][1]) for i in range(300, 340)]                       # ties beyond k
    docs += [(500, None), (501, ""), (502, "-- !!"), (7, text(9)), (None, docs[0][1]), (503, docs[0][1] + " " * 100)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(80)] + [
        (100, None), (101, "..."), (102, "nowhere"), (103, docs[0][1]), (104, "alpha " * 300), (None, "beta")]
    d, i = tables(spark, docs, items)
    want = brute_search(docs, items)
    assert same(found(ranked.search(d.repartition(5), i)), want)
    # several rounds of items, small tiles and small vocabulary tiles give the same rows
    assert same(found(ranked.search(d, i, round_terms=200)), want)
    d = d.withColumns({c: F.lit(1) for c in ("k", "q", "n", "id", "tf", "score", "rank", "x", "words", "part")})
    assert same(found(ranked.search(d, i.withColumn("q", F.lit("q")))), want)
    # an item that repeats is one item, a repeated document is ranked each time
    twice = found(ranked.search(spark.createDataFrame([(1, "a b"), (1, "a b")], d.schema[:2]), i.limit(0).union(
        spark.createDataFrame([(9, "a"), (9, "a")], i.schema))))
    assert [(r[0], r[1], r[2]) for r in sorted(twice)] == [(9, 1, 1), (9, 2, 1)]


def test_search_of_nothing(spark):
    d, i = tables(spark, [(1, "a b")], [(1, "a")])
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.withColumn("text", F.lit(None).cast("string")), i)):
        got = ranked.search(docs, items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_tiles_stay_exact(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ranked, "TILE_TERMS", 16)
    q = rng.integers(0, 30_000, (5, 70))
    q[0, 3], q[1, 5], q[2] = 3 * ranked.EXACT + 17, ranked.EXACT, ranked.EXACT // 3
    parts = ranked.tiles(q)
    total = np.zeros(q.shape, np.int64)
    for lo, hi, part in parts:
        assert hi - lo <= 16 and int(part.sum(axis=1).max()) * ranked.MAX_IMPACT < 2**53
        total[:, lo:hi] += part.astype(np.int64)
    assert (total == q).all()
    d = rng.integers(0, ranked.MAX_IMPACT, (70, 9))
    got = sum((part @ d[lo:hi].astype(float)).astype(np.int64) for lo, hi, part in parts)
    assert got.tolist() == [[sum(int(q[r, t]) * int(d[t, c]) for t in range(70)) for c in range(9)] for r in range(5)]


def test_lengths_beyond_64_bits():
    n = np.array([10**9, 5])
    docs, words = 10**12, 10**15
    m = [25 + 75 * int(x) * docs // words for x in n]
    got = ranked._impacts(n, np.array([1, 1]), np.array([7, 7], np.int32), docs, words)
    assert got.tolist() == [7 * 10**9 // (7000 + 8 * x) for x in m]


def test_long_text_in_pieces():
    text = ("Wort-" * 50_000 + "x" * 300_000 + " ende").encode()
    assert [w for p in ranked.terms(text, size=1000) for w in p] == [w.encode() for w in terms(text.decode())]


# --- archive -------------------------------------------------------------------

BIG = "<p>" + "ä" * 200


def pages():
    rows = [(i, f"http://a/{i}", f"<html>{i}" + "x" * 120) for i in range(20)]
    rows += [(40 - i, "http://copy/", BIG) for i in range(12)] + [(50, None, BIG), (51, "u", "short"), (52, "u", "short")]
    rows += [(60, "u\r\nWARC-Type: forged", None), (61, "u", ""), (62, "u", "y" * 100), (63, "u", "y" * 100), (64, "u", "z" * 99), (65, "u", "z" * 99)]
    return rows + [(70, "first", "r" * 150), (70, "second", "r" * 150), (None, "n", "r" * 150), (None, "n", None)]


def expected(rows):
    out, first = [], {}
    for i, _, t in rows:
        b = (t or "").encode()
        k = (i is None, i or 0)
        first[b] = min(first.get(b, k), k)
    used = set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        revisit = len(b) >= 100 and ((i is None, i or 0) != first[b] or b in used)
        used.add(b)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response",
                    first[b][1] if revisit else None))
    return collections.Counter(out)


@pytest.fixture()
def folder(spark):
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def test_archive_matches_brute_force(spark, folder, monkeypatch):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("?") for c in ("digest", "record", "payload", "copies", "id", "part", "header", "key")})
    monkeypatch.setattr(warc, "LEAST", 3)   # digests of more than three records are joined in parts
    got = collections.Counter(tuple(r) for r in warc.report(df.repartition(4), folder).collect())
    assert got == expected(rows)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(t or "").encode() for _, _, t in rows})
    # the records come back whole
    back = collections.Counter((r.key, r.url, bytes(r.payload)) for r in warc.records(spark, folder).collect())
    assert back == collections.Counter(
        (i, u and u.replace("\r", "%0D").replace("\n", "%0A"), (t or "").encode()) for i, u, t in rows)


def test_exported_files_are_warc(spark, folder):
    rows = pages()
    warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), folder)
    warc.export(spark, folder, f"{folder}-files")
    seen = []
    for f in spark.read.format("binaryFile").load(f"{folder}-files").where("length > 0").collect():
        data, at = bytes(f.content), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
            assert data.startswith(b"WARC/1.1\r\n", at)
            body = data[end + 4: end + 4 + int(head[b"Content-Length"])]
            http, payload = body.split(b"\r\n\r\n", 1)
            assert data[end + 4 + len(body):][:4] == b"\r\n\r\n"
            at = end + 8 + len(body)
            if head[b"WARC-Type"] == b"response":
                assert hashlib.sha256(payload).hexdigest().encode() == head[b"WARC-Payload-Digest"][7:]
            else:
                assert payload == b"" and head[b"WARC-Refers-To"] and int(http.split(b": ")[-1]) >= 100
            seen.append(head[b"WARC-Record-ID"])
    assert len(seen) == len(set(seen)) == len(rows)


def test_damaged_archive_is_refused(spark, folder):
    warc.write(spark.createDataFrame(pages(), "page_id bigint, url string, html string"), folder)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{folder}-bad/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-bad/headers")
    with pytest.raises(Exception, match="other bytes"):
        warc.index(spark, f"{folder}-bad").collect()
    spark.read.parquet(f"{folder}/payloads").limit(3).write.parquet(f"{folder}-less/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-less/headers")
    with pytest.raises(Exception, match="no payload"):
        warc.index(spark, f"{folder}-less").collect()


def test_empty_archive(spark, folder):
    assert warc.report(spark.createDataFrame([], "page_id bigint, url string, html string"), folder).count() == 0


# --- periodic runs ---------------------------------------------------------------

def brute_runs(ws, least=24):
    n, seen = len(ws), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= 3 * q:
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted([(a, b - a, q) for (a, b), q in seen.items() if b - a >= least], key=lambda r: (r[0], r[2]))


def brute_collapsed(ws, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def sample(rng):
    n, kind = rng.randrange(0, 400), rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        w = [rng.choice("abc") for _ in range(rng.randrange(1, 60))]
        return (w * n)[:n]
    if kind == 3:
        out = []
        while len(out) < n:
            p = rng.randrange(1, 40)
            w = ["a"] * (p - 1) + ["b"] if rng.random() < 0.5 else [rng.choice("aaabbcdefg") for _ in range(p)]
            out += (w * 7)[: rng.randrange(1, 6 * p + 1)]
        return out
    if kind == 4:   # Fibonacci words: very many repeats, few runs
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    w = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 8)
    w[rng.randrange(len(w))] = "z"
    return w + w * rng.randrange(0, 3)


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(15):
        docs = [sample(rng) for _ in range(20)]
        got = list(periods.search([" ".join(d).encode() for d in docs], lot=rng.choice([200, 5_000, 10**6])))
        for d, (runs, left) in zip(docs, got, strict=True):
            want = brute_runs(d)
            assert [tuple(r.values()) for r in runs] == want
            assert left.decode() == brute_collapsed(d, want)


def test_long_text_of_one_run():
    words = [f"w{i}" for i in range(700)] * 300 + ["end"]
    (runs, left), = periods.search([" ".join(words).encode()])
    assert [tuple(r.values()) for r in runs] == [(0, 210_000, 700)] and left.decode() == " ".join(words[:700] + ["end"])


def test_words_in_pieces():
    text = "\t".join(f"w{i % 7}" for i in range(5_000)).encode() + b"\x0b\x0c\r x\xc2\xa0y "
    known = periods._Numbers()
    names = periods._word_numbers(text, known, size=100)
    assert [list(known)[i] for i in names] == text.split()


def test_report_by_definition(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(sample(rng))) for i in range(150)] + [(900, None), (901, ""), (902, " \n "), (3, "a b"), (3, "a b"), (None, "a " * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("k", "t", "b", "r", "found", "runs")})
    want = []
    for i, t in rows:
        ws = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if x < a else ws[a + (x - a) % p] for x, w in enumerate(ws)]
        runs, best = brute_runs(ws), (None, None, None)
        for r in runs:
            if best[0] is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(brute_collapsed(ws, runs).encode()).hexdigest()))
    got = periods.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert periods.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="found"):
        periods.periodic_runs(df)
