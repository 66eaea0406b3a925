"""Vector buckets, packing and the piece codec against brute force, round trips and the libraries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.llm import op4_embedding_lsh as lsh
from courtlens.llm import op6_sentencepiece as sp
from courtlens.llm import op7_packing as packing
from courtlens.llm.queries import vocabulary


def brute_links(rows, least=0.95):
    sound = {}
    for n, (k, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[n] = np.asarray(v, float) / np.linalg.norm(np.asarray(v, float) / max(map(abs, v))) / max(map(abs, v))
    root, count = {n: n for n in range(len(rows))}, [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = sorted(sound)
    for i in at:
        for j in at:
            if i < j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= least:
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    least_key = {}
    for n, (k, _) in enumerate(rows):
        r = find(n)
        if k is not None:
            least_key[r] = min(k, least_key.get(r, k))
    return sorted((str(k), count[n], str(least_key.get(find(n)))) for n, (k, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2_000, 7])
def test_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lsh, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size in (40, 9, 2, 1, 1):
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, [float(x) for x in base + rng.standard_normal(16) * 0.1]))
            k += 1
    rows += [(k + i, rows[0][1]) for i in range(30)] + [(k + 40, [2 * x for x in rows[45][1]])]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [nan] + [1.0] * 15), (904, [inf] + [1.0] * 15),
             (905, [None] + [1.0] * 15), (906, [1.0, 0.0]), (907, [1.0, 0.0]), (907, [1.0, 0.0]), (None, rows[41][1]), (908, [1e-200, 0.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1))
    got = lsh.near_vectors(d)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got.collect()) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id and r.vec_id is not None) for r in got.collect())
    assert lsh.near_vectors(d.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.95, 0.97 and 0.99 meet in some table."""
    rng = np.random.default_rng(0)
    for cosine, least in ((0.95, 0.95), (0.97, 0.99), (0.99, 0.999)):
        a = lsh.unit(rng.standard_normal((2000, 64)))
        b = rng.standard_normal((2000, 64))
        b = lsh.unit(b - (a * b).sum(1, keepdims=True) * a)
        b = cosine * a + (1 - cosine ** 2) ** 0.5 * b
        assert (lsh.buckets(a) == lsh.buckets(b)).any(axis=1).mean() >= least


def test_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 101, 3000)
    bins, offset, fill = packing.best_fit(sizes, 100)
    assert fill.max() <= 100 and fill.sum() == sizes.sum() and len(fill) <= 1.02 * sizes.sum() / 100 + 1
    for b in range(len(fill)):
        at = np.argsort(offset[bins == b])
        assert (np.cumsum(sizes[bins == b][at]) - sizes[bins == b][at] == offset[bins == b][at]).all()


@pytest.mark.parametrize("group", [20_000, 40])
def test_packing_is_whole(spark, sf, monkeypatch, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_ROWS", group)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9002, "word " * 9000), (9003, "中文 🙂 <|endoftext|> x"), (9004, "z" * 5000), (9004, "z" * 5000), (None, "a  b\n\n c")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("bin", F.lit(0)), vocabulary()).collect()
    tok = Tokenizer.from_file(vocabulary())
    want = []
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else (len(ids) - 1) % 2048 + 1
        cuts = [0] + list(range(first, len(ids) + 1, 2048))
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(k), n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in got) / 2048 * 1.02 + 2
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty, vocabulary()).count() == 0


def test_equal_rows_spread(spark):
    p = spark.range(4000, numPartitions=5).selectExpr(
        "cast(null as bigint) as k", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32", "monotonically_increasing_id() as row")
    d = packing._dealt(p, 8)
    sizes = [r["count"] for r in d.groupBy("node").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700 and "row" not in d.columns


def test_bins_not_handed_on_cost_no_sequence(monkeypatch):
    """The number of sequences with few bins handed on, and with all."""
    rng = np.random.default_rng(4)

    def sequences(groups, cap):
        monkeypatch.setattr(packing, "HANDED_ON", cap)
        level, done = [packing.best_fit(g, 2048)[2] for g in groups], 0
        while len(level) > 1:
            above = []
            for i in range(0, len(level), 3):
                handed = [f[packing._open(f, 2048)] for f in level[i: i + 3]]
                done += sum(map(len, level[i: i + 3])) - sum(map(len, handed))
                above.append(packing.best_fit(np.concatenate(handed), 2048)[2])
            level = above
        return done + len(level[0])

    for low, high in ((1030, 1400), (1030, 2048), (1, 2049), (600, 1300), (1500, 1600)):
        groups = [np.append(rng.integers(low, high, 300), rng.integers(1, 1025, rng.integers(0, 3))) for _ in range(27)]
        assert sequences(groups, 20) == sequences(groups, 10**9)


def model_bytes():
    with open(vocabulary(sp.MODEL), "rb") as f:
        return f.read()


ODD = ["", " ", "  a  b ", "Hello wörld 中文字 \t\n🙂🙂 ok", "a" * 700, "\n\n\n", "don't antidisestablishmentarianism " * 3,
       "x" + " " * 40 + "y", "été naïve ﬁ ½ ​", "0123456789" * 30, "<s> </s> <unk> <0x41>"]


def test_pieces_equal_the_library(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(80).collect()] + ODD
    codec = sp.Codec(model_bytes())
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [codec.v.sp.encode(t) for t in texts]
    assert [codec.decode(g) for g in got] == [codec.v.sp.decode(g.tolist()) for g in got]
    assert [codec.decode(g) for g in got] == texts


def test_unigram_way_is_the_best(spark):
    codec = sp.Codec(model_bytes())
    v = codec.v
    v.kind = sp.UNIGRAM
    rng = random.Random(2)

    def best(w):
        top = [0.0] + [-1e18] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(max(0, j - v.longest), j):
                p = v.id_of.get(w[i:j])
                s = float(v.score[p]) if p is not None else float(v.lowest) if j == i + 1 else -1e18
                top[j] = max(top[j], top[i] + s)
        return top[-1]

    for size in (1, 2, 5, 9, 20):
        words = ["".join(rng.choice("▁thenig中🙂") for _ in range(size)) for _ in range(40)]
        for w, ids in zip(words, sp.viterbi(words, v)):
            assert "".join(v.text[i] if i >= 0 else chr(-1 - i) for i in ids) == w
            total = sum(float(v.score[i]) if i >= 0 else float(v.lowest) for i in ids)
            assert abs(total - best(w)) < 1e-3 * max(1, abs(total))


def test_codec_columns(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + [None])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in sp.report(d, model_bytes()).collect()}
    lib = sp.Vocabulary(model_bytes()).sp
    for i, t in enumerate(ODD + [None]):
        ids = lib.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[i].round_trip
    assert sp.report(d.limit(0), model_bytes()).count() == 0
    both = d.select("doc_id", "text", sp.encoder(model_bytes())("text").alias("ids")).withColumn("back", sp.decoder(model_bytes())("ids"))
    assert all(r.back == (r.text or "") and len(r.ids) == got[r.doc_id].n_tokens for r in both.collect())
