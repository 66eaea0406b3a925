"""Classifiers by held-out accuracy, decoding and page rules by hand-made cases, the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from courtlens.llm import linear
from courtlens.llm import op1_ordinal_quality as quality
from courtlens.llm import op2_toxicity as toxic
from courtlens.llm import op5_language as language
from courtlens.llm import op8_main_text as web

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.01"


def auc(score, label):
    score, label = np.asarray(score, float), np.asarray(label)
    r = np.argsort(np.argsort(score, kind="stable"))
    n1, n0 = label.sum(), (1 - label).sum()
    return (r[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def held(r, n, which):
    return zlib.crc32(str(r.doc_id).encode()) % n == which


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_cumulative_link_fit(spark):
    """Grades drawn from known weights: order, thresholds and tail probabilities come back."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        f = [int(x) for x in np.flatnonzero(rng.random(6) < 0.5)]
        eta = sum((2.0, -2.0, 1.0, 0.0, 0.0, -1.0)[x] for x in f) + rng.logistic()
        rows.append((int(eta > -1) + int(eta > 1.5), f))
    m = linear.fit(spark.createDataFrame(rows, "y int, features array<int>"), "y", l2=0.1)
    assert len(m.cut) == 2 and abs(m.cut[0] + 1) < 0.4 and abs(m.cut[1] - 1.5) < 0.4
    assert abs(m.weight[0] - 2) < 0.4 and abs(m.weight[1] + 2) < 0.4
    eta = np.array([-2.0, 0.0, 2.0])
    assert (m.tail(eta, 1) > m.tail(eta, 2)).all() and (np.diff(m.expected(eta)) > 0).all()


def test_fit_without_rows(spark):
    for rows in ([], [(1, [5])], [(0, []), (0, [3])]):
        m = linear.fit(spark.createDataFrame(rows, "y int, features array<int>"), "y")
        assert np.isfinite(m.tail(np.zeros(1))).all()


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.report(docs.withColumn("grade", F.lit(9)), labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(r, 3, 1) for r in got.values())
    test = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([r.score for r, _ in test], [q for _, q in test]) > 0.9
    assert all(0 <= r.score <= 1 and 0 <= r.expected_grade <= 2 and r.predicted == (r.score >= 0.5) for r in got.values())
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (None, "a", None, None, None)], DOCS)
    assert quality.report(odd, labels).count() == 3 and quality.report(odd.limit(0), labels).count() == 0
    assert quality.report(odd, labels.limit(0)).count() == 3


def letters(spark):
    words = "you are an idiot and a stupid loser who is pathetic trash moron the weather is nice today we walk home".split()
    return toxic.letter_model(spark.createDataFrame([(1, " ".join(words * 50))], "doc_id bigint, text string"))


@pytest.mark.parametrize("disguised, plain", [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("patheeeeetic", "pathetic"),
    ("tr@sh!!", "trash"), ("IDIOOOOT", "idiot"), ("st*pid", "stupid"), ("weather", "weather"), ("2024-05-06", ""), ("the&&&", "the")])
def test_decoding(spark, disguised, plain):
    assert " ".join(toxic.Restorer(letters(spark)).token(disguised.lower())) == plain


def test_spaced_letters(spark):
    r = toxic.Restorer(letters(spark))
    assert "idiot" in r.words("you are an i d i o t today") and "moron" in r.words("M 0 R 0 N")
    assert r.text("you $tup1d l o s e r") == "you stupid loser"


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxic.report(docs, labels).collect()}
    test = [(got[r.doc_id], r.toxic) for r in labels.collect() if held(r, 3, 1)]
    assert auc([r.score for r, _ in test], [t for _, t in test]) > 0.85
    assert sum(r.predicted for r, t in test if t == 0) <= 0.02 * len(test)
    assert all(r.held_out == held(r, 3, 1) and r.predicted == (r.score >= 0.7) for r in got.values())
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (2, "", None, None, None), (None, "a", None, None, None)], DOCS)
    assert toxic.report(odd, labels).count() == 4 and toxic.report(odd.limit(0), labels).count() == 0
    assert toxic.keep(odd, labels.limit(0)).count() == 4


def test_language_held_out(spark, tables):
    docs, _ = tables
    got = {r.doc_id: r for r in language.report(docs).collect()}
    test = [(got[r.doc_id].lang_pred, r.lang) for r in docs.collect() if held(r, 4, 2)]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    odd = docs.limit(50).unionByName(spark.createDataFrame(
        [(10**7, None, None, None, None), (10**7 + 1, "12 !!", "en", None, None), (10**7 + 1, "12 !!", "en", None, None), (None, "the", "en", None, None)], DOCS))
    found = [r for r in language.report(odd).collect() if (r.doc_id or 0) >= 10**7]
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in language.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rank_order_distance():
    """The out-of-place sums against a plain dictionary version."""
    texts = ["the cat sat on the mat", "der hund und die katze", "the hund"]

    def plain(t):
        out = {}
        for w in t.split():
            w = f" {w} "
        s = " " + " ".join(t.split()) + " "
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i: i + n]
                if (n == 1 and g == " ") or (n == 3 and g[1] == " "):
                    continue
                out[g] = out.get(g, 0) + 1
        return out

    for t in texts:
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        n = {code(g): k for g, k in plain(t).items()}
        assert language.ranked(language.grams(t), 30).tolist() == sorted(n, key=lambda c: (-n[c], c))[:30]


PAGES = [
    ("<article><h1>A &amp; B</h1><p>one<br>two <b>three</b><p>x &lt;y&gt;</article><footer>f</footer>", "A & B\none two three\nx <y>"),
    ("<body><header>H</header><main><p>m1</p><aside>s</aside><form>q</form><p>m2<!-- c --></p></main><nav>n</nav>", "m1\nm2"),
    ("<article>a<div class='comments'><p>no</p></div><p class=\"ad\">buy</p><p>b</p></article>", "a\nb"),
    ("<article><script>var t='</p>';</script><style>p{}</style>q<p>if a < b then</p>", "q\nif a < b then"),
    ("<article><p>x<div class='cookie-notice'>ok?</div>y</article>", "x\ny"),
    ("<article>  \n a&nbsp;b\t c </article>", "a b c"), ("<nav>only</nav>", ""), ("", ""), (None, ""), ("plain words", "plain words"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_declared_pages(page, text):
    found = web.blocks(page or "")
    own = [t for v, t in found if v > 0] or [t for v, t in found if v == 0]
    assert "\n".join(own) == text


NAMED = [
    ("<div class='content has-sidebar'><article><p>x y</article></div>", "x y"),
    ("<div class='elementor-widget elementor-widget-text'><article>x</article></div>", "x"),
    ("<body class='search'><div id='page' class='no-comments'><article>x</article><p>y</p></div>", "x"),
    ("<article class='post category-social'>x<p class='related-work'>y</p></article>", "x\ny"),
    ("<div class='sidebar'><div class='box'><article>x</article></div></div><p>y</p>", "x"),
    ("<form id='aspnetForm'><nav>n</nav><main>x</main></form>", "x"),
    ("<main><h1>t</h1><div class='widget'><article>a b c</article></div></main>", "t\na b c"),
    ("<article class='search'><p>x</p><div class='entry-content'>y</div></article>", "x\ny"),
    ("<article>one two three<div class='related'><article>a b</article><article>c d</article></div></article>", "one two three"),
    ("<article>a</article><ol class='comment-list'><article class='comment-body'>b c d</article></ol>", "a"),
    ("<aside><article>teaser</article></aside><div hidden><article>old</article></div><p>x</p>", "x"),
    ("<article>a<math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<object data='f'>c</object><xmp>&lt;<i></xmp>d</article>", "ax=2 bc\n&lt;<i>\nd"),
    ("<article>a<img class='banner' src='i'> b</article>", "a b"), ("<div class='widget'><p>a</p><p>b</p></div><nav>n</nav>", "a\nb"),
]


@pytest.mark.parametrize("page, text", NAMED)
def test_badly_named_containers(page, text):
    found = web.blocks(page)
    own = [t for v, t in found if v > 0] or [t for v, t in found if v == 0]
    assert "\n".join(own) == text


@pytest.mark.parametrize("shard", [500_000, 40])
def test_host_suffix_array(spark, shard):
    rng = random.Random(1)
    frame = "our site offers the very best news of all the town"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    own = [" ".join(word() for _ in range(12)) for _ in range(9)]
    pages = [(i, f"http://h.example/{i}", f"<div>{frame}</div><div>{o}</div><div>tail {frame} end{i}</div>") for i, o in enumerate(own)]
    pages += [(50, "http://other.example/", f"<div>{frame}</div>"), (51, None, None), (51, None, None), (None, "", "<p>solo")]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in web.main_text(d, shard_tokens=shard).collect()}
    # the frame stands twice on every page of the host; "tail" goes with it, being repeated in front of it
    assert all(got[i].text == f"{o}\nend{i}" for i, o in enumerate(own))
    assert got[50].text == frame and got[51].text == "" and got[None].text == "solo" and got[50].n_chars == len(frame)
    assert web.main_text(d, shard_tokens=shard).count() == len(pages) and web.main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [500_000, 60])
def test_copies_and_quotations_stay(spark, shard):
    """Only what stands on a share of a host's distinct pages goes; copies of a page are one page."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    menu, quote, own = text(10), text(12), [text(20) for _ in range(16)]
    body = [f"{menu} {o} {quote if i in (3, 7) else ''}" for i, o in enumerate(own)]
    pages = [(i, "http://big.example/", f"<div>{b}</div>") for i, b in enumerate(body)]
    pages += [(100 + i, "http://big.example/copy", f"<div>{body[0]}</div>") for i in range(9)]
    pages += [(110, "http://big.example/copy", f"<p>{menu}</p><p>{own[0]}</p>")]
    pages += [(200 + i, "http://small.example/", f"<div>{own[1]}</div>") for i in range(4)]
    got = {r.page_id: r.text for r in web.main_text(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"), shard_tokens=shard).collect()}
    assert all(got[i] == f"{own[i]} {quote}" if i in (3, 7) else got[i] == own[i] for i in range(16))
    assert {got[100 + i] for i in range(9)} == {own[0]} == {got[110]} and {got[200 + i] for i in range(4)} == {own[1]}
    assert len(got) == len(pages)


@pytest.mark.parametrize("shard", [500_000, 60])
def test_streams_of_declared_pages_are_counted(spark, shard):
    """What declared articles share stays, but not what most streams hold beside an article; open texts keep what articles hold."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    notice, quote, plain, own = text(12), text(10), text(9), [text(20) for _ in range(16)]
    # every fourth article holds the notice that all pages have in their footers, and all hold the quotation
    page = lambda i: (f"<nav>{text(5)}</nav><article><p>{own[i]}</p><p>{notice if i % 4 == 0 else ''}</p><p>{quote}</p></article>"
                      f"<footer>{notice} {i}</footer>")
    pages = [(i, "http://declared.example/", page(i)) for i in range(16)]
    pages += [(100 + i, "http://declared.example/", page(i)) for i in range(4)]
    # a host of which a few pages declare nothing
    pages += [(200 + i, "http://mixed.example/", f"<main>{own[i]} {quote}</main>") for i in range(9)]
    pages += [(300 + i, "http://mixed.example/", f"<div>{plain}</div><div>{own[9 + i]}</div><div>{quote}</div>") for i in range(5)]
    # teasers beside articles are not the articles' boilerplate
    pages += [(400 + i, "http://teasers.example/", f"<article>{own[i]}</article><aside>{own[0]}</aside>") for i in range(9)]
    got = {r.page_id: r.text for r in web.main_text(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"), shard_tokens=shard).collect()}
    assert all(got[i] == f"{own[i]}\n{quote}" for i in range(16)) and all(got[100 + i] == got[i] for i in range(4))
    assert all(got[200 + i] == f"{own[i]} {quote}" for i in range(9))
    assert all(got[300 + i] == f"{own[9 + i]}\n{quote}" for i in range(5))
    assert all(got[400 + i] == own[i] for i in range(9)) and len(got) == len(pages)


@pytest.mark.parametrize("shard", [500_000, 900, 300])
def test_masks_against_brute_force(spark, shard):
    """Few words, so that windows of two words stand in texts and frames of all kinds; every page against plain counting."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    pages = []
    for i in range(90):
        tag = "main" if i % 3 else "div"
        pages.append((i, f"http://h{i % 2}.example/", f"<nav>{text(rng.randrange(9))}</nav><{tag}><p>{text(rng.randrange(40))}</p><p>{text(9)}</p></{tag}>"))
    got = {r.page_id: r.text for r in web.main_text(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"), length=2, shard_tokens=shard).collect()}
    changed = 0
    for host in {u for _, u, _ in pages}:
        parts = {i: web._parts(h) for i, u, h in pages if u == host}
        streams = {(k, " ".join(bs)) for kind, text, frame in parts.values() for k, bs in ((kind, text), (web.FRAME, frame)) if bs}
        votes = {}
        for k, s in streams:
            for w in {*zip(s.split(), s.split()[1:])}:
                votes.setdefault(w, {-1: 0, 0: 0, 1: 0})[k] += 1
        need = lambda n: max(web.MIN_PAGES, -(-n // 4))
        n_open, n = sum(k == 0 for k, _ in streams), sum(k >= 0 for k, _ in streams)
        bad = {w for w, v in votes.items() if (v[0] >= need(n_open) or v[0] + v[1] >= need(n)) and v[1] < v[0] + v[-1]}
        for i, (_, bs, _) in parts.items():
            words = " ".join(bs).split()
            gone = np.zeros(len(words), bool)
            for j, w in enumerate(zip(words, words[1:])):
                gone[j: j + 2] |= w in bad
            want, at = [], 0
            for b in bs:
                left = [w for j, w in enumerate(b.split(), at) if not gone[j]]
                at += len(b.split())
                want += [" ".join(left)] if left else []
            assert got[i] == "\n".join(want)
            changed += gone.any()
    assert 0 < changed < len(pages)


def test_repeated_against_brute_force():
    rng = np.random.default_rng(3)
    tokens, page = rng.integers(0, 3, 400), np.sort(rng.integers(0, 9, 400))
    for length in (1, 3, 5, 8):
        want = np.zeros(400, bool)
        at = {}
        for i in range(400 - length + 1):
            if page[i] == page[i + length - 1]:
                at.setdefault(tuple(tokens[i: i + length]), []).append(i)
        for spots in at.values():
            if len({page[i] for i in spots}) > 1:
                for i in spots:
                    want[i: i + length] = True
        assert (web.repeated(tokens, page, length) == want).all()


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
            assert docs.count() <= before.count() and docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "line_dedup":
            assert docs.count() == before.count()
            assert docs.where("n_chars <> length(text)").count() <= before.where("n_chars <> length(text)").count()
        if name == "near_duplicates":
            kept = docs
    assert docs.select("doc_id").distinct().count() == kept.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
