"""Main text of web pages: a host suffix array over the token streams of all pages, then what the pages declare.

A page that declares its article (``article``, ``main``, or a container named so) has it as its text:
menus, headers, footers, sidebars, notices, adverts, forms and comments
inside it go, its other blocks stay. A class or id is a bad name only
as a whole: ``sidebar`` and ``sidebar-box`` are, ``has-sidebar`` is not. An article declared inside
a badly named container, or badly named itself, wins over the name if it holds more words than
what the page declares elsewhere; teasers and comments hold less. Where nothing but badly named
containers holds text, their blocks count as undeclared. A page that declares no article has its
undeclared blocks as its text.

Every page gives the suffix array of its host up to two token streams: its text, declared or open, and
its frame, that is its other blocks. Equal streams of a host and a kind are one. Streams are concatenated,
suffixes are sorted by prefix doubling, and the streams that hold a substring of ``MIN_TOKENS`` tokens are
counted by kind. It is boilerplate when it stands in ``SHARE`` of the host's distinct texts, or of the open
ones among them, and in ``MIN_PAGES`` of them at least, unless the host's pages overrule that: where at least
as many streams declare it as article as hold it open or in a frame, it stays. Covered tokens
of a text go and the runs between them stay. So copies of a page keep their text, so does a quotation on a few
pages, and so does what declared articles share, unless most pages hold it beside their article.

A host with many tokens is cut into shards of whole streams. What stands in a share of all streams stands in
that share of one shard's, so each shard names the windows that reach it there, by their hashes; all shards
count the named ones, and the sums decide. Where shards hold fewer than ``SHARD_TEXTS`` texts, as those of very
long pages do, that would name too many, and all windows are counted.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import text_batches
from courtlens.session import stable

MIN_TOKENS = 8
SHARD_TOKENS, SHARD_TEXTS = 500_000, 16
#: Distinct texts of a host that must hold a string before it is boilerplate: this share, and so many at least.
SHARE, MIN_PAGES = 0.25, 3
#: Kinds of token streams.
FRAME, OPEN_TEXT, ARTICLE = -1, 0, 1

#: Names of elements.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
DROPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu"}
DECLARED = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = DROPPED | DECLARED | {
    "html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption",
    "address", "details", "summary", "fieldset", "legend", "hgroup", "center", "hr", "search",
}
#: Containers whose end tags are matched; the others only end the running block.
NESTED = BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "hr", "html", "body",
                   "h1", "h2", "h3", "h4", "h5", "h6", "caption", "legend", "summary"}
_BAD = re.compile(
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|newsletter|subscribe"
    r"|subscription|sidebar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|topbar|comments?|replies|disqus"
    r"|share|sharing|social|related|recommended|popup|modal|overlay|paywall|toolbar|widgets?|skiplink|login|signup|search")
#: Words that may stand beside a bad name in one token without changing what it says.
_BESIDE = frozenset(
    "site page main global primary secondary top bottom left right inner outer sticky fixed floating mobile desktop sub mega dropdown"
    " post posts entry article articles story stories news content body text title label meta author count header form box bar area"
    " container wrapper wrap holder panel group row block section list link links item items button buttons icon icons media network"
    " networks unit slot google dfp gpt div previous next respond topics for you".split())
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|article-body|post-content|entry-content|story-body|main-content|articlebody)(?=$|\s)", re.I)
_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu\w*)$", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: Verdicts: dropped for good, dropped for a name, neither, declared, and from DOUBT on the numbers of articles
#: that are declared but badly named or in a badly named container.
HARD, SOFT, OPEN, SURE, DOUBT = -2, -1, 0, 1, 2


@lru_cache(maxsize=1 << 16)
def _bad(token: str) -> bool:
    """Whether a class or id, as a whole, names something beside the main text."""
    parts = [x for x in re.split("[-_]+", token.lower().replace("side-bar", "sidebar").replace("skip-link", "skiplink")) if x]
    return any(map(_BAD.fullmatch, parts)) and all(x in _BESIDE or x.isdigit() or _BAD.fullmatch(x) for x in parts)


def _verdict(name: str, attributes: str, above: int) -> int:
    """The verdict on what an element holds, given what holds above; DOUBT stands for any number."""
    if above == HARD or (name in DROPPED and name != "form" and not (name == "header" and above > 0)):
        return HARD
    bad, declared = name == "form", name in DECLARED
    if attributes and not attributes.isspace():
        found = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(attributes)}
        if (_ROLE.match(found.get("role", "")) or "hidden" in found
                or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))):
            return HARD
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            if _bad(token):
                bad = True
            elif _GOOD.search(token):
                declared = True
        declared = declared or found.get("role", "").lower() in DECLARED or found.get("itemprop") == "articleBody"
    if bad:  # in a badly named container it is one of the comments or teasers
        return DOUBT if declared and above != SOFT else SOFT
    if declared:
        return DOUBT if above == SOFT or above >= DOUBT else SURE
    return above


def _settle(out: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """-1 to drop, 1 for declared main text, 0 for neither, when all blocks are known."""
    held: Counter[int] = Counter()
    for v, t in out:
        if v > 0:
            held[v] += t.count(" ") + 1
    out = [(v if v < DOUBT else SURE if held[v] > held[SURE] else SOFT, t) for v, t in out]
    if all(v < 0 for v, _ in out):
        out = [(v + 1, t) for v, t in out]
    return [(max(v, -1), t) for v, t in out]


def blocks(page: str) -> list[tuple[int, str]]:
    """(verdict, text) of the blocks with text, in page order; white space is folded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    piece: list[str] = []
    at, verdict, end, doubts = 0, OPEN, len(page), 0

    def close():
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                out.append((verdict, text))
            piece.clear()

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece.append(page[at:lt])
            at = lt
            continue
        m = _TOKEN.match(page, at)
        if not m:  # a sign that begins no tag is text
            piece.append("<")
            at += 1
            continue
        at = m.end()
        if m.group(2) is None:
            continue
        closing, name = m.group(1), m.group(2).lower()
        if name in RAW and not closing:
            if not m.group(3).rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name == "xmp" and not closing:  # what it holds is text as it stands
            close()
            stop = re.compile(r"</xmp\b[^>]*>?", re.I).search(page, at)
            piece.append(html.escape(page[at: stop.start() if stop else end], quote=False))
            at = stop.end() if stop else end
            close()
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name not in BLOCKS:
            above = stack[-1][1] if stack else OPEN
            if not closing and m.group(3) and name not in VOID and not m.group(3).rstrip().endswith("/"):
                below = _verdict("span", m.group(3), above)
                if below < min(above, OPEN):
                    close()
                    stack.append((name, below))
                    verdict = below
            elif closing and stack and stack[-1][0] == name:
                close()
                stack.pop()
                verdict = stack[-1][1] if stack else OPEN
            continue
        close()
        if closing:
            if any(x == name for x, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name in NESTED and not m.group(3).rstrip().endswith("/"):
            above = stack[-1][1] if stack else OPEN
            below = _verdict(name, m.group(3), above)
            if below == DOUBT:
                if above < DOUBT:
                    doubts += 1
                below = above if above >= DOUBT else DOUBT + doubts
            stack.append((name, below))
        verdict = stack[-1][1] if stack else OPEN
        # the names of html and body are those of the page
        if not closing and name not in NESTED and name not in ("html", "body") and verdict >= 0 and m.group(3):
            below = _verdict(name, m.group(3), verdict)
            verdict = below if below < OPEN else verdict
    close()
    return _settle(out)


def _parts(page: str | None) -> tuple[int, list[str], list[str]]:
    """The kind of a page's text, the blocks of the text, and the other blocks."""
    found = blocks(page or "")
    kind = ARTICLE if any(v > 0 for v, _ in found) else OPEN_TEXT
    return kind, [t for v, t in found if v >= kind], [t for v, t in found if v < kind]


def _digest(stream: str) -> str:
    return hashlib.md5(stream.encode()).hexdigest()


def _streams(texts: bool):
    """(host, kind, digest, n, stream) of all pages, equal ones once a task; only their sizes if not ``texts``."""
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for p in parts:
            out = []
            for host, h in zip(p["host"], p["h"]):
                kind, text, frame = _parts(h)
                for k, bs in ((kind, text), (FRAME, frame)):
                    stream = " ".join(bs)
                    key = (host, k, _digest(stream))
                    if bs and key not in seen:
                        seen.add(key)
                        out.append((*key, stream.count(" ") + 1, stream if texts else None))
            yield pd.DataFrame(out, columns=["host", "kind", "digest", "n", "stream"])
    return run


def _texts(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pages with their texts and the keys of their streams."""
    for p in parts:
        found = [_parts(h)[:2] for h in p.pop("h")]
        yield p.assign(kind=[k for k, _ in found], digest=[_digest(" ".join(bs)) for _, bs in found],
                       text=["\n".join(bs) for _, bs in found])


def _suffixes(tokens: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the substrings of ``length`` in suffix order, the number of each substring, and whether it is its first on a page.

    Suffixes are ranked by prefix doubling as far as ``length``: equal ranks are neighbours
    of the suffix array that agree on so many tokens. Substrings do not cross pages.
    """
    n = len(tokens)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < length:
        step = min(have, length - have)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    at = np.flatnonzero(page[: n - length + 1] == page[length - 1:])
    order = at[np.argsort(rank[at] * (n + 1) + page[at])]  # the suffix array of the windows
    r, g = rank[order], page[order]
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]
    another = first.copy()
    another[1:] |= g[1:] != g[:-1]
    return order, np.cumsum(first) - 1, another


def repeated(tokens: np.ndarray, page: np.ndarray, length: int, least: int = 2) -> np.ndarray:
    """Which tokens lie in a substring of ``length`` that stands on ``least`` pages or more."""
    order, number, another = _suffixes(tokens, page, length)
    return _cover(order[np.bincount(number[another])[number] >= least], len(tokens), length)


def _cover(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def _words(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all streams of a group, the words by number, the stream of each word, and where the streams end."""
    words = [s.split(" ") for s in p["stream"]]
    size = np.array([len(w) for w in words])
    tokens, names = pd.factorize(np.array(list(chain.from_iterable(words)), object))
    return tokens, names, np.repeat(np.arange(len(words)), size), np.cumsum(size)[:-1]


def _votes(p: pd.DataFrame, tokens: np.ndarray, page: np.ndarray, length: int):
    """Starts of the windows in suffix order, their numbers, and a table by number: a start, and the streams of each kind."""
    order, number, another = _suffixes(tokens, page, length)
    kind, n = p["kind"].to_numpy()[page[order]], number[-1] + 1 if len(number) else 0
    count = {name: np.bincount(number[another & (kind == k)], minlength=n)
             for name, k in (("open", OPEN_TEXT), ("declared", ARTICLE), ("frame", FRAME))}
    return order, number, pd.DataFrame({"start": order[np.unique(number, return_index=True)[1]], **count})


def _need(n: int, share: float) -> int:
    return max(MIN_PAGES, math.ceil(n * share))


def _boilerplate(t, need_open, need):
    """Whether windows are boilerplate, by their streams of each kind; ``t`` is a table of pandas or of Spark."""
    return ((t["open"] >= need_open) | (t["open"] + t["declared"] >= need)) & (t["declared"] < t["open"] + t["frame"])


def _hashes(tokens: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each start on; the same in every shard."""
    n = max(0, len(tokens) - length + 1)
    x = pd.util.hash_array(names)[tokens]
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[i: n + i]
    return out.view(np.int64)


def _masks(p: pd.DataFrame, gone: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """(host, kind, digest, gone, w): where covered runs of words begin and end in each text that has any; w is null."""
    edges = [np.flatnonzero(np.diff(m, prepend=False, append=False)).astype(np.int32) for m in np.split(gone, ends)]
    some = p.assign(gone=edges, w=None)[["host", "kind", "digest", "gone", "w"]]
    return some[[k != FRAME and len(e) > 0 for k, e in zip(p["kind"], edges)]]


def _decide(length: int, share: float):
    """The masks of a host in one piece; of a shard one row with the hashes of the windows that may be boilerplate, if any.

    Where all windows are counted, the row names none."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        row = {"host": p["host"].iloc[:1], "kind": FRAME, "digest": None, "gone": None}
        if p["few"].iloc[0]:
            return pd.DataFrame({**row, "w": [[]]})
        tokens, names, page, ends = _words(p)
        order, number, table = _votes(p, tokens, page, length)
        n_open, n = int((p["kind"] == OPEN_TEXT).sum()), int((p["kind"] != FRAME).sum())
        if p["shards"].iloc[0] == 1:
            good = _boilerplate(table, _need(n_open, share), _need(n, share))
            return _masks(p, _cover(order[good.to_numpy()[number]], len(tokens), length), ends)
        texts = table["open"] + table["declared"]
        least = share * (1 - 1e-9)
        maybe = ((table["open"] > 0) & (table["open"] >= least * n_open)) | ((texts > 0) & (texts >= least * n))
        w = _hashes(tokens, names, length)[table["start"][maybe]]
        return pd.DataFrame({**row, "w": [w]})[:len(w)]
    return run


def _count(length: int):
    """(host, w, open, declared, frame): streams of a shard, by kind, that hold each of the named windows, or each window."""
    def run(p: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=["host", "w", "open", "declared", "frame"])
        tokens, names, page, _ = _words(p)
        table = _votes(p, tokens, page, length)[2]
        table = table.assign(host=p["host"].iloc[0], w=_hashes(tokens, names, length)[table["start"]])
        return table.loc[p["few"].iloc[0] | table["w"].isin(found["w"]), ["host", "w", "open", "declared", "frame"]]
    return run


def _meet(length: int):
    """The masks of a shard, given the windows that are boilerplate of the host."""
    def run(p: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame(columns=["host", "kind", "digest", "gone", "w"])
        tokens, names, page, ends = _words(p)
        h = _hashes(tokens, names, length)
        inside = page[: len(h)] == page[length - 1:][: len(h)]
        return _masks(p, _cover(np.flatnonzero(inside & np.isin(h, found["w"])), len(tokens), length), ends)
    return run


def _unique_runs(rest: list[str], gone: np.ndarray) -> str:
    out, at = [], 0
    for b in rest:
        ws = b.split(" ")
        left = [w for w, g in zip(ws, gone[at: at + len(ws)]) if not g]
        at += len(ws)
        if left:
            out.append(" ".join(left))
    return "\n".join(out)


def _finish(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        text = []
        for t, edges in zip(p["text"], p["gone"]):
            if edges is not None:
                rest = t.split("\n")
                edge = np.zeros(sum(b.count(" ") + 1 for b in rest) + 1, bool)
                edge[edges] = True
                t = _unique_runs(rest, np.logical_xor.accumulate(edge)[:-1])
            text.append(t)
        yield pd.DataFrame({"k": p["k"], "u": p["u"], "text": text})


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html",
              length: int = MIN_TOKENS, shard_tokens: int = SHARD_TOKENS, share: float = SHARE) -> DataFrame:
    """One row per row of ``pages``: key, url, text, n_chars.

    Null and empty html gives an empty text. A page whose url names no host (null, or no
    ``//``) belongs to the host of all such pages. Repeated rows, and other pages of a host with
    equal texts, count as one page and get the same tokens. An empty table gives an empty result.
    """
    rows = text_batches(pages).select(
        F.col(key).alias("k"), F.col(url).alias("u"), F.col(page).alias("h"),
        F.coalesce(F.lower(F.regexp_extract(url, r"//([^/?#:]+)", 1)), F.lit("")).alias("host"))
    kinds = dict(rows.dtypes)
    # pages are parsed again for each use, so that their texts are not written; a stream moves once, to its shard
    kind = "host string, kind int, digest string, n bigint, stream string"
    sizes = rows.select("host", "h").mapInPandas(_streams(False), kind).groupBy("host", "kind", "digest").agg(F.max("n").alias("n"))
    need = lambda which: F.greatest(F.lit(MIN_PAGES), F.ceil(F.count_if(which) * share)).cast("bigint")
    # there are no more hosts of several shards than tokens / shard_tokens
    many = F.broadcast(stable(sizes.groupBy("host").agg(
        F.ceil(F.sum("n") / shard_tokens).cast("bigint").alias("shards"),
        need(F.col("kind") == OPEN_TEXT).alias("need_open"), need(F.col("kind") != FRAME).alias("need"),
        F.count_if(F.col("kind") != FRAME).alias("texts")).where("shards > 1").withColumn("few", F.expr(f"texts < shards * {SHARD_TEXTS}"))))
    streams = rows.select("host", "h").mapInPandas(_streams(True), kind).drop("n").join(many, "host", "left").select(
        "host", "kind", "digest", "stream", F.coalesce("shards", F.lit(1)).alias("shards"), F.coalesce("few", F.lit(False)).alias("few"),
        F.coalesce(F.pmod(F.xxhash64("digest"), F.col("shards")), F.lit(0)).alias("shard"))

    def dealt(x: DataFrame) -> DataFrame:
        return x.repartition("host", "shard").dropDuplicates(["host", "shard", "kind", "digest"])

    kind = "host string, kind int, digest string, gone array<int>, w array<bigint>"
    first = stable(dealt(streams).groupBy("host", "shard").applyInPandas(_decide(length, share), kind))
    named = first.where("w is not null").select("host", F.explode("w").alias("w")).distinct()
    again = stable(dealt(streams.join(F.broadcast(first.where("w is not null").select("host").distinct()), "host", "left_semi")))

    def to_shards(windows: DataFrame) -> DataFrame:
        return windows.join(many, "host").select("host", "w", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard")).groupBy("host", "shard")

    counts = again.groupBy("host", "shard").cogroup(to_shards(named)).applyInPandas(
        _count(length), "host string, w bigint, open bigint, declared bigint, frame bigint")
    sums = counts.groupBy("host", "w").agg(*(F.sum(c).alias(c) for c in ("open", "declared", "frame")))
    sums = sums.join(many, "host")
    shared = sums.where(_boilerplate(sums, F.col("need_open"), F.col("need"))).select("host", "w")
    met = again.groupBy("host", "shard").cogroup(to_shards(shared)).applyInPandas(_meet(length), kind)
    masks = stable(first.where("w is null").union(met).select("host", "kind", "digest", "gone"))
    texts = rows.mapInPandas(_texts, f"k {kinds['k']}, u {kinds['u']}, host string, kind int, digest string, text string")
    return texts.join(masks, ["host", "kind", "digest"], "left").mapInPandas(
        _finish, f"k {kinds['k']}, u {kinds['u']}, text string").select(
        F.col("k").alias(key), F.col("u").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
