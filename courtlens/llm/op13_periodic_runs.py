"""Periodic runs of words, found by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q, at least ``3 * q`` and ``min_words``
words long, that no neighbouring word extends with the same period.

* At the scale s every stretch of s words has a hash. A place is *selected* when, of the
  hashes at the s + 1 places from it on, the smallest is the first or the last. That depends
  on the next 2 s words alone, so equal contexts are selected alike wherever they stand.
* Stretches whose own period is a third of s or less take no part. They are the inside of runs
  that the smaller scales have found, so each scale reads them off those runs; periods
  1 to 3 are read off the text itself.
* A run of period p, 2 s <= p < 4 s, holds a selected place x with x + p selected and the same
  2 s words at both. (In any 3 s - 1 words that no period of s / 3 rules, one of the first s
  places is selected; a run of three periods has such a place early enough that its twin, a
  period on, still sees 2 s words of the run.) So the selected places with equal contexts
  propose p. Places with equal contexts are more than s / 3 apart, so a place has
  at most twelve partners within 4 s: the work of a scale is in proportion to the text, and a
  text has as many scales as its length has doublings.
* A proposal that block hashes do not rule out is extended word by word to both sides, so hashes
  decide where to look and never what is a run. A run found with a period of which a smaller one
  rules the same stretch is the same run and keeps the smaller one.

A text is one row of one task: the texts of a task go through in lots of ``LOT`` words, the
longest first, so the larger scales only touch the texts that are long enough for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.common import text_batches

MIN_WORDS = 24
#: Words of texts that are searched together; a longer text is a lot of its own.
LOT = 500_000
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_NONE = np.uint64(2**64 - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _stretch(t: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The longest stretch round t[x: x + p] whose words are the same p apart."""
    lo, hi, size = x, x, 64
    while hi + p < len(t):
        n = min(size, len(t) - p - hi)
        other = np.flatnonzero(t[hi: hi + n] != t[hi + p: hi + p + n])
        hi += int(other[0]) if len(other) else n
        if len(other):
            break
        size *= 2
    size = 64
    while lo:
        n = min(size, lo)
        other = np.flatnonzero(t[lo - n: lo] != t[lo - n + p: lo + p])
        lo -= n - 1 - int(other[-1]) if len(other) else n
        if len(other):
            break
        size *= 2
    return lo, hi + p


def _selected(h: np.ndarray, s: int, inside: list[tuple[int, int]]) -> np.ndarray:
    """Selected places at scale s, h being the hashes of s words; ``inside`` are periodic stretches."""
    h = h >> np.uint64(1)
    for a, b in inside:
        h[a: b - s + 1] = _NONE
    low, w = h, 1
    while w < s:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    low = np.minimum(low[:-1], low[1:])
    n = len(low)
    return np.flatnonzero((low != _NONE) & ((low == h[:n]) | (low == h[s: s + n])))


def _proposals(at: np.ndarray, context: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of selected places with equal contexts, 2 s to 4 s apart."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    x, d, live, lag = [at[:0]], [at[:0]], np.arange(len(at)), 1
    while len(live):
        live = live[live + lag < len(at)]
        gap = at[live + lag] - at[live]
        near = (context[live] == context[live + lag]) & (gap < 4 * s)
        live, gap = live[near], gap[near]
        x.append(at[live[gap >= 2 * s]])
        d.append(gap[gap >= 2 * s])
        lag += 1
    return np.concatenate(x), np.concatenate(d)


def _promising(x: np.ndarray, d: np.ndarray, h: np.ndarray, s: int) -> np.ndarray:
    """Whether the blocks of s words round x agree with those d on far enough for three periods."""
    def blocks(step: int) -> np.ndarray:
        on, n = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for i in range(8):
            a = x + (2 + i if step > 0 else -1 - i) * s
            fits = (a >= 0) & (a + d < len(h))
            a = np.where(fits, a, 0)
            on &= fits & (h[a] == h[np.where(fits, a + d, 0)])
            n += on
        return n
    return (2 + blocks(1) + blocks(-1) + 2) * s > 2 * d


def find_runs(t: np.ndarray, longest: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in t.

    t holds the word numbers of texts, each text followed by a number that stands nowhere else;
    ``longest`` holds their lengths, in falling order.
    """
    found: dict[tuple[int, int], int] = {}
    for p in (1, 2, 3):
        same = np.concatenate([[0], t[p:] == t[:-p], [0]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - a >= 2 * p:
                found.setdefault((a, e + p), p)
    ends, h, s = np.cumsum(longest + 1), _mixed((t.astype(np.uint64) + np.uint64(1)) * _A), 1
    while True:
        n = int(np.searchsorted(-longest, -12 * s, "right"))   # texts that hold three periods of the next scale
        if not n:
            break
        size = int(ends[n - 1])
        h = h[: size - s + 1]
        h, s = _mixed(h[:-s] ^ (h[s:] * _A)), 2 * s
        inside = [r for r, p in found.items() if 3 * p <= s and r[1] - r[0] >= s and r[1] <= size]
        at = _selected(h, s, inside)
        x, d = _proposals(at, _mixed(h[at] ^ (h[at + s] * _A)), s)
        ok = _promising(x, d, h, s)
        x, d = x[ok], d[ok]
        order = np.lexsort((x, d))
        last, until = 0, 0
        for at, p in zip(x[order].tolist(), d[order].tolist()):
            if p == last and at + p < until:
                continue   # inside the stretch just extended
            a, until = _stretch(t, at, p)
            last = p
            if until - a >= 3 * p:
                found.setdefault((a, until), p)
    return sorted((a, b, p) for (a, b), p in found.items() if b - a >= min_words)


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _word_numbers(text: bytes, known: _Numbers, size: int = 4_000_000) -> np.ndarray:
    """Numbers of the words of a text, which is split piece by piece."""
    out, at = [], 0
    while at < len(text):
        cut = _GAP.search(text, at + size)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _lot(ids: list[np.ndarray], names: list[bytes], min_words: int) -> Iterator[tuple[list[dict], bytes]]:
    """(runs, collapsed text) of every text of a lot."""
    size = np.array([len(i) for i in ids])
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= min_words]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    if len(order):
        t = np.concatenate([np.append(ids[d], len(names) + d) for d in order])
        start = np.concatenate([[0], np.cumsum(size[order] + 1)])
        for a, b, p in find_runs(t, size[order], min_words):
            d = int(np.searchsorted(start, a, "right")) - 1
            runs.setdefault(int(order[d]), []).append((a - int(start[d]), b - a, p))
    for d, own in enumerate(ids):
        found = sorted(runs.get(d, []), key=lambda r: (r[0], r[2]))
        keep = np.ones(len(own), bool)
        for a, n, p in found:
            keep[a + p: a + n] = False
        yield ([{"start": a, "length": n, "period": p} for a, n, p in found],
               b" ".join(map(names.__getitem__, own[keep].tolist())))


def search(texts: list[bytes | None], min_words: int = MIN_WORDS, lot: int = LOT) -> Iterator[tuple[list[dict], bytes]]:
    """(runs, collapsed text) of every text, lot by lot."""
    ids, words, known = [], 0, _Numbers()
    for text in texts:
        ids.append(_word_numbers(text or b"", known))
        words += len(ids[-1])
        if words >= lot:
            yield from _lot(ids, list(known), min_words)
            ids, words, known = [], 0, _Numbers()
    if ids:
        yield from _lot(ids, list(known), min_words)


def periodic_runs(docs: DataFrame, text: Column | str = "text", min_words: int = MIN_WORDS,
                  found: str = "found") -> DataFrame:
    """``docs`` with one more column ``found``: a struct of ``runs`` and ``collapsed``.

    ``runs`` is an array of (start, length, period) in words from 0, by start and then period.
    ``collapsed`` is the words joined by single spaces, without those that a run holds
    after its first period. Null and empty texts have no runs and collapse to the empty text.
    Rows that repeat are searched each for itself, an empty table stays empty. ``docs`` may have
    any columns; only one called ``found`` is refused.
    """
    if found in docs.columns:
        raise ValueError(f"the table has a column {found} already; name another for the result")

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = list(search(texts.tolist(), min_words))
            yield pd.DataFrame({"runs": pd.Series([r[0] for r in rows], dtype=object),
                                "collapsed": pd.Series([r[1].decode() for r in rows], dtype=object)})

    one = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    kind = T.StructType([T.StructField("runs", T.ArrayType(one)), T.StructField("collapsed", T.StringType())])
    body = (F.col(f"`{text}`") if isinstance(text, str) else text).cast("binary")
    return text_batches(docs).withColumn(found, F.pandas_udf(run, kind)(body))


def _planted(texts: pd.Series, g: pd.Series) -> pd.Series:
    """Texts whose words from a on become the first p of them over and over; null where g is."""
    out = []
    for text, x in zip(texts, g):
        words = text.split() if text is not None and x == x else []
        if words:
            a = int(x) % len(words)
            p = 1 + (len(words) - a) // (3 + int(x) % 8)
            words[a:] = [words[a + i % p] for i in range(len(words) - a)]
        out.append(b" ".join(words).decode() if words else None)
    return pd.Series(out, dtype=object)


def planted(key: str, text: str) -> Column:
    """The text with a tail that repeats in every tenth document, as the query asks.

    With h the crc32 of the key as text and g = h div 10, the n words of a document with h mod 10 = 0 from
    a = g mod n on repeat with period p = 1 + (n - a) div (3 + g mod 8).
    Other texts, and those of null keys, stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    plant = F.pandas_udf(_planted, T.StringType())
    chosen = F.when(h % 10 == 0, F.floor(h / 10))
    return F.coalesce(plant(F.when(h % 10 == 0, F.col(text)).cast("binary"), chosen), F.col(text))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of every row.

    The four numbers are those of the run with the greatest length / period (the first of
    equals), null without a run. Nulls, empty texts and repeats as in :func:`periodic_runs`.
    """
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    d = periodic_runs(d.select("k", planted("k", "t").alias("t")), "t")
    best = F.expr("aggregate(found.runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (m, r) ->"
                  " if(m is null or r.length * m.period > m.length * r.period, r, m))")
    lines = F.array_join(F.transform("found.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    d = d.select("k", F.size("found.runs").cast("bigint").alias("n_runs"), best.alias("b"),
                 F.when(F.size("found.runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("r"), "found.collapsed")
    return d.select(
        F.col("k").alias(key), "n_runs", "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.col("r").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
