"""Repeated runs of lines removed by winnowing over line hashes, in DataFrame functions only.

Order: documents by key (null first), lines by place. What stands first stays. A line goes when
it lies in a run of lines with ``MIN_WORDS`` words or more that any earlier place holds too.

* Lines become hashes of their words. Lines without words belong to no run; they go with
  a window around them.
* Windows are the shortest runs of that many words from every line on, and up to every line.
  Every longer run is a union of its windows, its last lines included, so what windows find is
  the maximal run, whichever of several earlier places holds it.
* A gram is the shortest run from a line that holds half as many words. Of the grams inside a window
  the smallest hash is selected. Equal windows select equal grams, so every repeated run
  shares a fingerprint with its earlier place.
* Fingerprints are joined by position: only those that stand at two places or more go on.
* From such a position the match is extended to both sides by the windows that selected it,
  each against the first place that holds the same lines. The first place is enough: whatever
  another earlier place would remove of a window, the first one removes too.
* Later windows are deleted. Where one overlaps its own first place, only what lies beyond goes.

No pairs are made: each later window meets one first place. Keys with more than one row in
``HOT_PART`` are fewer than that many; they are broadcast, so no task gets all rows of such a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import SPACE, unused
from courtlens.session import stable

#: Words that a run needs to be a passage.
MIN_WORDS = 50
#: A key is hot when it holds more than one in this many rows.
HOT_PART = 1_000

_WORDS = f"filter(split(l, '{SPACE}'), w -> w <> '')".replace("\\", "\\\\")
_LINES = (
    "filter(transform(transform(split(t, '\\\\n'), l -> " + _WORDS + "),"
    " ws -> struct(xxhash64(ws) as h, size(ws) as n)), x -> x.n > 0)"
)
# lines that the gram and the window of line i take; no line has fewer than one word
_SPANS = (
    "transform(a, (x, i) -> aggregate(slice(a, i + 1, {m}), struct(0 as s, 0 as g, 0 as w),"
    " (c, y) -> struct(c.s + y.n as s, if(c.s < {half}, c.g + 1, c.g) as g, if(c.s < {m}, c.w + 1, c.w) as w),"
    " c -> struct(if(c.s >= {half}, c.g, null) as g, if(c.s >= {m}, c.w, null) as w)))"
)
_GRAMS = "transform(s, (x, i) -> if(x.g is null, null, xxhash64(transform(slice(a, i + 1, x.g), y -> y.h))))"
# (first line, last line, window hash, selected gram, place of that gram). The windows from line i end where it has
# enough words, and go on over the ends up to which line i + 1 has too few: those are the shortest up to these ends
_WINDOWS = (
    "flatten(transform(filter(s, x -> x.w is not null), (x, i) -> transform("
    "sequence(i + x.w - 1, greatest(i + x.w - 1, coalesce(i + get(s, i + 1).w, size(s)) - 1)), e -> struct(i as i, e as e,"
    " xxhash64(transform(slice(a, i + 1, e - i + 1), y -> y.h)) as c,"
    " array_min(transform(filter(sequence(i, e), j -> j + s[j].g <= e + 1), j -> struct(g[j] as f, j as j))) as sel))))"
)


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(k, i, e, c, f, j): the windows of all documents (k, t) with the fingerprint each selects."""
    m = {"m": min_words, "half": (min_words + 1) // 2}
    d = docs.select("k", F.expr(_LINES).alias("a"))
    d = d.withColumn("s", F.expr(_SPANS.format(**m))).withColumn("g", F.expr(_GRAMS))
    return d.select("k", F.explode(F.expr(_WINDOWS)).alias("x")).select(
        "k", "x.i", "x.e", "x.c", F.col("x.sel.f").alias("f"), F.col("x.sel.j").alias("j"))


def _join_spread(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``keys`` (one row for each, ``n`` rows of ``total`` in all), hot keys apart."""
    hot = F.broadcast(keys.where(F.col("n") * HOT_PART > total).drop("n"))
    rest = keys.where(F.col("n") * HOT_PART <= total).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))


def repeated_ranges(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, ranges): for documents (k, t) that hold later runs, the runs (lo, hi) to delete, as numbers of lines with words."""
    w = stable(_windows(docs, min_words))
    total = w.count()
    # fingerprints at one place only need no further look
    shared = stable(w.groupBy("f").agg(
        F.min(F.struct("k", "j")).alias("lo"), F.max(F.struct("k", "j")).alias("hi"), F.count(F.lit(1)).alias("n")
    ).where("lo <> hi").select("f", "n"))
    near = stable(_join_spread(w, shared, ["f"], total))
    first = stable(near.groupBy("f", "c").agg(
        F.min(F.struct("k", "i", "e")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = _join_spread(near, first, ["f", "c"], total).where("k <> o.k or i <> o.i")
    later = later.select("k", F.expr("if(k = o.k, greatest(i, o.e + 1), i)").alias("lo"), F.col("e").alias("hi"))
    return later.where("lo <= hi").groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                deleted: str | None = None, length: str | None = None) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from ``text``; every row stays.

    A text whose lines all go becomes empty; null stays null. Rows that repeat key and text
    are the same document and get the same result; rows that share a key but not the text
    are ordered by the hash of the text. ``deleted`` names a column for the count of lines cut, which is
    replaced where there is one, ``length`` a column of ``docs`` that holds the length of the text and follows it where lines are cut.
    """
    k, ranges, places, cut, n = unused(docs, "k", "ranges", "places", "cut", "n_cut")
    named = docs.withColumn(k, F.struct(F.col(key).alias("d"), F.xxhash64(F.col(text)).alias("h")))
    found = repeated_ranges(named.where(F.col(text).isNotNull()).select(F.col(k).alias("k"), F.col(text).alias("t")),
                            min_words)
    joined = named.join(found.select(F.col("k").alias(k), F.col("ranges").alias(ranges)), k, "left")
    # places from the first to the last line of a run, with the blank ones between
    lines = f"split(`{text}`, '\\\\n')"
    word = SPACE.replace("[", "[^", 1).rstrip("+").replace("\\", "\\\\")
    gone = F.expr(
        f"if({ranges} is null, null, element_at(transform(array(filter(transform({lines}, (l, p) -> if(l rlike '{word}', p, null)),"
        f" p -> p is not null)), ps -> array_distinct(flatten(transform({ranges}, r -> sequence(ps[r.lo], ps[r.hi]))))), 1))")
    kept = F.expr(
        f"if({places} is null, `{text}`, element_at(transform(array({lines}), ls ->"
        f" array_join(transform(array_except(sequence(0, size(ls) - 1), {places}), p -> ls[p]), '\\n')), 1))")
    joined = joined.withColumn(places, gone).withColumn(cut, kept)
    joined = joined.withColumn(n, F.coalesce(F.size(places), F.lit(0)).cast("bigint"))
    new = {text: F.col(cut)}
    if length:
        new[length] = F.when(F.col(n) > 0, F.length(cut).cast(dict(docs.dtypes)[length])).otherwise(F.col(length))
    if deleted:
        new[deleted] = F.col(n)
    more = [F.col(n).alias(deleted)] if deleted and deleted not in docs.columns else []
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns], *more)
