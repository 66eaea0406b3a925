"""Quality rules of documents and of their hosts, in DataFrame functions only.

Every document is measured by base rules. The failures are summed by host, each host's
failure rate is drawn towards the rate of all hosts by a beta prior fitted to the hosts
themselves (method of moments), and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import SPACE, unused
from courtlens.session import stable

#: A host goes when more than this part of its documents is expected to fail.
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``: evaluated once, wherever the optimiser moves the expression."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# Texts without a repeated window, by a hash set, are done. In the others windows sorted by hash
# with their place have equal ones as neighbours; the places of repeated windows, sorted again,
# cover three words each less their overlap.
_HASHES = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
_SORTED = "array_sort(transform(h, (x, i) -> struct(x as h, i as p)))"
_PLACES = ("array_sort(filter(transform(s, (x, i) -> if((i > 0 and s[i - 1].h = x.h)"
           " or (i + 1 < size(s) and s[i + 1].h = x.h), x.p, null)), p -> p is not null))")
_COVERED = _let(_SORTED, "s", _let(_PLACES, "q", (
    "aggregate(q, struct(0L as n, -3 as last),"
    " (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)")))
_REPEATED = ("if(size(w) < 4, 0L, " + _let(_HASHES, "h", f"if(size(array_distinct(h)) = size(h), 0L, {_COVERED})") + ")")
_MEASURES = _let("{words}", "w", _let(
    "struct(cast(size(w) as bigint) as n_words, aggregate(w, 0L, (c, x) -> c + length(x)) as word_chars,"
    " " + _REPEATED + " as n_repeat_words)", "m",
    "struct(m.n_words as n_words, m.word_chars as word_chars, m.n_repeat_words as n_repeat_words,"
    f" m.n_words < {MIN_WORDS} or 100 * m.n_repeat_words > {REPEAT_PERCENT} * m.n_words as base_failed)"))
_TRIM = r"trim(both ' \t\n\u000B\u000C\r' from coalesce(`{text}`, ''))"
_SPLIT = _let(_TRIM, "t", "if(t = '', cast(array() as array<string>), split(t, '" + SPACE.replace("\\", "\\\\") + "'))")


def word_measures(text: str) -> Column:
    """Struct of n_words, word_chars, n_repeat_words and base_failed.

    A repeated word lies in a three-word window found twice or more, the first one included.
    """
    return F.expr(_MEASURES.replace("{words}", _SPLIT.format(text=text)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    again = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    return docs.withColumn("__m", word_measures(text)).withColumns({
        "n_words": F.col("__m.n_words"), "word_chars": F.col("__m.word_chars"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": again.cast("bigint"),
        "n_repeat_words": F.col("__m.n_repeat_words"), "base_failed": F.col("__m.base_failed"),
    }).drop("__m")


def host_verdicts(rows: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: docs, failed, host_rate (shrunk) and host_failed.

    ``rows`` holds a boolean base_failed. With rates r of n documents each, mean m and
    variance v over the hosts, the prior has strength m (1 - m) / (v - noise) - 1, where
    noise is what counting alone adds; it is held between 1 and a million.
    """
    hosts = rows.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("bigint")).alias("host_failed_docs"),
    ).withColumn("r", F.col("host_failed_docs") / F.col("host_docs"))
    hosts = stable(hosts)
    prior = hosts.agg(
        F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.avg(1 / F.col("host_docs")).alias("u"),
    ).select("m", F.expr("greatest(1D, least(1e6D, m * (1 - m) / greatest(v - m * (1 - m) * u, 1e-12D) - 1))").alias("s"))
    one = prior.first()
    m, s = one["m"], one["s"]
    if m is None:
        m, s = 0.0, 1.0
    rate = (F.col("host_failed_docs") + m * s) / (F.col("host_docs") + s)
    return stable(hosts.select("host", "host_docs", "host_failed_docs", rate.alias("host_rate"),
                               (rate > limit).alias("host_failed")))


def judged(rows: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``rows`` (with base_failed) with host_docs, host_rate, host_failed and kept; read twice."""
    # the hosts are a written table: a small one is broadcast by its known size, a large one is joined by shuffle
    hosts = host_verdicts(rows.select(F.col(host), "base_failed"), host, limit).withColumnRenamed("host", "__host")
    return rows.join(hosts, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host").withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: key, host, the measures, the host's figures and kept.

    Null text counts as empty, so it fails; a null host is a host of its own; a host of one
    document leans on the prior; repeated rows count as often as they stand; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(host).alias("host"), F.col(text).alias("t"))
    rows = judged(stable(measured(rows, "t").drop("t")), "host", limit)
    return rows.withColumnsRenamed({"k": key, "host": host})


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without rejected rows; columns stay as they are, whatever their names.

    Null and empty texts fail, a null host is a host of its own, repeated rows count and fare as often as they stand.
    """
    m = docs.select(F.col(host).alias("host"), word_measures(text)["base_failed"].alias("base_failed"))
    failed, = unused(docs, "failed_host")
    hosts = host_verdicts(m, "host").where("host_failed").select(F.col("host").alias(failed))
    return docs.where(~word_measures(text)["base_failed"]).join(
        hosts, F.col(host).eqNullSafe(F.col(failed)), "left_anti")
