"""Language of a text by rank-order profiles of letter n-grams.

A profile is the list of a language's most frequent n-grams of one to three letters, words
being padded with a space. A document's own list is compared with each profile: every n-gram
adds the distance of its two ranks, or the length of the profile where it is missing there.
The language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.common import fold, text_batches

#: Length of a profile.
RANKS = 400
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """All n-grams of one to three letters as numbers of 21 bits a character, in text order."""
    u = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    c = np.where(_letters()[u], u, 32)
    c = np.concatenate([[32], c, [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]]) if len(c) > 1 else c[:0]


def ranked(codes: np.ndarray, k: int = RANKS) -> np.ndarray:
    """The k most frequent numbers, most frequent first, smaller ones first among equals."""
    code, n = np.unique(codes, return_counts=True)
    if len(code) > k:  # all that reach the k-th count
        least = np.partition(n, len(n) - k)[len(n) - k]
        code, n = code[n >= least], n[n >= least]
    return code[np.lexsort((code, -n))][:k]


def _counts(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        for lang, texts in p.groupby("lang")["t"]:
            held, size = [], 0
            found: list = []
            for t in texts:
                held.append(grams(t))
                size += len(held[-1])
                if size > 2_000_000:
                    found.append(np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
            if held:
                found.append(np.unique(np.concatenate(held), return_counts=True))
            for code, n in found:
                yield pd.DataFrame({"lang": lang, "g": code, "n": n})


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", k: int = RANKS) -> dict[str, np.ndarray]:
    """Profile of every language of ``docs``: k numbers for each come to the driver.

    Counts cover all rows; tasks add up their own rows first. The k best are chosen within
    parts of each language before they meet.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("t"))
    n = rows.mapInPandas(_counts, "lang string, g bigint, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("g")]
    part = W.partitionBy("lang", F.pmod(F.xxhash64("g"), F.lit(64))).orderBy(*order)
    n = n.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    n = n.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("r") <= k)
    found = n.select("lang", "g", "r").toPandas().sort_values(["lang", "r"])
    return {x: p["g"].to_numpy(np.int64) for x, p in found.groupby("lang")}


def predictor(known: dict[str, np.ndarray], k: int = RANKS):
    """Column function from text to (lang_pred, score): score is 1 less the share of the largest possible distance."""
    names = sorted(known)
    union = np.unique(np.concatenate([known[x] for x in names])) if names else np.empty(0, np.int64)
    rank = np.full((len(union) + 1, max(1, len(names))), -1, np.int64)
    for j, x in enumerate(names):
        rank[np.searchsorted(union, known[x]), j] = np.arange(len(known[x]))

    def best(text: str | None) -> tuple[str, float]:
        own = ranked(grams(text), k)
        if not names or not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        at = np.where(union[at] == own, at, len(union))
        there = rank[at]
        far = np.where(there < 0, k, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        j = int(far.argmin())
        return names[j], float(1 - far[j] / (k * len(own)))

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) for t in texts], columns=["lang_pred", "score"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.pandas_udf(run, kind)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of every row; learns from all folds of four but fold 2.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when
    nothing can be learnt. Equal distances go to the first language in order of names. Null
    keys are in no fold and are not learnt from; repeated rows count as often as they stand.
    """
    known = profiles(text_batches(docs).where((fold(key, 4) != 2) & F.col(key).isNotNull()), text, lang)
    rows = docs.select(key, predictor(known)(F.col(text)).alias("x"))
    return rows.select(key, (fold(key, 4) == 2).alias("held_out"), "x.lang_pred", "x.score")
