"""Quality of texts by ordinal cumulative-link regression on graded ratings.

One set of weights on hashed text features is shared by all grades; ordered thresholds cut
the scale into grades. The model gives the expected grade, and the probability of a grade
or better, by which texts are selected.

Features, each counted once: words, word shapes (letter case, digits and signs, repetitions
folded), pairs of neighbouring shapes, and size classes of the shares of repeated words,
capitals and signs and of the length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm import linear
from courtlens.llm.common import fold, text_batches
from courtlens.session import stable

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+")
_AGAIN = re.compile(r"([^Aa9])\1+")
#: Bounds of the size classes of a share.
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def shape(word: str) -> str:
    """``Of%%%`` becomes ``Aa%``: runs of letters, digits and equal signs are folded."""
    s = _LOWER.sub("\x01", word)
    s = _DIGIT.sub("9", _UPPER.sub("A", s)).replace("\x01", "a")
    return _AGAIN.sub(r"\1", s)[:24]


def _id(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % linear.BUCKETS


def _size(share: float) -> int:
    return sum(share > s for s in SHARES)


class Features:
    """Feature numbers of texts; those of words and shapes are kept up to a bound."""

    def __init__(self, wanted: Callable[[int], bool] = lambda f: True, keep: int = 150_000):
        self.wanted, self.keep = wanted, keep
        self.words: dict[str, tuple] = {}
        self.pairs: dict[tuple, tuple] = {}

    def _word(self, w: str) -> tuple[str, tuple]:
        if len(self.words) >= self.keep:
            self.words.clear()
        s = shape(w)
        ids = [_id("s", s)] + ([_id("w", w.lower().strip(".,;:!?"))] if len(w) <= 40 else [])
        got = self.words[w] = (s, tuple(f for f in ids if self.wanted(f)))
        return got

    def __call__(self, text: str | None) -> list[int]:
        words = (text or "").split()
        n = len(words)
        known = {w: self.words.get(w) or self._word(w) for w in set(words)}
        found = {f for _, ids in known.values() for f in ids}
        shapes = [known[w][0] for w in words]
        for p in set(zip(shapes, shapes[1:])):
            ids = self.pairs.get(p)
            if ids is None:
                if len(self.pairs) >= self.keep:
                    self.pairs.clear()
                f = _id("p", f"{p[0]} {p[1]}")
                ids = self.pairs[p] = (f,) if self.wanted(f) else ()
            found.update(ids)
        again = sum(a == b for a, b in zip(words, words[1:]))
        capitals = sum(s[:2] in ("A", "A!", "A.", "A,") for s in shapes)
        signs = sum(not s[-1].isalnum() and s[-1] not in ".,;:" for s in shapes)
        for name, share in (("again", again), ("capital", capitals), ("sign", signs)):
            f = _id(name, str(_size(share / n if n else 0.0)))
            if self.wanted(f):
                found.add(f)
        f = _id("length", str(int(math.log2(n + 1))))
        if self.wanted(f):
            found.add(f)
        return sorted(found)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    features = Features()
    for texts in parts:
        yield pd.Series([features(t) for t in texts], dtype=object)


def rated(labels: DataFrame) -> DataFrame:
    """Labels with grades: 0 for low quality, 1 for good but toxic, 2 for good and clean; others null."""
    q, x = F.col("quality"), F.coalesce("toxic", F.lit(0))
    return labels.withColumn("grade", F.when(q == 0, 0).when(q == 1, F.when(x == 1, 1).otherwise(2)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade",
          rows: int = linear.SAMPLE_ROWS) -> linear.Model:
    """Fit on at most ``rows`` labelled rows; grades are integers from 0, any number of them."""
    sample = linear.labelled_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")),
                                    labels.select(F.col(key).alias("k"), F.col(grade).cast("int").alias("y")), "y", "k", rows)
    return linear.fit(stable(sample.dropDuplicates(["t", "y"]).select("y", _features("t").alias("features"))), "y")


def scorer(model: linear.Model) -> Callable[[Column], Column]:
    """Column function from text to (expected_grade, tails): tails[g - 1] is the probability of grade g or more."""
    grades = range(1, len(model.cut) + 1)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features(model.weight.__contains__)
        for texts in parts:
            eta = np.array([sum(model.weight[f] for f in features(t)) for t in texts], float)
            tails = np.stack([model.tail(eta, g) for g in grades], axis=1)
            yield pd.DataFrame({"expected_grade": model.expected(eta), "tails": list(tails)})

    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()),
                         T.StructField("tails", T.ArrayType(T.DoubleType()))])
    return F.pandas_udf(run, kind)


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, expected_grade, score and predicted of every row; learns from folds 0 and 2 of three.

    score is the probability of grade 1 or more, that is of good quality, and predicted is 1
    from one half on. Null and empty texts are scored by their length class alone; null keys
    are not learnt from; repeated rows are scored as often as they stand; without usable
    labels every row gets the prior.
    """
    docs = text_batches(docs)
    model = train(docs, rated(labels.where(fold(key, 3) != 1)), key, text)
    rows = docs.select(key, scorer(model)(F.col(text)).alias("x"))
    return rows.select(key, (fold(key, 3) == 1).alias("held_out"), "x.expected_grade", F.col("x.tails")[0].alias("score"),
                       (F.col("x.tails")[0] >= 0.5).cast("int").alias("predicted"))
