"""Cumulative-link regression on hashed features: the fit that the text classifiers share.

Rows are (key, grade, features): sorted hashed feature numbers, each counted once. The fit
runs on a bounded sample of labelled rows; everything that is scored later is not bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.session import stable

#: Labelled rows used for a fit, chosen by a hash of their key.
SAMPLE_ROWS = 20_000
#: Features are hashed into this many numbers.
BUCKETS = 1 << 18


@dataclass
class Model:
    """Weights by feature number, and the ordered thresholds between the grades."""

    weight: dict[int, float]
    cut: np.ndarray

    def tail(self, eta: np.ndarray, grade: int = 1) -> np.ndarray:
        """Probability of ``grade`` or more."""
        return 1 / (1 + np.exp(np.clip(self.cut[grade - 1] - eta, -50, 50)))

    def expected(self, eta: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the tail probabilities."""
        return sum(self.tail(eta, g) for g in range(1, len(self.cut) + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` joined with ``grade`` for at most ``rows`` labelled keys; the highest grade of a repeated key counts.

    The chosen keys are at most ``rows`` pairs of numbers, which bounds the broadcast.
    """
    chosen = labels.where(f"{grade} is not null and {key} is not null").groupBy(key).agg(F.max(grade).alias(grade))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(rows)
    return docs.join(F.broadcast(stable(chosen)), key)


def select(rows: DataFrame, grade: str, least_z: float = 3.0, least_rows: int = 3) -> np.ndarray:
    """Sorted feature numbers whose rows' mean grade differs from the overall mean by ``least_z`` standard errors."""
    n, mean, sd = rows.agg(F.count(F.lit(1)), F.avg(grade), F.stddev_pop(grade)).first()
    if not n or not sd:
        return np.empty(0, np.int64)
    f = rows.select(grade, F.explode("features").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.sum(grade).alias("s"))
    z = F.abs(F.col("s") - mean * F.col("n")) / (sd * F.sqrt("n"))
    kept = f.where((F.col("n") >= least_rows) & (z >= least_z)).select(F.col("f").cast("bigint").alias("f"))
    return np.sort(kept.toPandas()["f"].to_numpy(np.int64))  # at most BUCKETS numbers


def fit(rows: DataFrame, grade: str, least_z: float = 3.0, l2: float = 1.0, steps: int = 400) -> Model:
    """Fit the rows of a bounded sample. Without rows, or with one grade, every score is the prior."""
    kept = select(rows, grade, least_z)

    def shrunk(parts):
        for p in parts:
            p["features"] = [np.asarray(x)[np.isin(x, kept)] for x in p["features"]]
            yield p

    kind = f"{grade} int, features array<int>"
    d = rows.select(F.col(grade).cast("int").alias(grade), "features").mapInPandas(shrunk, kind).toPandas()
    y = d[grade].to_numpy(np.int64) if len(d) else np.zeros(0, np.int64)
    k = max(2, int(y.max(initial=0)) + 1)
    size = np.array([len(x) for x in d["features"]], np.int64)
    col = np.searchsorted(kept, np.concatenate([np.asarray(x, np.int64) for x in d["features"]] or [kept[:0]]))
    row = np.repeat(np.arange(len(y)), size)
    share = np.array([(y < g).sum() + 0.5 for g in range(1, k)]) / (len(y) + 1)
    base = np.log(share / (1 - share))
    # thresholds: the first one, then logs of the gaps, so that they stay ordered
    p = np.concatenate([np.zeros(len(kept)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v, nf = np.zeros_like(p), np.zeros_like(p), len(kept)

    def cuts(p):
        return np.cumsum(np.concatenate([p[nf: nf + 1], np.exp(p[nf + 1:])]))

    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, steps + 1 if len(y) else 1):
        c = cuts(p)
        eta = np.bincount(row, weights=p[col], minlength=len(y))
        hi = np.where(y < k - 1, sig(np.append(c, 0)[y] - eta), 1.0)
        lo = np.where(y > 0, sig(np.append(0, c)[y] - eta), 0.0)
        prob = np.maximum(hi - lo, 1e-12)
        d_eta = hi + lo - 1
        d_cut = (np.bincount(y, weights=hi * (1 - hi) / prob, minlength=k)[: k - 1]
                 - np.bincount(y, weights=lo * (1 - lo) / prob, minlength=k)[1:])
        tail = np.cumsum(d_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=d_eta[row], minlength=nf) - l2 * p[:nf], tail[:1], tail[1:] * np.exp(p[nf + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return Model(dict(zip(kept.tolist(), p[:nf].tolist())), cuts(p))
