"""Toxicity of texts after a noisy-channel decoding of disguised spellings.

1. Runs of four letters are counted over all documents (one small table per task, then summed).
2. Tokens that hold digits or signs among letters, long repetitions, and runs of single
   letters become character lattices. A sign may stand for a letter, a separator may be
   dropped, a repeated letter may be one or two; Viterbi finds the most probable reading
   under that letter model.
3. Words of the restored text, and their beginnings, are the hashed features of a logistic
   model (the two-grade case of the cumulative-link fit), fitted on a bounded labelled sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm import linear
from courtlens.llm.common import fold, text_batches, unused
from courtlens.session import stable

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
#: Log probabilities of the channel: a sign for a letter, a dropped separator, a sign that ends
#: a word, a dropped sign that could be a letter, a doubled letter read as one.
SUBSTITUTED, DROPPED, BROKEN, LOST, HALVED = -1.0, -1.0, -10.0, -16.0, -4.0
#: Letter classes: 0 word boundary, 1 to 26 a to z, 27 any other letter.
CLASSES = 28
REJECT = 0.7

_EDGE = re.compile(r"^[^\w@$!+|*(€£]+|[\W_]+$")
_REPEAT = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s.,;:]\s){3,}[^\s.,;:](?![^\s.,;:!?])")
_RUN = re.compile(r"(.)\1*", re.S)


def letter_class(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 if c.isalpha() else 0


_TABLE = np.array([letter_class(chr(i)) for i in range(0x3000)], np.int64)


def _lots(parts, size: int = 500_000) -> Iterator[str]:
    """All texts in lots of about ``size`` characters; a longer text is cut, and a cut counts as a word boundary."""
    held, n = [], 0
    for p in parts:
        for t in p["t"]:
            for at in range(0, len(t or ""), size):
                held.append(t[at: at + size])
                n += len(held[-1])
                if n >= size:
                    yield "\n".join(held)
                    held, n = [], 0
    yield "\n".join(held)


def _count(parts):
    total = np.zeros(CLASSES ** 4, np.int64)
    for t in _lots(parts):
        u = np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4")
        c = np.where(u < len(_TABLE), _TABLE[np.minimum(u, len(_TABLE) - 1)], 27)
        c = np.concatenate([[0, 0, 0], c, [0]])
        # what stands before a boundary does not matter
        one, two, three = c[2:-1], c[1:-2], c[:-3]
        two = np.where(one == 0, 0, two)
        three = np.where(two == 0, 0, three)
        total += np.bincount(((three * CLASSES + two) * CLASSES + one) * CLASSES + c[3:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pd.DataFrame({"g": at, "n": total[at]})


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(d | a b c) of letter classes over all texts, interpolated with lower orders.

    Each task sends at most 28^4 sums, and so many come to the driver.
    """
    sums = docs.select(F.col(text).alias("t")).mapInPandas(_count, "g bigint, n bigint").groupBy("g").agg(
        F.sum("n").alias("n")).toPandas()
    n = np.zeros(CLASSES ** 4)
    n[sums["g"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    n = n.reshape((CLASSES,) * 4)
    n[0, 0, 0, 0] = 0
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + CLASSES)
    for order in ((0, 1), (0,), ()):
        c = n.sum(order)
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """Readings of a run of n equal characters, with their channel costs."""
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c, HALVED if n == 2 else 0.0), (c * 2, 0.0)]
    if c.isspace():
        return [("", 0.0), (" ", -3.0)]
    found = [(x * k, SUBSTITUTED) for x in LEET.get(c, "") for k in range(1, min(n, 2) + 1)]
    return found + [("", DROPPED if c not in LEET else LOST), (" ", BROKEN)]


def decode(token: str, model: list) -> str:
    """Most probable reading of a lower-case token; words it falls into are split by spaces."""
    best = {(0, 0, 0): (0.0, None)}
    for run in _RUN.finditer(token):
        c, n = run.group(1), len(run.group())
        step: dict = {}
        for (x, y, z), (score, path) in best.items():
            for out, cost in _options(c, n):
                s, a, b, d = score + cost, x, y, z
                for ch in out:
                    k = letter_class(ch)
                    if k or d:
                        s += model[a][b][d][k]
                    a, b, d = (b, d, k) if k else (0, 0, 0)
                if (a, b, d) not in step or s > step[a, b, d][0]:
                    step[a, b, d] = (s, (path, out))
        best = step
    ends = [(s + (model[a][b][d][0] if d else 0.0), path) for (a, b, d), (s, path) in best.items()]
    path, out = max(ends, key=lambda e: e[0])[1], []
    while path:
        path, piece = path
        out.append(piece)
    return "".join(reversed(out))


class Restorer:
    """Words of the restored text; readings of tokens are kept up to a bound."""

    def __init__(self, model: np.ndarray, keep: int = 100_000):
        self.model, self.keep, self.seen = model.tolist(), keep, {}

    def token(self, t: str) -> tuple[str, ...]:
        got = self.seen.get(t)
        if got is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            core = _EDGE.sub("", t)
            tail = t[t.rfind(core) + len(core):] if core else ""
            if len(tail) == 1 and tail in "+$@|":
                core += tail
            if core.isalpha() and not _REPEAT.search(core):
                got = (core,)
            elif any(c.isalpha() for c in core):
                got = tuple(decode(core, self.model).split())
            else:
                got = ()
            self.seen[t] = got
        return got

    def words(self, text: str) -> set[str]:
        """Distinct restored words of the whole text."""
        low = text.lower()
        found = {w for t in set(low.split()) for w in self.token(t)}
        for run in _SPACED.finditer(low):
            found.update(w for w in decode(run.group(), self.model).split() if len(w) > 1)
        return found

    def text(self, text: str) -> str:
        """The restored text, for reading."""
        low = _SPACED.sub(lambda m: decode(m.group(), self.model), text.lower())
        return " ".join(w for t in low.split() for w in self.token(t))


def features(word: str) -> tuple[int, ...]:
    """Hashed numbers of a word: itself and its beginnings of three to five letters."""
    parts = [f"^{word}$", *(f"^{word[:n]}" for n in (3, 4, 5) if len(word) > n)]
    return tuple(zlib.crc32(p.encode()) % linear.BUCKETS for p in parts) if len(word) > 2 else ()


def _column(letters: np.ndarray, per_text, kind: T.DataType):
    """A column function: what ``per_text`` makes of the restored words of a text."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(letters)
        known: dict[str, tuple] = {}
        for texts in parts:
            out = []
            for t in texts:
                got: set[int] = set()
                for w in restorer.words(t) if t else ():
                    f = known.get(w)
                    if f is None:
                        if len(known) >= 150_000:
                            known.clear()
                        f = known[w] = per_text.word(w)
                    if f:
                        got.update(f)
                out.append(per_text.row(got))
            yield pd.Series(out, dtype=per_text.dtype)

    return F.pandas_udf(run, kind)


class _Features:
    dtype = object
    word = staticmethod(features)
    row = staticmethod(sorted)


class _Score:
    dtype = float

    def __init__(self, model: linear.Model):
        self.model = model

    def word(self, w: str) -> tuple[int, ...]:
        return tuple(f for f in features(w) if f in self.model.weight)

    def row(self, found: set[int]) -> float:
        return float(self.model.tail(np.array([sum(self.model.weight[f] for f in sorted(found))]))[0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "toxic",
          rows: int = linear.SAMPLE_ROWS) -> tuple[np.ndarray, linear.Model]:
    """Letter model of all ``docs`` and the classifier fitted to at most ``rows`` rows of ``labels``."""
    letters = letter_model(text_batches(docs), text)
    sample = linear.labelled_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")),
                                    labels.select(F.col(key).alias("k"), F.col(grade).cast("int").alias("y")), "y", "k", rows)
    # copies of one text would make its rare words look telling
    find = _column(letters, _Features, T.ArrayType(T.IntegerType()))
    sample = sample.dropDuplicates(["t", "y"]).select("y", find("t").alias("features"))
    return letters, linear.fit(stable(sample), "y", l2=0.2)


def score_column(letters: np.ndarray, model: linear.Model):
    """Column function from text to the probability of toxicity; null and empty texts get the prior."""
    return _column(letters, _Score(model), T.DoubleType())


def report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row; learns from folds 0 and 2 of three.

    Null keys are in no fold and are not learnt from; repeated rows are scored as often as
    they stand; without usable labels every score is the prior of one half.
    """
    letters, model = train(docs, labels.where(fold(key, 3) != 1), key, text)
    scored = docs.select(key, score_column(letters, model)(F.col(text)).alias("score"))
    return scored.select(key, (fold(key, 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= REJECT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without rows scored ``REJECT`` or more; columns stay as they are, whatever their names.

    Null and empty texts get the prior and stay unless that rejects; repeated rows fare alike.
    """
    letters, model = train(docs, labels.where(fold(key, 3) != 1), key, text)
    score, = unused(docs, "score")
    scored = docs.withColumn(score, score_column(letters, model)(F.col(text)))
    return scored.where(F.col(score) < REJECT).select(*docs.columns)
