"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Distinct words of a batch are sorted by length, and words of equal length advance together,
one character at a time. The hashes of all substrings that end there probe the sorted
hashes of the pieces, and a vectorised maximum keeps the best way to every place.

* In a unigram model the best way is that of the largest sum of piece scores.
* In a merge model (BPE) a way counts when the merges give just these pieces. That holds for a
  row of pieces when it holds for every two neighbours, so each prefix has one way, and a
  step is scored 0 or minus infinity by the pair of pieces that it makes.

Characters without a piece become byte pieces where the model has them, else the unknown id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.common import text_batches

MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
#: Penalty of a character without a piece below the lowest score.
UNKNOWN_PENALTY = 10.0
ROWS = 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes of short strings, which are small numbers, over all 64 bits; different ones stay different."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at: at + size]
            at += size


class Vocabulary:
    """Pieces of a model with their sorted hashes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        trainer = dict(_fields(dict(_fields(model)).get(2, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.id_of = {self.text[i]: i for i in plain}
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        self.lowest = np.float32(min((float(self.score[i]) for i in plain), default=0.0) - UNKNOWN_PENALTY)
        self.longest = max((len(self.text[i]) for i in plain), default=1)
        self.power = np.full(self.longest + 1, _BASE, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        key = _mixed(np.array([self._hash(self.text[i]) for i in plain], np.uint64))
        order = np.argsort(key)
        self.key, self.piece = key[order], np.array(plain, np.int64)[order]
        # where the keys of each leading 16 bits begin, so that a probe looks at one short stretch of the sorted keys
        self.begin = np.searchsorted(self.key, np.arange(2**16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        self.begin = np.append(self.begin, np.int32(len(self.key)))
        # where no piece goes on behind a space mark, words can be split there
        inner = any("▁" in t.lstrip("▁") for t in self.id_of)
        self.words = re.compile(r"(?s:.+)" if inner else "▁+[^▁]*|[^▁]+").findall
        self.pairs: dict[int, bool] = {}
        self.pair, self.fit = np.array([-1], np.int64), np.array([False])
        mark = "▁".encode()
        self.out = [b"" if sp.is_control(i) else bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i)
                    else " ⁇ ".encode() if sp.is_unknown(i) else self.text[i].encode().replace(mark, b" ") for i in range(n)]
        normal = dict(_fields(dict(_fields(model)).get(3, b"")))
        self.prefix = bool(normal.get(3, 1))

    def _hash(self, s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return (h ^ (len(s) * int(_SALT) & (2**64 - 1))) & (2**64 - 1)

    def find(self, h: np.ndarray, size: int) -> np.ndarray:
        """Ids of the pieces with these hashes of substrings of one size, -1 where there is none."""
        h = _mixed(h ^ np.uint64(size * int(_SALT) & (2**64 - 1)))
        out = np.full(len(h), -1, np.int64)
        head = (h >> np.uint64(48)).astype(np.int32)
        at, end = self.begin[head], self.begin[head + 1]
        rows = np.flatnonzero(at < end)
        at, end, h = at[rows], end[rows], h[rows]
        while len(rows):
            same = self.key[at] == h
            out[rows[same]] = self.piece[at[same]]
            on = ~same & (at + 1 < end)
            rows, at, end, h = rows[on], at[on] + 1, end[on], h[on]
        return out

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = self.id_of.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or self.score[p] > best):
                    best, at = self.score[p], i
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges leave these neighbours as they are; left is -1 at the start of a word, -2 after an unknown."""
        code = (left + 2) * (len(self.text) + 1) + right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        ok, new = self.fit[at], np.flatnonzero(self.pair[at] != code)
        if len(new):
            some, back = np.unique(code[new], return_inverse=True)
            ok[new] = np.array([self._fits(c) for c in some.tolist()], bool)[back]
        return ok

    def _fits(self, code: int) -> bool:
        """One pair that is not among the sorted ones yet; they are taken up in lots."""
        ok = self.pairs.get(code)
        if ok is None:
            a, b = divmod(code, len(self.text) + 1)
            two = [self.text[b]] if a < 2 else [self.text[a - 2], self.text[b]]
            ok = self.pairs[code] = self.merged("".join(two)) == two
            if len(self.pairs) >= 4_000:
                pair = np.concatenate([self.pair, np.fromiter(self.pairs, np.int64)])
                fit = np.concatenate([self.fit, np.fromiter(self.pairs.values(), bool)])
                order = np.argsort(pair)[-2_000_000:]
                self.pair, self.fit = pair[order], fit[order]
                self.pairs.clear()
        return ok


def viterbi(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of words of one length; characters without a piece come as -1 - code point."""
    ids, count = ways(words, v)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def ways(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of one length, one after the other, and their number for each word.

    Characters without a piece come as -1 - code point.
    """
    n, size = len(words), len(words[0])
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(n, size)
    h = np.zeros((size + 1, n), np.uint64)
    for j in range(size):
        h[j + 1] = h[j] * _BASE + c[:, j] + np.uint64(1)
    low = np.float32(-np.inf)
    best = np.full((size + 1, n), low, np.float32)
    best[0] = 0
    last = np.full((size + 1, n), -1, np.int64)   # piece that ends here, -2 for an unknown character
    start = np.zeros((size + 1, n), np.int64)     # backpointers
    for j in range(1, size + 1):
        for i in range(max(0, j - v.longest), j):
            piece = v.find(h[j] - h[i] * v.power[j - i], j - i)
            at = np.flatnonzero((piece >= 0) & (best[i] > low))
            if v.kind == BPE:
                at = at[v.fits(last[i, at], piece[at])] if len(at) else at
                step = np.zeros(len(at), np.float32)
            else:
                step = v.score[piece[at]]
            total = best[i, at] + step
            up = total > best[j, at]
            at, total = at[up], total[up]
            best[j, at], last[j, at], start[j, at] = total, piece[at], i
            if i == j - 1:
                # a character that is no piece; a unigram way over it costs the penalty
                at = np.flatnonzero((piece < 0) & (best[i] > low))
                total = best[i, at] + (v.lowest if v.kind == UNIGRAM else np.float32(0))
                up = total > best[j, at]
                at, total = at[up], total[up]
                best[j, at], last[j, at], start[j, at] = total, -2, i
    # all words go back by one piece at a time, filling their rows from the right
    ids, place = np.zeros((n, size), np.int64), np.full(n, size)
    at, rows = np.full(n, size), np.arange(n)
    while len(rows):
        p = last[at, rows]
        place[rows] -= 1
        ids[rows, place[rows]] = np.where(p >= 0, p, -1 - c[rows, at - 1].astype(np.int64))
        at = start[at, rows]
        rows, at = rows[at > 0], at[at > 0]
    return ids[np.arange(size) >= place[:, None]], size - place


class Codec:
    """Encoder and decoder of whole texts; ids of words are kept up to a bound."""

    def __init__(self, model: bytes, keep: int = 200_000):
        self.v, self.keep, self.known = Vocabulary(model), keep, {}

    def _whole(self, ids: list[int]) -> bytes:
        out, v, unknown = [], self.v, False
        for i in ids:
            if i >= 0:
                out.append(i)
            elif v.byte:
                out.extend(v.byte[b] for b in chr(-1 - i).encode("utf-8", "replace"))
            elif not unknown or v.kind == BPE:
                out.append(v.unknown)
            unknown = i < 0
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; words that are new advance together by length."""
        split = [self.v.words(self.v.sp.normalize(t)) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        by_size: dict[int, list[str]] = {}
        for w in {w for ws in split for w in ws}:
            if w not in self.known:
                by_size.setdefault(len(w), []).append(w)
        for size, words in sorted(by_size.items()):
            rows = max(1, min(ROWS, 4_000_000 // size))
            for i in range(0, len(words), rows):
                some = words[i: i + rows]
                ids, count = ways(some, self.v)
                raw, end = ids.astype("<i4").tobytes(), np.cumsum(count)
                odd = np.add.reduceat(ids < 0, end - count) > 0
                for w, a, b, n in zip(some, (end - count).tolist(), end.tolist(), odd.tolist()):
                    self.known[w] = self._whole(ids[a:b].tolist()) if n else raw[4 * a: 4 * b]
        return [np.frombuffer(b"".join([self.known[w] for w in ws]), "<i4") for ws in split]

    def decode(self, ids) -> str:
        """Text of ids, as the library puts it together."""
        raw = b"".join([self.v.out[i] for i in ids])
        if self.v.prefix and len(ids) and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def kept_codec(model: bytes) -> Codec:
    """The codec of this Python worker; what it has learnt of words and pairs serves the worker's next tasks too."""
    return Codec(model)


def encoder(model: bytes):
    """Column function from text to ids; null and empty texts give no ids."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = kept_codec(model)
        for texts in parts:
            rows = list(texts)
            out = []
            for i in range(0, len(rows), 2_000):
                out.extend(codec.encode(rows[i: i + 2_000]))
            yield pd.Series(out, dtype=object)
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))


def decoder(model: bytes):
    """Column function from ids to text; null ids give null, no ids the empty text."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = kept_codec(model)
        for ids in parts:
            yield pd.Series([None if x is None else codec.decode(x) for x in ids], dtype=object)
    return F.pandas_udf(run, T.StringType())


def digest(model: bytes):
    """Column function from text to (n_tokens, ids_crc32, round_trip), with one codec for both ways."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = kept_codec(model)
        for texts in parts:
            ids = codec.encode(list(texts))
            yield pd.DataFrame({
                "n_tokens": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "round_trip": [codec.decode(x) == (t or "") for x, t in zip(ids, texts)]})

    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                         T.StructField("round_trip", T.BooleanType())])
    return F.pandas_udf(run, kind)


def report(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers) and round_trip of every row.

    round_trip says whether the decoded ids are the text again; a null text counts as empty.
    Repeated rows are encoded as often as they stand; an empty table gives an empty result.
    """
    return text_batches(docs).select(key, digest(model)(F.col(text)).alias("x")).select(key, "x.*")
