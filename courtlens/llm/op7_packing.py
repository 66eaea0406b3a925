"""Best-fit packing of token sequences by hierarchical residuals.

Every group of pieces is packed best-fit by itself, longest first. Bins that are nearly full
are done; the others become items of their own, and a tree of groups packs those items
best-fit again, ``FAN_IN`` groups at a time, up to the root. A node hands on at most
``HANDED_ON`` bins, the emptiest ones, so neither a group nor the root grows with the input.
The cap costs no sequence. Best-fit leaves at most one bin of a node at or below half, and two
bins above half never go together, so a node merges at most ``FAN_IN`` bins into others. If a
bin that was not handed on could take one of them, so could the ``HANDED_ON`` emptier ones, and
of those no more than ``FAN_IN`` a level are used: far more are left at any depth there can be.
The place of a piece is its place in its bin plus the places of the bins that took its bin.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import text_batches
from courtlens.session import stable

CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Pieces in a group of the first level, groups that a node takes, bins that a node hands on.
GROUP_ROWS, FAN_IN, HANDED_ON = 20_000, 16, 4_000
#: Bins with this much room or less are done.
NEARLY_FULL = 8
VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters split into words alike in every Unicode version.
_COMMON = re.compile("[\\t-\\r\\x20-\u024f\u2010-\u2027]*")
#: A blank between two other characters begins a word, whatever stands around it.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")


class Encoder:
    """Ids of whole texts as little-endian bytes, as the tokenizer file gives them.

    Texts of common characters are cut at blanks; cuts and words are encoded once and kept up
    to a bound. Words go through the ranks of the same vocabulary, which make the same merges.
    Texts with other characters or special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str, keep: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.words: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the file writes bytes as characters: printable ones as themselves, the others from 256 on
        own = ByteLevel.alphabet()
        plain = [b for b in range(256) if chr(b) in own]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if w not in self.special}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, cut: str) -> bytes:
        words, out = self.words, []
        for w in self.find(cut):
            ids = words.get(w)
            if ids is None:
                ids = array("I", self.merge(w)).tobytes()
                if len(w) <= 64:
                    if len(words) >= self.keep:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if not _COMMON.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        parts = _BLANK.split(text) if _DOUBLE.search(text) or text[-1:] == " " or text[:1] == " " else text.split(" ")
        cuts, out, first = self.cuts, [], True
        for c in parts:
            if not first:
                c = " " + c
            first = False
            ids = cuts.get(c)
            if ids is None:
                ids = self._cut(c)
                if len(c) <= 64:
                    if len(cuts) >= self.keep:
                        cuts.clear()
                    cuts[c] = ids
            out.append(ids)
        return b"".join(out)


def _cut(capacity: int, path: str):
    tail = np.array([END], "<u4").tobytes()

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(path)
        for p in parts:
            key, piece, start, length, crc = [], [], [], [], []
            for k, t in zip(p["k"], p["t"]):
                ids = encode(t or "") + tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1 if n > capacity else n
                at = 0
                for i, size in enumerate([first] + [capacity] * ((n - first) // capacity)):
                    key.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at: 4 * (at + size)]))
                    at += size
            yield pd.DataFrame({"k": pd.Series(key, dtype=p["k"].dtype), "piece": piece, "start": start,
                                "length": length, "ids_crc32": crc})
    return run


def pieces(docs: DataFrame, path: str, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """(k, piece, start, length, ids_crc32): documents as pieces of at most ``capacity`` tokens."""
    rows = text_batches(docs).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    return rows.mapInPandas(_cut(capacity, path),
                            f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the fill of every bin: longest first, each into the fullest bin that takes it."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms: list[int] = []  # sorted rooms that have a bin
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                del rooms[at]
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            if not with_room[left]:
                bisect.insort(rooms, left)
            with_room[left].append(b)
    return bin_of, offset, np.array(fill, np.int64)


def _open(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Bins that a node hands on: the emptiest that are not nearly full."""
    order = np.argsort(fill, kind="stable")
    return order[fill[order] < capacity - NEARLY_FULL][:HANDED_ON]


def _dealt(p: DataFrame, groups: int) -> DataFrame:
    """``p`` with the group of every row. The written row number spreads rows that are equal."""
    return p.withColumn("node", F.pmod(F.xxhash64("k", "piece", "ids_crc32", "start", "row"), F.lit(groups))).drop("row")


def _pack_group(capacity: int):
    """Bins of one group; ``bin`` counts within (level, node), ``fill`` is set for bins handed on."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["k", "piece", "ids_crc32", "start"], kind="stable", na_position="first")
        bin_of, offset, fill = best_fit(p["length"].to_numpy(), capacity)
        handed = np.zeros(len(fill), np.int64)
        at = _open(fill, capacity)
        handed[at] = fill[at]
        return p.assign(bin=bin_of, offset=offset, fill=handed[bin_of])
    return run


def _pack_bins(capacity: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["child", "bin"], kind="stable")
        bin_of, offset, fill = best_fit(p["fill"].to_numpy(), capacity)
        handed = np.zeros(len(fill), np.int64)
        at = _open(fill, capacity)
        handed[at] = fill[at]
        return pd.DataFrame({"child": p["child"], "child_bin": p["bin"], "node": p["node"], "bin": bin_of,
                             "offset": offset, "fill": handed[bin_of]})
    return run


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and is the end id alone; a document longer than ``capacity`` is cut
    so that only its first piece is shorter; repeated rows and keys are packed each for itself.
    """
    p = stable(pieces(docs, path, key, text, capacity).withColumn("row", F.monotonically_increasing_id()))
    rows = p.count()
    groups = max(1, -(-rows // GROUP_ROWS))
    kind = dict(p.dtypes)["k"]
    placed = stable(_dealt(p, groups).groupBy("node").applyInPandas(
        _pack_group(capacity), f"k {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, node bigint,"
                               " bin bigint, offset bigint, fill bigint"))
    # (node, bin) at the first level to (top, add): the bin that holds it in the end, and its place there
    handed = placed.where("fill > 0").select("node", "bin", "fill").distinct()
    moves = handed.select("node", "bin", F.lit(0).alias("level"), F.col("node").alias("top_node"),
                          F.col("bin").alias("top_bin"), F.lit(0).cast("bigint").alias("add"), "fill")
    level = 0
    while groups > 1:
        level += 1
        groups = -(-groups // FAN_IN)
        moves = stable(moves)
        items = moves.where(f"level = {level - 1} and fill > 0").select(
            F.col("top_node").alias("child"), F.col("top_bin").alias("bin"), "fill",
            F.floor(F.col("top_node") / FAN_IN).alias("node")).distinct()
        up = stable(items.groupBy("node").applyInPandas(
            _pack_bins(capacity), "child bigint, child_bin bigint, node bigint, bin bigint, offset bigint, fill bigint"))
        up = up.select(F.col("child").alias("top_node"), F.col("child_bin").alias("top_bin"), F.lit(level - 1).alias("level"),
                       F.col("node").alias("n2"), F.col("bin").alias("b2"), "offset", F.col("fill").alias("f2"))
        moves = moves.join(up, ["top_node", "top_bin", "level"], "left").select(
            "node", "bin", F.when(F.col("n2").isNotNull(), level).otherwise(F.col("level")).alias("level"),
            F.coalesce("n2", "top_node").alias("top_node"), F.coalesce("b2", "top_bin").alias("top_bin"),
            (F.col("add") + F.coalesce("offset", F.lit(0))).alias("add"), F.coalesce("f2", F.lit(0)).alias("fill"))
    done = placed.join(stable(moves).drop("fill"), ["node", "bin"], "left")
    # a number for (level, node, bin): a bin number is below 2^31, a node number below 2^26
    name = F.expr("shiftleft(cast(coalesce(level, 0) as bigint), 57) | shiftleft(coalesce(top_node, node), 31) | coalesce(top_bin, bin)")
    return done.select(
        F.col("k").alias(key), "piece", "start", "length", "ids_crc32", name.alias("sequence_id"),
        (F.col("offset") + F.coalesce("add", F.lit(0))).alias("offset"))
