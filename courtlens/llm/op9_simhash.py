"""SimHash near-duplicates found by deletion-variant signatures.

The 64-bit fingerprint is cut into two segments of 32 bits. When two fingerprints differ
by at most three bits, one of the two segments differs by at most one bit; with that bit
left out both give the same variant. So each distinct fingerprint is indexed under its 64
one-wildcard variants (segment, wildcard position, the other 31 bits), equal variants meet
in an equality grouping, and the whole fingerprints are compared there.

* Equal fingerprints are one node, so a group of copies of any size costs one row.
* A group of variants yields a spanning forest of its links, not its pairs.
* Variants of a segment value that very many fingerprints share are keyed by the one-wildcard
  variants of the halves of the other segment too. Such a key fixes 46 bits, so no group
  can hold more than 2^18 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.llm.common import components, text_batches, unused
from courtlens.session import stable

#: Links join fingerprints at this distance or less; the two-segment index is exact up to 3.
MAX_BITS = 3
#: Distinct fingerprints with one segment value beyond which the finer key is used.
HOT_SEGMENT = 20_000
SHINGLE = 3


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: bit i is set if it is set in over half of the shingle hashes.

    Null and blank texts give 0; a text of fewer words than ``width`` is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        h = [digest(b" ".join(words), 42)]
    else:
        h = [digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]
    total, n = np.zeros(64, np.int64), len(h)
    h = np.array(h, "<u8")
    for i in range(0, n, 1 << 16):
        part = h[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    return text_batches(docs).withColumn(name, _simhash(F.col(text)))


def _hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _variants(fps: DataFrame) -> DataFrame:
    """(fp, key, sub): 64 rows for each fingerprint; sub is 0 except under hot segment values."""
    seg = fps.select("fp", F.explode(F.expr(
        "array(struct(0L as s, fp & 4294967295L as v, shiftrightunsigned(fp, 32) as o),"
        " struct(1L as s, shiftrightunsigned(fp, 32) as v, fp & 4294967295L as o))"
    )).alias("x")).select("fp", "x.*")
    key = "transform(sequence(0, 31), p -> shiftleft(s * 32 + p, 32) | (v & ~shiftleft(1L, p)))"
    hot = stable(seg.groupBy("s", "v").count().where(F.col("count") > HOT_SEGMENT)
                 .select(F.explode(F.expr(key)).alias("key")).distinct())
    rows = seg.select("fp", "o", F.explode(F.expr(key)).alias("key")).join(
        hot.withColumn("hot", F.lit(True)), "key", "left")
    fine = ("flatten(transform(array(struct(0L as s, o & 65535L as v), struct(1L as s, shiftrightunsigned(o, 16) as v)),"
            " h -> transform(sequence(0, 15), p -> 1L + (shiftleft(h.s * 16 + p, 16) | (h.v & ~shiftleft(1L, p))))))")
    return rows.select("fp", "key", F.explode(F.expr(f"if(hot, {fine}, array(0L))")).alias("sub"))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS


def _group_links(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one group: whatever is reached leaves the rows still to be searched."""
    rest = np.unique(fps)
    front: list[int] = []
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            continue
        at = front.pop()
        near = _near(rest, at)
        if near.any():
            found = rest[near]
            yield np.full(len(found), at, np.int64), found
            front.extend(found)
            rest = rest[~near]


def _links(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of sorted variants; the last group of a batch waits for the next batch."""
    key = sub = fp = np.empty(0, np.int64)

    def closed(key, sub, fp):
        a, b = [], []
        new = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.concatenate([start, [len(key)]]))
        two = start[size == 2]
        near = two[_near(fp[two], fp[two + 1])]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, n in zip(start[size > 2], size[size > 2]):
            for x, y in _group_links(fp[s: s + n]):
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    for p in parts:
        key = np.concatenate([key, p["key"].to_numpy()])
        sub = np.concatenate([sub, p["sub"].to_numpy()])
        fp = np.concatenate([fp, p["fp"].to_numpy()])
        if not len(key):
            continue
        differs = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
        cut = differs[-1] + 1 if len(differs) else 0
        if cut:
            yield closed(key[:cut], sub[:cut], fp[:cut])
            key, sub, fp = key[cut:], sub[cut:], fp[cut:]
    if len(key):
        yield closed(key, sub, fp)


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """(fp, class) for distinct fingerprints ``fp``: class is the smallest fingerprint reachable by links."""
    v = _variants(fps).repartition("key", "sub").sortWithinPartitions("key", "sub")
    roots = components(v.mapInPandas(_links, "a bigint, b bigint"))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("class"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id, fp_class.

    component_id is the smallest non-null key of the rows reachable by links, null when no
    such row has a key. fp_class is the same component named by a fingerprint, never null.
    Null and blank texts have fingerprint zero and link like any other. Repeated rows and
    repeated keys keep their rows. An empty table gives an empty result.
    """
    rows = stable(with_fingerprint(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "fp")
                  .select("k", "fp"))
    ids = stable(rows.groupBy("fp").agg(F.min("k").alias("k")))
    classes = fingerprint_classes(ids.select("fp"))
    named = stable(classes.join(ids, "fp"))
    named = named.join(named.groupBy("class").agg(F.min("k").alias("component_id")), "class").select(
        "fp", "component_id", F.col("class").alias("fp_class"))
    return rows.join(named, "fp").select(
        F.col("k").alias(key), _hex("fp").alias("fingerprint"),
        "component_id", "fp_class")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest key.

    Components whose rows have no key keep one of them. Columns stay as they are, whatever their names.
    """
    fp, id_ = unused(docs, "fp", "row_id")
    found = near_duplicates(docs, key, text).where(
        F.col("component_id").isNull() | (F.col(key) == F.col("component_id")))
    chosen = found.groupBy("fp_class").agg(F.min(F.struct(F.col(key).alias("k"), "fingerprint")).alias("one"))
    mine = with_fingerprint(docs, text, fp).withColumn(
        id_, F.struct(F.col(key).alias("k"), _hex(fp).alias("fingerprint")))
    kept = mine.join(chosen.select(F.col("one").alias(id_)), id_).dropDuplicates([id_])
    return kept.select(*docs.columns)
