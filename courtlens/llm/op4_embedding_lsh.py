"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and quantised; ``HASHES`` such
numbers make the bucket of one of ``TABLES`` tables. A cosine of at least 0.95 is a
Euclidean distance of at most 0.316, for which a pair meets in some table with probability
0.98 or more (0.999 at a cosine of 0.97). Every pair that meets is checked exactly.

* Equal vectors are one class, so copies cost one row.
* Buckets of one class are dropped before any vector is moved.
* A bucket of more than ``BLOCK`` classes is cut into blocks; a task holds two blocks.
* A pair counts in the first table where it meets: rows carry their buckets of all tables.
* Tasks give counts and a spanning forest of the links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import components, forest
from courtlens.session import stable

MIN_COSINE = 0.95
TABLES, HASHES, WIDTH, SEED = 32, 12, 1.6, 20240
BLOCK = 2_000


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and very small numbers."""
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def buckets(u: np.ndarray, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> np.ndarray:
    """Bucket numbers (rows x tables) of unit vectors; the directions depend on the dimension only."""
    rng = np.random.default_rng([SEED, u.shape[1]])
    to = rng.standard_normal((u.shape[1], tables * hashes))
    shift = rng.random(tables * hashes)
    mix = rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1
    cell = np.floor(u @ to / width + shift).astype(np.int64).reshape(len(u), tables, hashes)
    with np.errstate(over="ignore"):
        return (cell * mix).sum(axis=2) ^ u.shape[1]


def _hash(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        if not len(p):
            continue
        out = [None] * len(p)
        size = p["v"].map(len).to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            for i, b in zip(at, buckets(unit(np.stack(p["v"].to_numpy()[at])))):
                out[i] = b
        yield pd.DataFrame({"node": p["node"], "keys": out})


def _pairs(p: dict) -> tuple[np.ndarray, ...]:
    """Links of one group: for each row its linked copies, and the ends of the links."""
    u, keys, block, count = unit(np.stack(p["v"])), np.stack(p["keys"]), p["block"], p["copies"]
    table, half = int(p["table"][0]), p["half"][0]
    left = np.flatnonzero(block == half[0])
    right = np.flatnonzero(block == half[1])
    n = np.zeros(len(u), np.int64)
    ends_a, ends_b = [left[:0]], [left[:0]]
    for s in range(0, len(left), 512):
        rows = left[s: s + 512]
        near = u[rows] @ u[right].T >= MIN_COSINE
        if half[0] == half[1]:
            near &= rows[:, None] < right[None, :]
        i, j = np.nonzero(near)
        i, j = rows[i], right[j]
        if table:
            new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            i, j = i[new], j[new]
        np.add.at(n, i, count[j])
        np.add.at(n, j, count[i])
        ends_a.append(i)
        ends_b.append(j)
    return n, np.concatenate(ends_a), np.concatenate(ends_b)


def _links(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, n) of sorted groups: rows with b are links, rows without count links of a."""
    columns = ("group", "table", "half", "block", "node", "copies", "keys", "v")
    held = None

    def closed(p):
        g = p["group"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        whole = {c: p[c].to_numpy() for c in columns[1:]}
        node, total = whole["node"], np.zeros(len(p), np.int64)
        a, b = [], []
        for s, e in zip(start, np.append(start[1:], len(p))):
            if e - s > 1:
                n, i, j = _pairs({c: x[s:e] for c, x in whole.items()})
                total[s:e] += n
                a.append(node[s:e][i])
                b.append(node[s:e][j])
        a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])
        yield pd.DataFrame({"a": a, "b": b, "n": 0}).astype({"b": "Int64"})
        some = total > 0
        yield pd.DataFrame({"a": node[some], "b": None, "n": total[some]}).astype({"b": "Int64"})

    for p in parts:
        held = p if held is None else pd.concat([held, p], ignore_index=True)
        last = (held["group"] == held["group"].iloc[-1]).to_numpy() if len(held) else np.empty(0, bool)
        cut = int(np.argmax(last)) if len(held) else 0
        if cut:
            yield from closed(held.iloc[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield from closed(held)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    n_links counts the other rows with a cosine of at least ``MIN_COSINE``; component_id is
    the smallest key reachable by links. Vectors that are null, empty, zero or hold null or
    non-finite parts link with nothing, nor do vectors of different lengths with each other.
    Repeated rows are linked copies. A null key counts as a row and is never the smallest.
    """
    sound = ("{0} is not null and forall({0}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
             " and exists({0}, x -> x <> 0)").format("v")
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).withColumn("sound", F.expr(sound))
    rows = rows.withColumn("h", F.when(F.col("sound"), F.xxhash64("v")))
    classes = rows.where("sound").groupBy("h", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("k").alias("k"))
    classes = stable(classes.withColumn("node", F.monotonically_increasing_id()))
    hashed = stable(classes.select("node", "v").mapInPandas(_hash, "node bigint, keys array<bigint>"))
    spots = hashed.select("node", F.posexplode("keys").alias("table", "bucket"))
    full = stable(spots.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    spots = spots.join(full, ["table", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    # a row of block x goes to the groups (x, y) of its bucket for every block y
    spots = spots.withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "node", "table", "block", F.expr("array(least(block, y), greatest(block, y))").alias("half"),
        F.xxhash64("table", "bucket", F.least("block", "y"), F.greatest("block", "y")).alias("group"))
    moved = spots.join(hashed, "node").join(classes.select("node", "copies", "v"), "node")
    found = stable(moved.repartition("group").sortWithinPartitions("group", "table").mapInPandas(
        _links, "a bigint, b bigint, n bigint"))
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = stable(classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "h", "v", "k", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root")))
    least = known.groupBy("root").agg(F.min("k").alias("component_id"))
    known = stable(known.join(least, "root").select(
        "h", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.join(known, ["h", "v"], "left")
    linked = F.col("n_links").isNotNull()
    root = F.when(linked, F.col("component_id")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      root.alias("component_id"), F.coalesce(F.col("k") == root, F.lit(False)).alias("kept"))
