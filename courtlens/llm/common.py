"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.session import stable

#: White space of the word rule: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def text_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``rows`` rows, as whole texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(key: str, n: int) -> Column:
    """Remainder of crc32 of the key written as text; a null key falls in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to one link from every node to the smallest node it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a):]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            flat = new[new]
            if (flat == new).all():
                break
            new = flat
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _shrink(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """The links of one task as stars; a long task folds what it has from time to time."""
    a = b = np.empty(0, np.int64)
    for p in parts:
        a = np.concatenate([a, p["a"].to_numpy()])
        b = np.concatenate([b, p["b"].to_numpy()])
        if len(a) > 2_000_000:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): root is the smallest reachable node.

    Alternating large-star and small-star rounds. Each round joins the links with the
    smallest neighbour of each node, an aggregate, so a node with very many neighbours
    only makes a skewed join side, which adaptive execution splits. Every round is a
    written table. Empty links give an empty result.
    """
    kind = "a bigint, b bigint"
    e = stable(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).mapInPandas(_shrink, kind).distinct())
    seen = _state(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").union(low)
        e = stable(small.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(e: DataFrame) -> tuple:
    """Row count and an order-free digest of the links."""
    r = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return (r[0], r[1])
