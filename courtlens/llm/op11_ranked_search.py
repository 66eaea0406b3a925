"""The best documents for each of a set of queries, by dense blocked multiplication of exact numbers.

A query item scores a document by the sum, over the item's terms and their repeats, of
``weight(term) * impact(term, document)``; both are whole numbers, so the result is exact.

* Items are dealt into rounds of about ``ROUND_TERMS`` terms by a hash. Only the words of one
  round are on the driver and in the workers at a time, so any number of items can be asked.
* One scan of the texts counts the terms that any item of the round holds and writes, for each
  document, its length and (term, count) as a table. Document frequencies are sums over it.
* Tiles of ``TILE_DOCS`` documents become dense float64 matrices of impacts over the compact
  vocabulary of ``BLOCK_ITEMS`` items, which are multiplied with the items' weights by BLAS. The
  vocabulary is cut into tiles such that no partial sum can reach 2^53, so every sum is a whole
  number that float64 holds; tiles are added as 64-bit integers.
* A tile keeps every document that ties with its k-th best; ties are then settled by the key. Tasks
  hand on k documents for an item, which are merged in two steps, over parts of an item first.

Terms are runs of digits, letters and everything outside ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtlens.session import stable

K = 10
#: Words of the items that one scan of the documents serves.
ROUND_TERMS = 1_000_000
BLOCK_ITEMS, TILE_DOCS, TILE_TERMS = 64, 1_024, 4_096
#: No impact is greater, and a float64 holds every whole number below 2^53.
MAX_IMPACT = 10**6
EXACT = (2**53 - 1) // MAX_IMPACT
#: Parts in which the finds of an item are merged first.
PARTS = 64
#: Letters and digits keep their place, A-Z become a-z, other ASCII characters separate terms.
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_LONGS = T.ArrayType(T.IntegerType())


def terms(text: bytes | None, size: int = 4_000_000) -> Iterator[list[bytes]]:
    """The terms of a text with their repeats, in lists, as a long text is split piece by piece."""
    plain, at = (text or b"").translate(_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _items(items: DataFrame, key: str, text: str) -> DataFrame:
    """(q, id, words) of the distinct items, q being a number of the row."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[w for part in terms(t) for w in part] for t in texts], dtype=object)

    d = items.select(F.col(key).alias("id"), F.col(text).alias("t")).distinct()
    words = F.pandas_udf(run, T.ArrayType(T.BinaryType()))(F.col("t").cast("binary"))
    d = stable(d.select("id", words.alias("words")))
    return stable(d.where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("q"), "id", "words"))


def _counted(docs: DataFrame, key: str, text: str, words: list[bytes]) -> DataFrame:
    """(k, n, id, tf): length of every document and counts of those terms that are among ``words``."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = {w: i for i, w in enumerate(shared.value)}
        for texts in parts:
            n, ids, counts = [], [], []
            for text in texts:
                size, tf = 0, Counter()
                for part in terms(text):
                    size += len(part)
                    tf.update(filter(place.__contains__, part))
                n.append(size)
                ids.append(np.fromiter(map(place.__getitem__, tf), np.int32, len(tf)))
                counts.append(np.fromiter(tf.values(), np.int32, len(tf)))
            yield pd.DataFrame({"n": n, "id": pd.Series(ids, dtype=object), "tf": pd.Series(counts, dtype=object)})

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("id", _LONGS), T.StructField("tf", _LONGS)])
    found = F.pandas_udf(run, kind)(F.col(text).cast("binary"))
    return stable(docs.select(F.col(key).cast("bigint").alias("k"), found.alias("x")).select("k", "x.*"))


def tiles(q: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(from, to, part): columns of the weights q cut so that no partial sum reaches 2^53.

    A weight too great for that by itself comes in several parts.
    """
    out = []
    while q.any():
        part, lo = np.minimum(q, EXACT), 0
        while lo < q.shape[1]:
            hi = min(lo + TILE_TERMS, q.shape[1])
            while part[:, lo:hi].sum(axis=1).max() > EXACT:
                hi = lo + (hi - lo) // 2
            out.append((lo, hi, part[:, lo:hi].astype(np.float64)))
            lo = hi
        q = q - part
    return out


def blocks(asked: list[tuple[int, Counter]], weight: dict[int, int], size: int) -> list[tuple]:
    """(q of the items, local column of every term or -1, weight tiles) for each block of items."""
    out = []
    for i in range(0, len(asked), BLOCK_ITEMS):
        some = asked[i: i + BLOCK_ITEMS]
        local = sorted({t for _, tf in some for t in tf if weight[t]})
        column = np.full(size, -1, np.int32)
        column[local] = np.arange(len(local))
        q = np.zeros((len(some), len(local)), np.int64)
        for r, (_, tf) in enumerate(some):
            for t, n in tf.items():
                if weight[t]:
                    q[r, column[t]] = n * weight[t]
        out.append((np.array([x for x, _ in some]), column, tiles(q) if len(local) else []))
    return out


def best_of(item, key, empty, score, k: int) -> tuple[np.ndarray, ...]:
    """The k best of every item: highest score first, equals by ascending key, null keys last."""
    order = np.lexsort((key, empty, -score, item))
    item = item[order]
    new = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
    rank = np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item))))
    order = order[rank < k]
    return item[rank < k], key[order], empty[order], score[order]


def _impacts(n: np.ndarray, lens: np.ndarray, tf: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L of the document."""
    if 75 * int(n.max(initial=0)) * docs < 2**63:
        m = 25 + 75 * n * docs // words
    else:
        m = np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)
    tf = tf.astype(np.int64)
    return 10**9 * tf // (1000 * tf + 8 * np.repeat(m, lens))


def _found(counted: DataFrame, plan: list[tuple], docs: int, words: int, k: int) -> DataFrame:
    """(q, k, score): the k best documents of every item, from every task."""
    shared = counted.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = [(none, none, none, none) for _ in shared.value]
        for b in batches:
            for at in range(0, b.num_rows, TILE_DOCS):
                tile = b.slice(at, TILE_DOCS)
                key, n, ids, tf = tile.columns
                empty = key.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                key, n = key.fill_null(0).to_numpy(), n.to_numpy()
                lens = ids.value_lengths().to_numpy()
                impact = _impacts(n, lens, tf.flatten().to_numpy(), docs, words)
                ids, doc = ids.flatten().to_numpy(), np.repeat(np.arange(len(n)), lens)
                for i, (items, column, parts) in enumerate(shared.value):
                    local = column[ids]
                    on = local >= 0
                    score = np.zeros((len(items), len(n)), np.int64)
                    for lo, hi, weights in parts:
                        here = on & (local >= lo) & (local < hi)
                        dense = np.zeros((hi - lo, len(n)))
                        dense[local[here] - lo, doc[here]] = impact[here]
                        score += (weights @ dense).astype(np.int64)
                    least = np.ones(len(items), np.int64)
                    if len(n) > k:  # every tie of the k-th best stays for the keys to settle
                        least = np.maximum(least, np.partition(score, len(n) - k, axis=1)[:, len(n) - k])
                    r, c = np.nonzero(score >= least[:, None])
                    best[i] = best_of(*(np.concatenate(x) for x in zip(
                        best[i], (items[r], key[c], empty[c], score[r, c]))), k)
        for item, key, empty, score in best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(key, mask=empty.astype(bool)), pa.array(score)], ["q", "k", "score"])

    return counted.where(F.size("id") > 0).mapInArrow(run, "q bigint, k bigint, score bigint")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(q, k, score, rank): what the tasks found, merged over parts of an item and then over items."""
    by = [F.desc("score"), F.asc_nulls_last("k")]
    part = found.withColumn("part", F.pmod(F.xxhash64("k", "score"), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*by))).where(F.col("rank") <= k)
    one = part.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("rank") <= k)
    return one.select("q", "k", "score", "rank")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = K, round_terms: int = ROUND_TERMS) -> DataFrame:
    """(item, rank, key, score): the k best documents for each item, fewer where fewer score above 0.

    ``key`` holds whole numbers. Documents of null or empty text, and items without a term, have no result;
    they count in no statistic. Documents with equal rows are ranked each for itself. Items with equal key and
    text are one item; items that share the key alone have a ranking each. Documents of null key rank
    behind equals. Empty tables give no rows. All columns but the four named are left alone and may have any name.
    """
    spark = docs.sparkSession
    asked = _items(items, item, item_text)
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    rounds = -(-total // round_terms)
    out = []
    for r in range(rounds):
        some = [(x["q"], Counter(map(bytes, x["words"]))) for x in asked.where(
            F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).select("q", "words").toLocalIterator()]
        words = sorted({w for _, tf in some for w in tf})
        place = {w: i for i, w in enumerate(words)}
        counted = _counted(docs, key, text, words)
        size = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not size[0]:
            continue
        df = dict(counted.select(F.explode("id").alias("id")).groupBy("id").count().collect())
        weight = {i: math.floor(1000 * math.log((2 * size[0] + 2) / (2 * df[i] + 1))) if i in df else 0
                  for i in range(len(words))}
        plan = blocks([(q, Counter({place[w]: n for w, n in tf.items()})) for q, tf in some], weight, len(words))
        out.append(_merged(_found(counted, plan, size[0], size[1], k), k))
    if not out:
        nothing = spark.createDataFrame([], "q bigint, k bigint, score bigint, rank int")
        out = [nothing]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.join(asked.select("q", "id"), "q").select(
        F.col("id").alias(item), "rank", F.col("k").alias(key), "score")
