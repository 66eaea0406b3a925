"""Row-order operators that stay parallel when one group holds most of the rows.

Two families:

* *Chunked scans* (forward fill, previous row, running sum) over a unique integer
  order column. With ``chunk=None`` they are plain windows per key: one exchange,
  one sort. When the hottest key is larger than ``HOT_ROWS`` the caller passes a
  chunk size; each key is then cut into order ranges of at most that many rows, a
  small summary per range is scanned, and the carry is joined back. Both forms give
  the same rows. ``pick_chunk`` makes the choice from the data.
* *Ranged scans* (row number, dense rank, prefix totals) over any sort key: one range
  partitioning, frozen in a written table, then a local pass plus partition offsets.

Key columns must be non-null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlens.session import stable

HOT_ROWS = 2_000_000
_C, _P = "__chunk", "__part"


def hottest_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the largest group (map-side combined count, one number collected)."""
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def pick_chunk(df: DataFrame, keys: list[str], limit: int | None = None) -> int | None:
    """None when plain windows are fine, otherwise the chunk size to use."""
    limit = limit or HOT_ROWS
    return limit if hottest_group(df, keys) > limit else None


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    """Rows with their chunk number, written out because a chunked scan reads them twice.

    Without the cut, a chain of n scans would recompute its source 2^n times. Callers hand
    over only the columns the scan needs and join the result back by key and order.
    """
    return stable(df.withColumn(_C, F.floor(F.col(order) / F.lit(chunk))))


def _before(keys: list[str]) -> W:
    return W.partitionBy(*keys).orderBy(_C).rowsBetween(W.unboundedPreceding, -1)


def forward_fill(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], chunk: int | None = None
) -> DataFrame:
    """Add ``out`` = last non-null ``source`` at or before each row, for out -> source."""
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({o: F.last(s, ignorenulls=True).over(w) for o, s in cols.items()})
    d = _chunked(df, order, chunk)
    last_in_chunk = d.groupBy(*keys, _C).agg(
        *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(o) for o, s in cols.items()]
    )
    carry = last_in_chunk.select(
        *keys, _C, *[F.last(o, ignorenulls=True).over(_before(keys)).alias(f"__k_{o}") for o in cols]
    )
    w = W.partitionBy(*keys, _C).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = d.join(carry, [*keys, _C], "left")
    d = d.withColumns(
        {o: F.coalesce(F.last(s, ignorenulls=True).over(w), F.col(f"__k_{o}")) for o, s in cols.items()}
    )
    return d.drop(_C, *[f"__k_{o}" for o in cols])


def previous(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], has: str,
    chunk: int | None = None,
) -> DataFrame:
    """Add ``out`` = ``source`` of the preceding row, and ``has`` = there is one."""
    packed = F.struct(*[F.col(s).alias(o) for o, s in cols.items()])
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(order)
        d = df.withColumn("__prev", F.lag(packed).over(w))
    else:
        d = _chunked(df, order, chunk)
        tails = d.groupBy(*keys, _C).agg(F.max_by(packed, F.col(order)).alias("__tail"))
        carry = tails.select(
            *keys, _C, F.lag("__tail").over(W.partitionBy(*keys).orderBy(_C)).alias("__carry")
        )
        w = W.partitionBy(*keys, _C).orderBy(order)
        d = d.join(carry, [*keys, _C], "left").withColumn(
            "__prev", F.coalesce(F.lag(packed).over(w), F.col("__carry"))
        )
    return d.withColumns(
        {**{o: F.col(f"__prev.{o}") for o in cols}, has: F.col("__prev").isNotNull()}
    ).drop("__prev", "__carry", _C)


def running_sum(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, Column],
    chunk: int | None = None, inclusive: bool = True,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` up to (and, if inclusive, with) each row; 0 at the start."""
    end = 0 if inclusive else -1
    zero = F.lit(0)
    if chunk is None:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, end)
        return df.withColumns({o: F.coalesce(F.sum(v).over(w), zero) for o, v in cols.items()})
    d = _chunked(df, order, chunk)
    totals = d.groupBy(*keys, _C).agg(*[F.sum(v).alias(o) for o, v in cols.items()])
    carry = totals.select(
        *keys, _C,
        *[F.coalesce(F.sum(o).over(_before(keys)), zero).alias(f"__k_{o}") for o in cols],
    )
    w = W.partitionBy(*keys, _C).orderBy(order).rowsBetween(W.unboundedPreceding, end)
    d = d.join(carry, [*keys, _C], "left")
    d = d.withColumns(
        {o: F.coalesce(F.sum(v).over(w), zero) + F.col(f"__k_{o}") for o, v in cols.items()}
    )
    return d.drop(_C, *[f"__k_{o}" for o in cols])


def attach(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], hot: bool = False
) -> DataFrame:
    """Add group aggregates to every row of the group.

    A whole-partition window when groups are small; when a group may be hot, a
    partial aggregate joined back, which AQE can split on the row side.
    """
    if not hot:
        w = W.partitionBy(*keys)
        return df.withColumns({o: a.over(w) for o, a in aggregates.items()})
    g = df.groupBy(*keys).agg(*[a.alias(o) for o, a in aggregates.items()])
    return df.join(g, keys, "left")


def segment(
    df: DataFrame, keys: list[str], order: str, ends_segment: str, out: str,
    chunk: int | None = None,
) -> DataFrame:
    """Gaps-and-islands: 1 + number of earlier rows in the key that ended a segment."""
    d = running_sum(
        df, keys, order, {out: F.col(ends_segment).cast("int")}, chunk, inclusive=False
    )
    return d.withColumn(out, (F.col(out) + 1).cast("bigint"))


# --- ranged scans -----------------------------------------------------------

def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return stable(spread.withColumn(_P, F.spark_partition_id()))


def prefix_totals(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]
) -> DataFrame:
    """Add ``out`` = running inclusive sum of ``value`` in ``order`` within each key.

    ``order`` has to be total within a key. No task sees more than one range of rows.
    """
    d = _ranged(df, keys, order)
    per_part = d.groupBy(*keys, _P).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in sums.items()])
    w = W.partitionBy(*keys).orderBy(_P).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        *keys, _P,
        *[F.coalesce(F.sum(f"__t_{o}").over(w), F.lit(0)).alias(f"__k_{o}") for o in sums],
    )
    local = W.partitionBy(*keys, _P).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.join(offsets, [*keys, _P]).withColumns(
        {o: F.sum(v).over(local) + F.col(f"__k_{o}") for o, v in sums.items()}
    )
    return d.drop(_P, *[f"__k_{o}" for o in sums])


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    return prefix_totals(df, keys, order, {out: F.lit(1).cast("bigint")})


def dense_rank(
    df: DataFrame, keys: list[str], value: str, out: str, descending: bool = True
) -> DataFrame:
    """Dense rank of ``value`` within ``keys``: rank the distinct values, join back."""
    by = F.col(value).desc() if descending else F.col(value).asc()
    distinct = df.select(*keys, value).distinct()
    ranks = row_numbers(distinct, keys, [by], out)
    return df.join(ranks, [*keys, value], "left")


def dense_ranks(
    df: DataFrame, value: str, ranks: dict[str, list[str]], descending: bool = True
) -> DataFrame:
    """Several dense ranks of ``value``, each within its own keys (out -> keys), in one ordered pass.

    The distinct (keys, value) are spread by the keys that all ranks share and the value, once; equal values
    share a range, so each rank counts the first rows of its values there and adds the ranges before.
    """
    every = list(dict.fromkeys(k for keys in ranks.values() for k in keys))
    shared = [k for k in every if all(k in keys for keys in ranks.values())]
    by = F.col(value).desc() if descending else F.col(value).asc()
    d = _ranged(df.select(*every, value).distinct(), shared, [by])
    for out, keys in ranks.items():
        rest = [k for k in every if k not in keys]
        first = F.row_number().over(W.partitionBy(*keys, _P, value).orderBy(*(rest or [value]))) == 1
        d = d.withColumn(f"__f_{out}", first.cast("bigint"))
        per_part = d.groupBy(*keys, _P).agg(F.sum(f"__f_{out}").alias("__t"))
        before = W.partitionBy(*keys).orderBy(_P).rowsBetween(W.unboundedPreceding, -1)
        offsets = per_part.select(*keys, _P, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
        upto = W.partitionBy(*keys, _P).orderBy(by).rangeBetween(W.unboundedPreceding, 0)
        d = d.join(offsets, [*keys, _P]).withColumn(out, F.sum(f"__f_{out}").over(upto) + F.col("__o")).drop("__o")
    return df.join(d.select(*every, value, *ranks), [*every, value], "left")


# --- compositions -----------------------------------------------------------

def keep_first(df: DataFrame, subset: list[str], order: str) -> DataFrame:
    """Full-row or subset dedup keeping the earliest row; combines before the shuffle."""
    rest = [c for c in df.columns if c not in subset and c != order]
    aggs = [F.min(order).alias(order)]
    if rest:
        aggs.append(F.min_by(F.struct(*rest), order).alias("__r"))
    out = df.groupBy(*subset).agg(*aggs)
    return out.select(*[F.col(f"__r.{c}") if c in rest else F.col(c) for c in df.columns])


def contest_blocks(
    df: DataFrame, order: str, raw_id: str, block_keys: list[str], set_col: str,
    partition: list[str], out: str, chunk: int | None = None, negative_synthetic: bool = False,
) -> DataFrame:
    """Contest ids from row order where the source has none.

    A block starts when a (forward-filled) block key changes or the set number falls.
    A block that holds a real id takes its first one, otherwise its running number.
    """
    base = df
    d = base.select(*dict.fromkeys([*partition, order, raw_id, *block_keys, set_col]))
    d = d.withColumns(
        {f"__b_{k}": F.nullif(F.trim(F.coalesce(F.col(k), F.lit(""))), F.lit("")) for k in block_keys}
    )
    d = forward_fill(d, partition, order, {f"__f_{k}": f"__b_{k}" for k in block_keys}, chunk)
    now = [f"__f_{k}" for k in block_keys]
    d = previous(
        d, partition, order, {**{f"__p{c}": c for c in now}, "__p_set": set_col}, "__has", chunk
    )
    changed = F.lit(False)
    for c in now:
        changed = changed | F.coalesce(F.col(c) != F.col(f"__p{c}"), F.lit(False))
    reset = F.coalesce(F.col(set_col) < F.col("__p_set"), F.lit(False))
    d = d.select(
        *partition, order, F.col(raw_id).alias("__raw"),
        (~F.col("__has") | changed | reset).cast("int").alias("__new"),
    )
    d = running_sum(d, partition, order, {"__block": F.col("__new")}, chunk)
    d = stable(d.select(*partition, order, "__raw", "__block")) if chunk else d
    real = F.min_by("__raw", F.when(F.col("__raw").isNotNull(), F.col(order)))
    d = attach(d, [*partition, "__block"], {"__real": real}, hot=chunk is not None)
    synthetic = -F.col("__block") if negative_synthetic else F.col("__block")
    ids = d.select(*partition, order, F.coalesce(F.col("__real"), synthetic).cast("bigint").alias("__id"))
    return base.join(ids, [*partition, order]).withColumn(out, F.col("__id")).drop("__id")


def chronological_split(
    df: DataFrame, contest: str, date_text: str, row_order: list[str], partition: list[str],
    train: float, valid: float, date_formats: tuple[str, ...] = ("M/d/yyyy", "M-d-yyyy", "MMM d, yyyy"),
) -> DataFrame:
    """Label every contest train / valid / test by its place in time.

    Orders by date when at least half of the rows of a partition carry one, by
    contest id otherwise. A date is what a format or the ISO form reads. Result: one row per contest with ``split``. ``partition``
    is the season, whose text form bounds the per-partition table that is broadcast.
    """
    text = F.trim(F.col(date_text).cast("string"))
    date = F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in date_formats], text.try_cast("timestamp")))
    per_contest = df.groupBy(*partition, contest).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(date).alias("__dated"),
        F.min_by(date, F.struct(*row_order)).alias("__d"),
    )
    overall = per_contest.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("__contests"),
        (F.sum("__dated") >= F.sum("__n") * F.lit(0.5)).alias("__by_date"),
    )
    keyed = per_contest.join(F.broadcast(overall), partition).withColumn(
        "__day", F.when(F.col("__by_date"), F.datediff(F.col("__d"), F.lit("1900-01-01")))
    )
    placed = row_numbers(
        keyed.select(*partition, contest, "__contests", "__day"), partition,
        [F.col("__day").asc_nulls_last(), F.col(contest).asc()], "__rn",
    )
    n_train = F.floor(F.col("__contests") * F.lit(train))
    n_valid = F.floor(F.col("__contests") * F.lit(valid))
    split = (
        F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_valid, "valid").otherwise("test")
    )
    return placed.select(*partition, contest, split.alias("split"))


def with_file_row(df: DataFrame, out: str = "file_row", keys: list[str] | None = None) -> DataFrame:
    """Unique, order-preserving integer for rows of file sources.

    With ``keys``, columns with one value in each file, numbers are unique and begin anew for each key.

    Tasks are not numbered in file order, so rows are ordered by (file, block offset)
    first and by position inside the block second.
    """
    d = df.withColumns({
        "__path": F.col("_metadata.file_path"),
        "__start": F.col("_metadata.file_block_start"),
        "__id": F.monotonically_increasing_id(),
    })
    keys = keys or []
    blocks = d.groupBy(*keys, "__path", "__start").agg(F.min("__id").alias("__first"))
    numbered = row_numbers(blocks, keys, [F.col("__path"), F.col("__start")], "__block").drop(*keys)
    return (
        d.join(numbered, ["__path", "__start"])
        .withColumn(out, F.col("__block") * F.lit(1 << 34) + (F.col("__id") - F.col("__first")))
        .drop("__path", "__start", "__id", "__first", "__block")
    )
