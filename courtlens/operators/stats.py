"""Group statistics brought back to rows, and exact model metrics.

Standardising needs a group mean and deviation on every row. They are computed as a
partial aggregate and joined back. When the key is the season (validated ``YYYY-YYYY`` text,
at most 10,000 values), alone or with one of the six roles, the statistics side is broadcast
and the wide frame is never shuffled; for other keys Spark picks the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlens.functions import numeric as N
from courtlens.operators import ordered
from courtlens.session import stable

EPS = 2.220446049250313e-16


def with_group_stats(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Add aggregates over ``keys`` to every row."""
    g = df.groupBy(*keys).agg(*[a.alias(o) for o, a in aggregates.items()])
    return df.join(bounded(g, keys), keys, "left")


def bounded(g: DataFrame, keys: list[str]) -> DataFrame:
    """Broadcast hint for one row per season (and role), whose number has a fixed bound."""
    return F.broadcast(g) if set(keys) <= {"season", "role_family", "__all"} else g


def zscores(
    df: DataFrame, keys: list[str], cols: dict[str, str], null_as_zero: bool = True
) -> DataFrame:
    """Add (x - mean) / sample sd per key; 0 where the sd is 0 or undefined.

    With ``null_as_zero`` missing inputs count as 0; without it they are left out of
    the statistics and stay null.
    """
    x = {}
    for out, src in cols.items():
        v = N.number(F.col(src).cast("double"))
        x[out] = F.coalesce(v, F.lit(0.0)) if null_as_zero else v
    aggs = {}
    for out, v in x.items():
        aggs[f"__m_{out}"] = F.avg(v)
        aggs[f"__s_{out}"] = F.stddev_samp(v)
    d = with_group_stats(df, keys, aggs)
    flat = {}
    for out, v in x.items():
        sd = F.col(f"__s_{out}")
        degenerate = sd.isNull() | F.isnan(sd) | (sd == 0)
        flat[out] = F.when(degenerate, F.lit(0.0)).otherwise((v - F.col(f"__m_{out}")) / sd)
    return d.withColumns(flat).drop(*aggs)


def shrink_to_group_mean(
    df: DataFrame, keys: list[str], value: str, n: str, tau: float, out: str
) -> DataFrame:
    """n/(n+tau) of the value plus tau/(n+tau) of the unweighted group mean."""
    d = with_group_stats(df, keys, {"__gm": F.avg(value)})
    w = N.shrink(F.col(n), tau)
    return d.withColumn(
        out, w * F.col(value) + (F.lit(1.0) - w) * F.coalesce(F.col("__gm"), F.lit(0.0))
    ).drop("__gm")


def median_fill(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Add ``out``: the column, or the median of its group where it is null. ``df`` is written once."""
    df = stable(df)
    d = df.join(bounded(medians(df, keys, col, "__md"), keys), keys, "left")
    return d.withColumn(out, F.coalesce(F.col(col), F.col("__md"))).drop("__md")


#: Distinct values of a group that one task may sort, and the steps of the ranks at which a sketch is read.
MEDIAN_VALUES, MEDIAN_STEPS = 100_000, 40


def medians(df: DataFrame, keys: list[str], col: str, out: str = "median") -> DataFrame:
    """(keys, median): the exact median of a written table's column for each key, between the two middle values.

    A quantile sketch of a few kilobytes for each key names a band of values round the middle. Counting what lies
    under and in the band shows whether the middle is inside; if so only the band is looked at further, else
    all that was there. This goes on until no key has more than ``MEDIAN_VALUES`` distinct values left, which a window then
    ranks. So no task or buffer holds a group, whatever its size or its ties; nulls and NaN do not count.
    """
    v = F.col("v")
    band = df.select(*keys, F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    size = band.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    want = size.select(*keys, F.expr("(n - 1) div 2").alias("first"), F.expr("n div 2").alias("second"))
    before = None
    while True:
        values = band.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
        most = values.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= MEDIAN_VALUES or most == before:
            break
        before = most
        named = band.groupBy(*keys).agg(F.kll_sketch_agg_double("v").alias("s"), F.count(F.lit(1)).alias("m"),
                                        F.min("v").alias("least"), F.max("v").alias("top")).join(want, keys)
        read = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / MEDIAN_STEPS) for i in range(MEDIAN_STEPS + 1)]))
        place = lambda rank: (F.col(rank) * MEDIAN_STEPS / F.col("m"))
        edges = stable(named.select(
            *keys, "first", "second", "least", "top",
            F.get(read, F.greatest(F.lit(0), F.floor(place("first")) - 1).cast("int")).alias("lo"),
            F.get(read, F.least(F.lit(MEDIAN_STEPS), F.ceil(place("second")) + 1).cast("int")).alias("hi")))
        seen = band.join(edges, keys).groupBy(*keys, "first", "second", "least", "top", "lo", "hi").agg(
            F.count_if(v < F.col("lo")).alias("below"), F.count_if(v.between(F.col("lo"), F.col("hi"))).alias("inside"))
        holds = (F.col("below") <= F.col("first")) & (F.col("second") < F.col("below") + F.col("inside"))
        seen = stable(seen.select(*keys, *[F.when(holds, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("lo", "least"), ("hi", "top"))],
                                  *[(F.col(c) - F.when(holds, F.col("below")).otherwise(0)).alias(c) for c in ("first", "second")]))
        band = stable(band.join(seen, keys).where(v.between(F.col("lo"), F.col("hi"))).select(*keys, "v"))
        want = seen.select(*keys, "first", "second")
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    d = values.withColumn("upto", upto).join(want, keys)
    holds = lambda rank: F.max(F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank)), v))
    return d.groupBy(*keys).agg(((holds("first") + holds("second")) / 2).alias(out))


def distinct_sketches(df: DataFrame, keys: list[str], col: str, out: str = "sketch") -> DataFrame:
    """(keys, sketch): a small mergeable sketch of the distinct values of each group, to be stored."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, F.lit(12)).alias(out))


def merged_distinct(sketches: DataFrame, keys: list[str], out: str, sketch: str = "sketch") -> DataFrame:
    """(keys, out): distinct values of coarser groups from stored sketches, within about 3 %; the facts are not read again."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(out))


def least_squares(df: DataFrame, x: str, y: str, at: list[float]) -> DataFrame:
    """One-regressor least squares and its prediction at the given points."""
    fit = df.agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
    )
    return fit.select(
        "slope", "intercept", F.explode(F.array(*[F.lit(float(v)) for v in at])).alias("x")
    ).withColumn("prediction", F.col("intercept") + F.col("slope") * F.col("x"))


def classifier_metrics(df: DataFrame, keys: list[str], label: str, prob: str) -> DataFrame:
    """Rows, positive rate, log loss, Brier score and exact AUC per key.

    AUC is the tie-averaged rank sum. Equal scores are combined before ranking, and the
    ranking is a range-partitioned prefix sum, so no task sorts a whole split.
    """
    y, p = F.col(label).cast("double"), F.col(prob)
    safe = N.clip(p, EPS, 1.0 - EPS)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(y).alias("positive_rate"),
        F.avg(-(y * F.log(safe) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - safe))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    ties = df.groupBy(*keys, F.col(prob).alias("__p")).agg(
        F.sum(y).alias("__pos"), F.sum(F.lit(1.0) - y).alias("__neg")
    )
    ranked = ordered.prefix_totals(ties, keys, [F.col("__p").asc()], {"__below": F.col("__neg")})
    auc = ranked.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("__pos") * (F.col("__below") - F.col("__neg") / 2.0)),
            F.sum("__pos") * F.sum("__neg"),
        ).alias("auc")
    )
    return base.join(auc, keys, "left")
