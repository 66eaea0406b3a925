"""Win probability, expected outcomes and the season-stat ridge.

All models of a kind are fitted at once by sums over their rows (``operators/optimise.py``), over all of them
unless a caller sets a training cap. The scoreboard models first combine rallies with equal
state. Scoring is a Column expression over the full data, or one pass over the distinct states.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.config import DEFAULT, SEED, WP_FEATURES, ModelConfig
from courtlens.functions import numeric as N
from courtlens.operators import optimise, ordered, shape, stats
from courtlens.operators.joins import checked_broadcast, parts_for
from courtlens.plans.playbyplay import RALLY_KEY
from courtlens.session import stable

# fitting functions travel to the workers by value, so these need only numpy and pandas
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDES = ["home", "away", "unknown"]
WP_INPUTS = [*WP_FEATURES, *[f"server_{s}" for s in SIDES]]


# --- scoreboard state -------------------------------------------------------

def wp_state(state: str) -> dict[str, Column]:
    """Scoreboard features before or after a rally, as name -> Column."""
    if state == "before":
        names = ("set_no", "home_sets_before", "away_sets_before", "score_home_start",
                 "score_away_start", "server_side")
    elif state == "after":
        names = ("set_after", "home_sets_after", "away_sets_after", "score_home_after_state",
                 "score_away_after_state", "server_side_after")
    else:
        raise ValueError(f"a scoreboard is taken before or after a rally, not {state!r}")
    set_no, hs, as_, hp, ap = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names[:5])
    side = F.coalesce(F.col(names[5]), F.lit("unknown"))
    diff, total = hp - ap, hp + ap
    late = ((set_no < 5) & (total >= 38)) | ((set_no == 5) & (total >= 20))
    deuce = ((hp >= 24) | (ap >= 24)) & (F.abs(diff) <= 1)
    as_number = lambda c: c.cast("double")
    return {
        "set_number": set_no, "home_sets": hs, "away_sets": as_, "home_points": hp,
        "away_points": ap, "home_score_diff": diff, "total_points": total,
        "home_server": as_number(side == "home"), "away_server": as_number(side == "away"),
        "is_fifth_set": as_number(set_no == 5), "is_late_set": as_number(late),
        "is_deuce_or_later": as_number(deuce),
        **{f"server_{s}": as_number(side == s) for s in SIDES},
    }


def valid_rallies(rallies: DataFrame) -> DataFrame:
    """Rallies fit for training: exactly one point, contest result known."""
    return rallies.filter(
        (F.col("point_delta_total") == 1)
        & F.col("home_match_win").isNotNull() & F.col("home_sets_total").isNotNull()
    )


def time_split(rallies: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    return ordered.chronological_split(
        rallies, "contestid", "date", ["set_no", "rally_id"], ["season"],
        cfg.train_fraction, cfg.valid_fraction,
    )


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def dot(coefficients: Column, inputs: list[Column]) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(inputs):
        out = out + F.get(coefficients, F.lit(i)) * x
    return out


# --- win probability --------------------------------------------------------

def training_rows(rallies: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Scoreboard inputs and label of all rallies of the training contests, or of at most ``wp_max_rallies`` a season if that is set."""
    valid = valid_rallies(rallies)
    split = time_split(valid, cfg)
    train = valid.join(split, ["season", "contestid"]).filter(F.col("split") == "train")
    if cfg.wp_max_rallies > 0:
        train = shape.sample_rows(train, RALLY_KEY, cfg.wp_max_rallies, ["season"])
    state = wp_state("before")
    return train.select(
        "season", F.col("home_match_win").cast("double").alias("label"),
        *[c.alias(n) for n, c in state.items()],
    )


def wp_states(train: DataFrame) -> DataFrame:
    """Training rallies of equal state and label combined, with their number as weight."""
    return train.groupBy("season", "label", *WP_INPUTS).agg(F.count(F.lit(1)).alias("w"))


def _state_blocks(states: DataFrame):
    return optimise.blocks(states, "season", [F.col(c) for c in WP_INPUTS], [F.col("label")], F.col("w"))


def _seasons(states: DataFrame) -> list[str]:
    """Season texts are checked on the way in, so there are at most 10,000."""
    return [r["season"] for r in states.select("season").distinct().collect()]


def fit_logistic(train: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """L2 logistic (C = 1) per season on standardised inputs, all seasons at once.

    Returns one row per season with intercept and coefficients on the raw scale. Rallies of equal state are one
    weighted row; a round of the fit is one sum over the states, with or without a training cap.
    """
    states = stable(wp_states(train))
    data = _state_blocks(states)
    scale = optimise.scales(data, {s: [s] for s in _seasons(states)}, len(WP_INPUTS), len(WP_FEATURES))
    fits = optimise.logistic(data, {k: optimise.Wanted(x, 0, [k]) for k, x in scale.items()}, rounds=cfg.logistic_max_iter)
    data.unpersist()
    return train.sparkSession.createDataFrame(
        [(season, f.intercept, f.coefficients) for season, f in sorted(fits.items())],
        "season string, intercept double, coefficients array<double>")


def optimality(
    rows: DataFrame, models: DataFrame, keys: list[str], inputs: dict[str, Column], label: Column,
    scaled: int | None = None, linear: bool = False, penalty: Column | float = 1.0,
) -> DataFrame:
    """(keys, input, residual): the gradient of the penalised loss of each model at its training rows.

    On scaled inputs it is sum (prediction - label) * input + penalty * coefficient, without the last part for the
    intercept. The loss is convex, so all residuals are 0 at the optimum and nowhere else. ``models`` has
    (keys, intercept, coefficients) on the raw scale, at most one row per season, role or target; groups
    without coefficients are left out. None of the fitting code is used here.
    """
    names = list(inputs)
    scaled = len(names) if scaled is None else scaled
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    d = rows.select(*keys, label.cast("double").alias("y"), F.array(*[c.cast("double") for c in inputs.values()]).alias("x"))
    scale = d.groupBy(*keys).agg(
        F.array(*[F.avg(at("x", i)) if i < scaled else F.lit(0.0) for i in range(len(names))]).alias("mean"),
        F.array(*[F.stddev_pop(at("x", i)) if i < scaled else F.lit(1.0) for i in range(len(names))]).alias("sd"))
    scale = scale.withColumn("sd", F.zip_with(
        "sd", "mean", lambda s, m: F.when(s > 1e-12 * F.greatest(F.lit(1.0), F.abs(m)), s).otherwise(1.0)))
    penalty = F.lit(penalty) if isinstance(penalty, float) else penalty
    fitted = models.where("coefficients is not null").select(*keys, "intercept", "coefficients", penalty.alias("penalty"))
    known = stable(scale.join(fitted, keys))
    d = d.join(F.broadcast(known), keys)
    z = F.col("intercept") + dot(F.col("coefficients"), [at("x", i) for i in range(len(names))])
    d = d.withColumn("miss", (z if linear else sigmoid(z)) - F.col("y"))
    sums = d.groupBy(*keys).agg(F.sum("miss").alias("intercept"), *[
        F.sum(F.col("miss") * (at("x", i) - at("mean", i)) / at("sd", i)).alias(n) for i, n in enumerate(names)])
    sums = sums.join(F.broadcast(known.drop("intercept")), keys)
    return sums.select(*keys, "intercept", *[
        (F.col(n) + F.col("penalty") * at("coefficients", i) * at("sd", i)).alias(n) for i, n in enumerate(names)
    ]).unpivot(keys, ["intercept", *names], "input", "residual")


def score_logistic(rallies: DataFrame, models: DataFrame) -> DataFrame:
    """Home win probability before and after every rally, all seasons in one pass."""
    d = rallies.join(F.broadcast(models), "season", "left")
    p = {
        f"home_wp_{s}": sigmoid(F.col("intercept") + dot(F.col("coefficients"), list(wp_state(s).values())))
        for s in ("before", "after")
    }
    return d.withColumns(p).drop("intercept", "coefficients")


def fit_mlp(train: DataFrame, cfg: ModelConfig = DEFAULT) -> dict[str, optimise.Network]:
    """Perceptron with rectified units per season, trained by Adam with early stop on the distinct states."""
    states = stable(wp_states(train))
    data = _state_blocks(states)
    scale = optimise.scales(data, {s: [s] for s in _seasons(states)}, len(WP_INPUTS), len(WP_FEATURES))
    nets = optimise.networks(data, scale, cfg.mlp_hidden, cfg.mlp_max_iter, SEED)
    data.unpersist()
    return nets


def score_mlp(rallies: DataFrame, nets: dict[str, optimise.Network]) -> DataFrame:
    """As ``score_logistic`` for the perceptrons; each distinct scoreboard state is scored once.

    Rallies of seasons without a model stay, with null probabilities.
    """
    sides = ("before", "after")
    shared = rallies.sparkSession.sparkContext.broadcast(nets)

    def run(season: pd.Series, state: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=season.index)
        for s, rows in state.groupby(season):
            if s in shared.value:
                out[rows.index] = optimise.chance(shared.value[s], np.stack(rows.to_numpy()))
        return out.astype(object).where(out.notna(), None)

    d = rallies.withColumns({f"__{s}": F.array(*wp_state(s).values()) for s in sides})
    states = d.select("season", F.explode(F.array(*[f"__{s}" for s in sides])).alias("state")).distinct()
    known = stable(states.withColumn("p", F.pandas_udf(run, "double")("season", "state")))
    for s in sides:
        named = known.select("season", F.col("state").alias(f"__{s}"), F.col("p").alias(f"home_wp_{s}"))
        d = d.join(checked_broadcast(named), ["season", f"__{s}"], "left")
    return d.select(*rallies.columns, *[f"home_wp_{s}" for s in sides])


def rally_values(scored: DataFrame) -> DataFrame:
    """Published rally table: probability before, after, and their difference."""
    return scored.select(
        *RALLY_KEY, "date", "home_clean", "away_clean", "point_winner_side", "point_winner_team",
        "point_delta_total", "home_match_win", "home_wp_before", "home_wp_after",
        (F.col("home_wp_after") - F.col("home_wp_before")).alias("home_wpa"),
    )


def win_probability(
    rallies: DataFrame, model: str | Callable[[DataFrame], DataFrame] = "mlp", cfg: ModelConfig = DEFAULT
) -> DataFrame:
    """Fit on the training contests of each season and score every rally.

    ``model`` may also be a function that adds ``home_wp_before`` and ``home_wp_after``.
    """
    if callable(model):
        return rally_values(model(rallies))
    if model not in ("logistic", "mlp"):
        raise ValueError(f"no win-probability model is called {model!r}; there are logistic and mlp")
    train = training_rows(rallies, cfg).cache()
    try:
        if model == "logistic":
            scored = score_logistic(rallies, fit_logistic(train, cfg))
        else:
            scored = score_mlp(rallies, fit_mlp(train, cfg))
    finally:
        train.unpersist()
    return rally_values(scored)


def win_probability_metrics(
    values: DataFrame, rallies: DataFrame, cfg: ModelConfig = DEFAULT
) -> DataFrame:
    """Log loss, Brier and AUC per season and split, on the valid rallies."""
    valid = valid_rallies(rallies)
    d = (
        values.join(valid.select(*RALLY_KEY), RALLY_KEY, "left_semi")
        .join(time_split(valid, cfg), ["season", "contestid"])
    )
    return stats.classifier_metrics(d, ["season", "split"], "home_match_win", "home_wp_before")


# --- expected outcomes ------------------------------------------------------

def fold_of(folds: int) -> Column:
    """The fold of a row; a contest lies in one fold, so no rally helps to predict another of its own match."""
    return F.coalesce(F.pmod(F.col("contestid"), F.lit(folds)), F.lit(0)).cast("int")


def fit_outcomes(
    rows: DataFrame, targets: list[str], features: list[str], row_key: list[str],
    cfg: ModelConfig = DEFAULT, folds: int = 0,
) -> DataFrame:
    """One model per (season, target), all fitted at once on all rows, or on at most ``aux_max_rows`` if that is set.

    Few rows or rows of one class get their mean instead. Coefficients are on the raw scale. A row
    is held once for all of its targets. With ``folds`` there is a model for each fold too, learnt from
    the rows of the other folds of its season (column ``fold``, null without folds).
    """
    sample = shape.sample_rows(rows, row_key, cfg.aux_max_rows, ["season"]) if cfg.aux_max_rows > 0 else rows
    x = [N.finite_or_zero(F.col(c)) for c in features]
    part = fold_of(folds) if folds else F.lit(0)
    sample = stable(sample.select("season", F.concat_ws("/", "season", part.cast("string")).alias("part"),
                                  *[c.alias(f) for c, f in zip(x, features)],
                                  *[F.col(t).cast("double").alias(t) for t in targets]).repartition(parts_for(rows)))
    data = optimise.blocks(sample, "part", [F.col(c) for c in features], [F.col(t) for t in targets], F.lit(1.0))
    k, seasons = len(features), _seasons(sample)
    groups = {(s, f): [f"{s}/{g}" for g in range(folds) if g != f] for s in seasons for f in range(folds)}
    groups = groups or {(s, None): [f"{s}/0"] for s in seasons}
    scale = optimise.scales(data, groups, k, k)
    fitted = lambda s, t: s.n >= cfg.aux_min_rows and 0 < s.positive[t] < s.n
    fits = optimise.logistic(data, {
        (*group, t): optimise.Wanted(s, t, groups[group]) for group, s in scale.items() for t in range(len(targets)) if fitted(s, t)
    }, rounds=cfg.logistic_max_iter)
    data.unpersist()
    out = []
    for (season, fold), s in scale.items():
        for t, target in enumerate(targets):
            rate, f = float(s.positive[t] / s.n), fits.get((season, fold, t))
            out.append((season, fold, target, int(s.n), rate, "logistic" if f else "mean", None if f else rate,
                        f.intercept if f else 0.0, f.coefficients if f else [0.0] * k))
    return rows.sparkSession.createDataFrame(
        out, "season string, fold int, target string, train_rows bigint, positive_rate double, kind string, "
             "constant double, intercept double, coefficients array<double>")


def expected_outcomes(
    rows: DataFrame, targets: list[str], features: list[str], row_key: list[str],
    cfg: ModelConfig = DEFAULT, folds: int = 0,
) -> DataFrame:
    """Add ``expected_<target>`` to every row: by its own season's model, or with ``folds`` by one that never saw its contest.

    Rows of a season whose other folds are empty have null expectations.
    """
    models = fit_outcomes(rows, targets, features, row_key, cfg, folds)
    wide = models.groupBy("season", F.coalesce("fold", F.lit(0)).alias("__fold")).agg(*[
        F.max(F.when(
            F.col("target") == t, F.struct("constant", "intercept", "coefficients")
        )).alias(f"__{t}")
        for t in targets
    ])
    d = rows.withColumn("__fold", fold_of(folds) if folds else F.lit(0)).join(F.broadcast(wide), ["season", "__fold"], "left")
    x = [N.finite_or_zero(F.col(c)) for c in features]
    p = {
        f"expected_{t}": F.coalesce(
            F.col(f"__{t}.constant"),
            sigmoid(F.col(f"__{t}.intercept") + dot(F.col(f"__{t}.coefficients"), x)),
        )
        for t in targets
    }
    return d.withColumns(p).drop("__fold", *[f"__{t}" for t in targets])


def expected_outcome_metrics(scored: DataFrame, targets: list[str]) -> DataFrame:
    long = scored.select("season", F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                 F.col(f"expected_{t}").alias("p")) for t in targets
    ])).alias("t")).select("season", "t.*")
    return stats.classifier_metrics(long, ["season", "target"], "y", "p")


# --- ridge with leave-one-out choice of alpha -------------------------------

ALPHAS = [10.0 ** (-3 + 0.5 * i) for i in range(13)]


def ridge_by_group(
    df: DataFrame, keys: list[str], features: list[str], target: str, trains: Column,
    out: str, min_rows: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Ridge of ``target`` on standardised features, one model per group.

    The penalty with the smallest exact leave-one-out error is taken, using the leverage
    ``1/n + z'(G + alpha I)^-1 z``. Three distributed passes: moments, cross products,
    leave-one-out errors; the driver sees only numbers per group (``keys`` is season and
    role). Groups with fewer than ``min_rows`` training rows get the group mean. ``df`` is
    read several times, so pass a written table.

    Returns the scored frame and one model row per group.
    """
    spark, p = df.sparkSession, len(features)
    x = F.array(*[N.finite_or_zero(F.col(c)) for c in features])
    train = df.filter(trains).select(*keys, x.alias("x"), F.col(target).cast("double").alias("y"))
    at = [F.get(F.col("x"), F.lit(i)) for i in range(p)]
    moments = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
        F.array(*[F.avg(c) for c in at]).alias("mean"),
        F.array(*[F.stddev_pop(c) for c in at]).alias("sd"),
    ).filter(F.col("n") >= min_rows).collect()
    fits = {}
    for r in moments:
        mean, sd = np.array(r["mean"]), np.array(r["sd"])
        sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
        fits[tuple(r[k] for k in keys)] = {"n": r["n"], "y": r["y"], "mean": mean, "sd": sd}

    def groups(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                fit = shared.value.get(key if isinstance(key, tuple) else (key,))
                if fit is not None:
                    z = (np.stack(part["x"].to_numpy()) - fit["mean"]) / fit["sd"]
                    yield key, fit, z, part["y"].to_numpy() - fit["y"]

    key_schema = ", ".join(f"{k} string" for k in keys)
    if fits:
        shared = spark.sparkContext.broadcast(fits)

        def products(batches):
            for key, _, z, y in groups(batches):
                yield pd.DataFrame([[*key, np.concatenate([(z.T @ z).ravel(), z.T @ y]).tolist()]],
                                   columns=[*keys, "v"])

        sums = (
            train.mapInPandas(products, f"{key_schema}, v array<double>")
            .select(*keys, F.posexplode("v").alias("i", "v"))
            .groupBy(*keys, "i").agg(F.sum("v").alias("v"))
            .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("v"))
            .collect()
        )
        for r in sums:
            v = np.array([e["v"] for e in r["v"]])
            fit = fits[tuple(r[k] for k in keys)]
            gram, fit["zy"] = v[: p * p].reshape(p, p), v[p * p:]
            fit["inverse"] = [np.linalg.inv(gram + a * np.eye(p)) for a in ALPHAS]
        shared = spark.sparkContext.broadcast(fits)

        def loo(batches):
            for key, fit, z, y in groups(batches):
                err = []
                for inv in fit["inverse"]:
                    zi = z @ inv
                    leverage = 1.0 / fit["n"] + (zi * z).sum(axis=1)
                    err.append(float((((y - zi @ fit["zy"]) / (1.0 - leverage)) ** 2).sum()))
                yield pd.DataFrame([[*key, err]], columns=[*keys, "v"])

        errors = (
            train.mapInPandas(loo, f"{key_schema}, v array<double>")
            .select(*keys, F.posexplode("v").alias("i", "v"))
            .groupBy(*keys, "i").agg(F.sum("v").alias("v")).collect()
        )
        for r in errors:
            fits[tuple(r[k] for k in keys)].setdefault("loo", {})[r["i"]] = r["v"]
    rows = []
    for key, fit in fits.items():
        best = min(range(len(ALPHAS)), key=lambda i: (fit["loo"][i], i))
        coef = (fit["inverse"][best] @ fit["zy"]) / fit["sd"]
        rows.append((*key, "ridge_cv", float(fit["y"] - (coef * fit["mean"]).sum()),
                     [float(c) for c in coef], float(ALPHAS[best])))
    models = spark.createDataFrame(
        rows, f"{key_schema}, kind string, intercept double, coefficients array<double>, alpha double"
    )
    base = df.groupBy(*keys).agg(
        F.avg(target).alias("__mean"), F.count_if(trains).alias("train_rows")
    )
    models = base.join(F.broadcast(models), keys, "left").withColumn(
        "kind", F.coalesce("kind", F.lit("role_mean"))
    )
    product = F.aggregate(
        F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    scored = df.join(
        F.broadcast(models.select(*keys, "__mean", "intercept", "coefficients")), keys, "left"
    ).withColumn(out, F.coalesce(F.col("intercept") + product, F.col("__mean"))).drop(
        "__mean", "intercept", "coefficients"
    )
    return scored, models.select(*keys, "kind", "train_rows", "alpha", "intercept", "coefficients")
