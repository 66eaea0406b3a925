"""No default cap: models and rates come from all rows, however many a season has."""

import pytest
from pyspark.sql import functions as F

from courtlens.catalog import queries as catalog
from courtlens.plans import models, playbyplay, serving
from courtlens.session import stable

ATTEMPTS = 300_500
CONTESTS, RALLIES = 1_000, 730   # 700 contests train, with 511,000 rallies


@pytest.fixture(scope="module")
def attempts(spark):
    """Attempts of one season; two in five of the last 500, and no other, were errors."""
    i = F.col("id")
    return stable(spark.range(ATTEMPTS, numPartitions=8).select(
        F.lit("2024-2025").alias("season"), (i % 900).alias("contestid"), F.lit(1).alias("set_no"), i.alias("rally_id"),
        F.concat(F.lit("team "), i % 3).alias("team_clean"), F.lit("a").alias("player_clean"), F.lit("A").alias("player"),
        *[(i % (k + 3)).cast("double").alias(c) for k, c in enumerate(serving.SR_FEATURES)],
        *[((i % 7 == k) if k else (i >= ATTEMPTS - 500) & (i % 5 < 2)).alias(t) for k, t in enumerate(serving.SR_TARGETS)]))


def test_outcome_metrics_rest_on_every_attempt(attempts):
    """the mean expectation of all attempts is their rate, to which that of a sample comes only close."""
    features = serving.SR_FEATURES[:2]
    fit = models.fit_outcomes(attempts, ["reception_error"], features, playbyplay.RALLY_KEY, catalog._FITTED).first()
    assert (fit.train_rows, fit.kind) == (ATTEMPTS, "logistic") and fit.positive_rate == pytest.approx(200 / ATTEMPTS, rel=1e-12)


def test_components_rest_on_every_attempt(attempts):
    """the shrunk value behind the components is 0 for a passer with all attempts, as expectations are rates of all."""
    one = serving.serve_receive_value(attempts.withColumn("team_clean", F.lit("t")), catalog._TEST).first()
    assert one.sr_attempts == ATTEMPTS and one.sr_shrunk_value == pytest.approx(0, abs=1e-6)


def test_passers_rest_on_every_attempt(attempts):
    """with rates of all attempts as expectation, the expected errors of a season add up to the errors."""
    passers = serving.serve_receive_value(attempts, catalog._TEST)
    assert passers.agg(F.sum("sr_expected_reception_errors")).first()[0] == pytest.approx(200, rel=1e-9)


def test_fitted_passers_rest_on_every_attempt(attempts):
    """so do those of the fitted models, through their free intercept."""
    passers = serving.serve_receive_value(attempts, catalog._FITTED)
    assert passers.agg(F.sum("sr_expected_reception_errors")).first()[0] == pytest.approx(200, rel=1e-6)


@pytest.fixture(scope="module")
def rallies(spark):
    """Rallies of one season with a plain scoreboard."""
    i, n = F.col("id"), lambda c: c.cast("int")
    contest = (i / RALLIES).cast("bigint")
    return stable(spark.range(CONTESTS * RALLIES, numPartitions=8).select(
        F.lit("2024-2025").alias("season"), contest.alias("contestid"), n(i % 5 + 1).alias("set_no"), n(i % RALLIES).alias("rally_id"),
        F.lit(None).cast("string").alias("date"), F.lit(1).alias("point_delta_total"), F.lit(3).alias("home_sets_total"),
        n((i % 3 + contest) % 2).alias("home_match_win"), n(i % 2).alias("home_sets_before"), n(i % 3).alias("away_sets_before"),
        n(i % 25).alias("score_home_start"), n(i % 23).alias("score_away_start"),
        F.when(i % 2 == 0, "home").otherwise("away").alias("server_side")))


TRAINED = 700 * RALLIES


@pytest.fixture(scope="module")
def train(rallies):
    return stable(models.training_rows(rallies, catalog._FITTED))


def test_rankings_rest_on_every_training_rally(train):
    """F8: the win probability behind the fitted rankings."""
    assert train.count() == TRAINED


def test_fitted_chances_add_up_to_all_wins(rallies, train):
    """over all rallies of the training contests, not over a sample of them."""
    split = models.time_split(models.valid_rallies(rallies), catalog._FITTED).where("split = 'train'")
    rows = rallies.join(split, ["season", "contestid"]).withColumns({
        f"{c}_{s}": F.lit(0) for c in ("home_sets", "away_sets") for s in ("after",)} | {
        "set_after": F.lit(1), "score_home_after_state": F.lit(0), "score_away_after_state": F.lit(0), "server_side_after": F.lit("home")})
    got = models.score_logistic(rows, models.fit_logistic(train, catalog._FITTED)).agg(F.sum("home_wp_before"), F.sum("home_match_win")).first()
    assert got[0] == pytest.approx(got[1], abs=1e-2)


def test_logistic_states_hold_every_training_rally(train):
    """the states that the logistic model is fitted on."""
    assert models.wp_states(train).agg(F.sum("w")).first()[0] == TRAINED


def test_perceptron_is_given_every_training_rally(train, monkeypatch):
    """the weights of the blocks that the perceptron is trained on."""
    seen = []
    monkeypatch.setattr(models.optimise, "networks", lambda data, scale, *_: seen.extend(s.n for s in scale.values()))
    models.fit_mlp(train, catalog._FITTED)
    assert seen == [TRAINED]


def test_training_wins_of_the_perceptron_are_all_wins(rallies, train):
    """the loss of the perceptron is measured over all training rallies, and it learns from as many wins."""
    split = models.time_split(models.valid_rallies(rallies), catalog._FITTED).where("split = 'train'")
    want = rallies.join(split, ["season", "contestid"]).agg(F.sum("home_match_win")).first()[0]
    assert models.wp_states(train).where("label = 1").agg(F.sum("w")).first()[0] == want
