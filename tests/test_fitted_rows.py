"""The queries of fitted tables return every row of their table, not sums over it."""

from pyspark.sql import functions as F

from courtlens.catalog import queries as catalog
from courtlens.plans.roster import PLAYER_KEY


def keys(df):
    return sorted(map(tuple, df.select(*PLAYER_KEY).collect()))


def test_every_passer_with_fitted_expectations(spark, sf):
    got = catalog.QUERIES["serve_receive_value_fitted"](spark, sf)
    assert keys(got) == keys(catalog.tables(spark, sf).passers)
    assert got.where(~F.col("sound")).count() == 0


def test_every_player_with_a_fitted_ranking(spark, sf):
    got = catalog.QUERIES["player_rankings_fitted"](spark, sf)
    assert keys(got) == keys(catalog.tables(spark, sf).player_rankings)
    assert got.where(~F.col("sound") | F.col("misplaced")).count() == 0
