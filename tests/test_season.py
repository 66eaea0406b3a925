"""The chain as a whole: hot-group form against plain form, publishing, table invariants."""

import pytest
from pyspark.sql import functions as F

from courtlens.catalog.queries import fixed_curve
from courtlens.config import DEFAULT
from courtlens.operators import ordered
from courtlens.plans import credit, firstball, playbyplay, rallies, serving
from courtlens.plans.season import SeasonTables
from courtlens.session import stable
from courtlens.sources import readers, shaped

CFG = DEFAULT.but(min_rallies=3, tabular_min_rallies=1 << 40, aux_min_rows=1 << 40)


def build(spark, sf):
    return SeasonTables(shaped.roster(spark, sf), shaped.player_box(spark, sf), shaped.team_box(spark, sf),
                        shaped.pbp(spark, sf), CFG, fixed_curve)


def rows(df):
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(tuple, df.select(*rounded).collect()), key=repr)


@pytest.fixture(scope="module")
def plain(spark, sf):
    return build(spark, sf)


def test_hot_groups_change_the_plan_and_not_the_rows(spark, sf, plain, monkeypatch):
    assert plain.chunk is None
    monkeypatch.setattr(ordered, "HOT_ROWS", 20)
    hot = build(spark, sf)
    assert hot.chunk == 20
    for name in ("clean_pbp", "rally_table", "rally_pass", "player_event_credit"):
        assert rows(getattr(hot, name)) == rows(getattr(plain, name)), name


def test_log_is_shuffled_once(plain):
    log = playbyplay.clean_pbp(stable(plain.pbp), plain.player_master, plain.teams, chunk=None)
    plan = log._jdf.queryExecution().executedPlan().toString()
    wide = [l for l in plan.split("\n") if "Exchange hashpartitioning(season" in l and "contestid" in l]
    assert len(wide) == 1


def test_written_log_is_never_shuffled_again(spark, plain):
    """Rallies, first contacts, credit and receives read the written log without an exchange of touches or rallies."""
    plain.rally_pass, plain.rally_win_probability, plain.servers, plain.team_phase_context
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, -1)
    try:
        plans = {
            "rallies": rallies.rally_table(plain.clean_pbp),
            "passes": firstball.rally_pass(plain.event_table, plain.rally_table),
            "credit": credit.event_credit(plain.event_table, plain.rally_win_probability),
            "receives": serving.receive_attempts(plain.event_table, plain.rally_table, plain.rally_pass, plain.servers),
        }
        for what, df in plans.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in plan or what == "receives", what
            assert "contestid" not in "".join(l for l in plan.split("\n") if "Exchange hashpartitioning" in l), what
    finally:
        spark.conf.set(name, before)


def test_invariants(plain):
    credit = plain.event_credit
    shares = credit.groupBy(*playbyplay.RALLY_KEY).agg(F.sum("event_weight_share").alias("s"))
    assert shares.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    r = plain.player_rankings
    for keys, rank in ((["season", "role_family"], "role_rank"), (["season"], "overall_rank")):
        g = r.groupBy(*keys).agg(F.max(rank).alias("m"), F.count_distinct(rank).alias("n"))
        assert g.filter("m <> n").count() == 0
    z = r.groupBy("season", "role_family").agg(F.avg("event_value_z").alias("m"), F.stddev_samp("event_value_z").alias("s"))
    assert z.filter(F.abs("m") > 1e-9).count() == 0
    assert z.filter((F.abs(F.col("s") - 1) > 1e-9) & (F.col("s") > 1e-9)).count() == 0
    assert r.filter("overall_score < 0 or overall_score > 100").count() == 0


def test_publish_and_read_back(spark, plain, tmp_path):
    names = {**SeasonTables.PREPROCESSED, **SeasonTables.OUTPUTS}
    written = plain.publish(str(tmp_path), names)
    assert set(written) == set(names) and all(n > 0 for n in written.values())
    for name in ("rally_table", "player_rankings"):
        back = readers.read_table(spark, str(tmp_path), name)
        assert back.count() == written[name]
    one = readers.read_table(spark, str(tmp_path), "event_table", ["season", "event_family"]).filter("season = '2023-2024'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "ReadSchema: struct<event_family:string>" in plan


def test_contest_ids_rebuilt_inside_the_log(spark, sf, plain):
    """One season without ids still gives the same rallies per contest block."""
    p = plain.pbp.withColumn("contestid", F.col("contestid").cast("bigint")).filter("season = '2022-2023'")
    seq = ordered.row_numbers(p.withColumnRenamed("file_row", "event_id"), ["season"],
                              [F.col("contestid"), F.col("set_no"), F.col("event_id")], "file_row")
    with_ids = playbyplay.clean_pbp(seq.drop("event_id"), plain.player_master, plain.teams)
    without = playbyplay.clean_pbp(
        seq.drop("event_id").withColumn("contestid", F.lit(None).cast("string")), plain.player_master, plain.teams)
    assert without.filter("contestid is null").count() == 0
    a = with_ids.groupBy("contestid").agg(F.count(F.lit(1)).alias("n"), F.min("file_row").alias("f"))
    b = without.groupBy("contestid").agg(F.count(F.lit(1)).alias("n"), F.min("file_row").alias("f"))
    assert without.count() == with_ids.count()
    # a block may hold a contest of one team pair and date, never parts of two contests
    both = with_ids.select("file_row", F.col("contestid").alias("real")).join(
        without.select("file_row", F.col("contestid").alias("made")), "file_row")
    assert both.groupBy("made").agg(F.count_distinct("real").alias("n")).filter("n > 1").count() == 0
    assert b.count() >= a.count()
