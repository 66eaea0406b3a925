"""Work is dealt out by the number of rows: scans of one row group, the partitions of a log, texts that share a word."""

import pytest
from pyspark.sql import functions as F

from courtlens.catalog.queries import fixed_curve
from courtlens.config import DEFAULT
from courtlens.functions import text as T
from courtlens.operators import joins, resolve
from courtlens.plans.season import SeasonTables
from courtlens.sources import seasons, shaped


@pytest.fixture
def one_group(spark, tmp_path):
    """A table in one file with one row group, as one task reads it."""
    at = str(tmp_path / "t")
    spark.range(4000).withColumn("v", F.col("id") % 7).coalesce(1).write.parquet(at)
    return spark.read.parquet(at)


def sizes(df):
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_one_row_group_are_dealt_out(one_group, monkeypatch):
    assert joins.dealt_out(one_group, "id") is one_group   # a small table stays as it is
    monkeypatch.setattr(joins, "TASK_ROWS", 400)
    dealt = joins.dealt_out(one_group, "id")
    assert max(sizes(one_group)) == 4000 and max(sizes(dealt)) < 800
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, one_group.collect()))
    assert joins.dealt_out(one_group.limit(0), "id").count() == 0


def test_partitions_of_the_log_follow_its_rows(spark, sf, monkeypatch):
    build = lambda: SeasonTables(shaped.roster(spark, sf), shaped.player_box(spark, sf), shaped.team_box(spark, sf),
                                 shaped.pbp(spark, sf), DEFAULT.but(min_rallies=3), fixed_curve)
    few = build()
    few.rally_table, few.parts
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    many = build()
    assert few.parts == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = few.pbp.count()
    assert many.parts == -(-rows // 50) > few.parts
    assert sorted(map(repr, many.rally_table.collect())) == sorted(map(repr, few.rally_table.collect()))


def test_cleaned_keys_are_known_not_to_be_null(spark):
    d = spark.createDataFrame([("2022-2023", "Ann"), ("2022-2023", None)], "season string, name string")
    d = seasons.checked(d).select("season", T.clean_name(F.col("name")).alias("n"), T.clean_team(F.col("name")).alias("t"))
    assert not any(f.nullable for f in d.schema)
    assert {r["n"] for r in d.collect()} == {"ann", ""}


def test_box_rows_are_not_cleaned_in_front_of_the_shuffle(spark, sf, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    box = seasons.checked(shaped.player_box(spark, sf)).withColumn("p", T.clean_name(F.col("player")))
    known = spark.createDataFrame([("p1-1",)], "p string")
    plan = known.join(box.groupBy("season", "p").count(), "p", "left")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "RLIKE" not in below.split("\n", 1)[1]


def test_texts_that_share_a_word_are_not_moved_by_it(spark):
    names = spark.createDataFrame([(f"team {i} of all",) for i in range(50)], "name string")
    teams = spark.createDataFrame([("all",), ("team 7",)], "team_clean string")
    hits = resolve.inside_hits(names, teams)
    assert "hashpartitioning(word" not in hits._jdf.queryExecution().sparkPlan().toString()
    assert "hashpartitioning(word" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 51
