import random

import pytest
from pyspark.sql import functions as F

from courtlens.operators import ordered, shape, stats

KEYS = ["k"]


def skewed(spark, n=3000, seed=5):
    """One key holds a third of the rows; values are sparse."""
    rng = random.Random(seed)
    rows = [
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 40)}",
         rng.choice([None, None, rng.randint(0, 9)]), rng.randint(0, 3))
        for i in rng.sample(range(10 * n), n)
    ]
    return spark.createDataFrame(rows, "i bigint, k string, v int, w int").repartition(7)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 37, 5000, 10**9])
def test_chunked_scans_equal_plain_windows(spark, chunk):
    d = skewed(spark)
    for op in (
        lambda c: ordered.forward_fill(d, KEYS, "i", {"f": "v"}, c),
        lambda c: ordered.previous(d, KEYS, "i", {"p": "v", "q": "w"}, "has", c),
        lambda c: ordered.running_sum(d, KEYS, "i", {"s": F.col("w")}, c),
        lambda c: ordered.running_sum(d, KEYS, "i", {"s": F.col("w")}, c, inclusive=False),
        lambda c: ordered.segment(d.withColumn("e", F.col("w") == 0), KEYS, "i", "e", "seg", c),
    ):
        assert rows(op(chunk)) == rows(op(None))


def test_chunk_is_chosen_from_the_largest_group(spark):
    d = skewed(spark)
    assert ordered.pick_chunk(d, KEYS, 100) == 100
    assert ordered.pick_chunk(d, KEYS, 10_000) is None


def test_attach_forms_agree(spark):
    d = skewed(spark)
    assert rows(ordered.attach(d, KEYS, {"t": F.sum("w")}, True)) == rows(ordered.attach(d, KEYS, {"t": F.sum("w")}, False))


def test_ranged_scans(spark):
    d = skewed(spark)
    local = d.toPandas()
    got = ordered.row_numbers(d, KEYS, [F.col("w").desc(), F.col("i").asc()], "rn").toPandas()
    want = local.sort_values(["w", "i"], ascending=[False, True])
    want["rn"] = want.groupby("k").cumcount() + 1
    merged = got.merge(want, on="i")
    assert (merged.rn_x == merged.rn_y).all() and len(merged) == len(local)
    got = ordered.dense_rank(d, KEYS, "w", "r").toPandas().merge(
        local.assign(r=local.groupby("k")["w"].rank(method="dense", ascending=False)), on="i")
    assert (got.r_x == got.r_y).all()


def test_keep_first_and_sample(spark):
    d = skewed(spark)
    first = ordered.keep_first(d, ["k"], "i").toPandas().set_index("k")
    local = d.toPandas().sort_values("i").drop_duplicates("k").set_index("k")
    assert (first.i.sort_index() == local.i.sort_index()).all()
    assert shape.sample_rows(d, ["i"], 500).count() == 500
    a = {r.i for r in shape.sample_rows(d, ["i"], 500).collect()}
    b = {r.i for r in shape.sample_rows(d.repartition(3), ["i"], 500).collect()}
    assert a == b
    per = {r.k: r["count"] for r in shape.sample_rows(d, ["i"], 50, ["k"]).groupBy("k").count().collect()}
    size = {r.k: r["count"] for r in d.groupBy("k").count().collect()}
    assert all(per[k] == min(50, n) for k, n in size.items())
    assert shape.sample_rows(d, ["i"], 10**6).count() == d.count()


def test_contest_blocks_keep_real_ids(spark):
    log = [  # order, id, home, set
        (1, None, "a", 1), (2, 77, "a", 1), (3, None, None, 2), (4, None, "a", 1), (5, None, "b", 1), (6, None, "b", 2),
    ]
    d = spark.createDataFrame([("s", *r) for r in log], "season string, i bigint, rid bigint, home string, n int")
    for chunk in (None, 2):
        out = ordered.contest_blocks(d, "i", "rid", ["home"], "n", ["season"], "id", chunk).orderBy("i").collect()
        assert [r.id for r in out] == [77, 77, 77, 2, 3, 3]
        out = ordered.contest_blocks(d, "i", "rid", ["home"], "n", ["season"], "id", chunk, True).orderBy("i").collect()
        assert [r.id for r in out] == [77, 77, 77, -2, -3, -3]


def test_file_row_follows_the_file(spark, tmp_path):
    for name, start in (("b_2023.csv", 1000), ("a_2022.csv", 0)):
        (tmp_path / name).write_text("n\n" + "\n".join(str(start + i) for i in range(400)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = spark.read.option("header", True).csv(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 4
        d = ordered.with_file_row(raw)
        got = [int(r.n) for r in d.orderBy("file_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [*range(400), *range(1000, 1400)]


def test_zscores(spark):
    d = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", None, 5.0), ("b", 2.0, 1.0)], "k string, x double, c double")
    out = {(r.k, r.x): r for r in stats.zscores(d, ["k"], {"z": "x", "zc": "c"}).collect()}
    assert out["b", 2.0].z == 0.0 and all(r.zc == 0.0 for r in out.values())
    assert abs(out["a", None].z + 4 / 3 / (7 / 3) ** 0.5) < 1e-12           # null counts as 0
    loose = {(r.k, r.x): r.z for r in stats.zscores(d, ["k"], {"z": "x"}, null_as_zero=False).collect()}
    assert loose["a", None] is None and abs(loose["a", 1.0] + 0.5 ** 0.5) < 1e-12
