"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "courtlens", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # tables spread by some of the keys of a join need not be spread again (see laid_out)
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="courtlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; ``close`` removes it."""
    return f"{shared_folder(spark)}/courtlens/{spark.sparkContext.applicationId}"


def close(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; call it when results are saved."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_LAID_OUT):
            spark.sql(f"drop table if exists `{t.name}`")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the run folder and read it back.

    Cuts the lineage where a table is read several times or where a partition number
    must not change on recomputation. The files outlive any executor, stay columnar, and
    give Spark the true size of the table for its join choices.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LAID_OUT = "courtlens_laid_out_"


def laid_out(df: DataFrame, keys: list[str], order: list[str], spread: bool = True, parts: int | None = None) -> DataFrame:
    """As ``stable``, and the table keeps its layout: rows of equal ``keys`` lie in one bucket, sorted.

    Aggregates and windows by these keys and any more, and joins of two such tables on them and any more,
    then need no shuffle. There are ``parts`` buckets, else as many as shuffle partitions; give tables that are to be joined the same number. Say ``spread=False`` for a table that comes
    from such a table without a shuffle. The files lie in the run folder; the catalog only holds their names.
    No bucket is cut, so use it where no key holds a large share of all rows.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = uuid.uuid4().hex
    (df.repartition(n, *keys) if spread else df).write.bucketBy(n, *keys).sortBy(*keys, *order).option(
        "path", f"{run_folder(spark)}/{name}").saveAsTable(f"{_LAID_OUT}{name}", format="parquet")
    return spark.table(f"{_LAID_OUT}{name}")
