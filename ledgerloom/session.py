"""Session helpers: table access, record identity, lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: the driver serves it to them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """One row per `key`: the row delivered last.

    Rows without a key name no record and are left out. Rows alike in `at` are ordered by all
    their values, so the choice never depends on the partitioning. Select the needed columns
    before the call: only those are shuffled.
    """
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    w = W.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), rest)
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(w))
        .where("_rank = 1")
        .drop("_rank")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir, else (tests
    on one machine) a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder and forget how it was made: what follows survives the
    loss of executors and reads it as often as it likes."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
