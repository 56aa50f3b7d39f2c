"""Append-only logs of transitions, edits and calls, and lookups in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _seconds(at: str) -> Column:
    return F.col(at).cast("timestamp").cast("double")


def waits(log: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """Each row of a log with the seconds since the row before it of the same key (null for the first)."""
    w = W.partitionBy(key).orderBy(*order)
    return log.withColumn("wait", _seconds(at) - F.lag(_seconds(at)).over(w))


def first_between(log: DataFrame, key: str, at: str, start: Column, end: Column) -> DataFrame:
    """Seconds from a key's first start row to its first end row not before it; keys without both have none.

    One aggregation: the end rows' times are kept sorted per key."""
    t = _seconds(at)
    per = log.groupBy(key).agg(F.min(F.when(start, t)).alias("s"), F.array_sort(F.collect_set(F.when(end, t))).alias("e"))
    first = F.get(F.filter("e", lambda x: x >= F.col("s")), F.lit(0))
    return per.select(key, (first - F.col("s")).alias("seconds")).where("seconds is not null")


def latest_of(log: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The columns of each key's last row, in one pass with map-side combining."""
    return log.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def fold(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Net edits: the last value of each place, left out where it equals what was read.
    `edits` has the keys, read, value and the order column."""
    last = edits.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.any_value("read").alias("read"), F.count("*").alias("edits"))
    return last.where(~F.col("value").eqNullSafe(F.col("read")))


def as_of(rows: DataFrame, rates: DataFrame, key: str, at: str, since: str, rate: str) -> DataFrame:
    """Each row with the rate in force: the last of its key that began at or before `at`.

    Rows and rates are one sorted stream per key, in which the last rate is carried on; no pair is
    formed. Null where no rate was in force yet."""
    marked = rows.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_row"), F.struct(*rows.columns).alias("_r"), F.lit(None).cast(dict(rates.dtypes)[rate]).alias("_rate"))
    sent = rates.select(F.col(key), F.col(since).cast(dict(rows.dtypes)[at]).alias("_at"), F.lit(0).alias("_row"), F.lit(None).cast(marked.schema["_r"].dataType).alias("_r"), F.col(rate).alias("_rate"))
    w = W.partitionBy(key).orderBy("_at", "_row").rowsBetween(W.unboundedPreceding, 0)
    return marked.unionByName(sent).withColumn(rate, F.last("_rate", ignorenulls=True).over(w)).where("_row = 1").select("_r.*", rate)


def new_only(arrived: DataFrame, known: DataFrame, digest: str = "digest", order: str = "id") -> DataFrame:
    """Rows whose content is not known yet, the first of each digest: the batch form of an insert
    if absent. The known table is met on the digest, so it may be of any size."""
    w = W.partitionBy(digest).orderBy(order)
    return arrived.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(known.select(digest), digest, "left_anti")
