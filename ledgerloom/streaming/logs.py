"""Structured Streaming forms of the log operators: counts, last states, content deduplication.

Each runs what has arrived (`availableNow`) and returns the result as a table; in production the
same functions take another trigger. State and output live in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.session import shared_folder


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema they have."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run(stream: DataFrame, mode: str, write) -> str:  # noqa: ANN001
    """Run a stream to the end of what has arrived; each batch is written under its number, so a
    batch that is run again replaces itself."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def batch(df: DataFrame, number: int) -> None:
        write(df, number, f"{folder}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/out"


def _append(df: DataFrame, number: int, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per event-time window and group; a window is final once the watermark has passed it,
    and what was counted so far is replaced until then."""
    spark = events.sparkSession
    counts = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).groupBy(F.window("_at", window), by).agg(F.count("*").alias("n"))
    path = _run(counts.select(F.col("window.start").alias("start"), by, "n"), "update", _append)
    return spark.read.parquet(path).groupBy("start", by).agg(F.max_by("n", "batch").alias("n"))


def last_states(events: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Each key's last value by `order`, kept as state from batch to batch; rows may come in any
    order. Key and order are longs, the value a string."""
    spark = events.sparkSession

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, value = state.get if state.exists else (None, None)
        for batch in batches:
            if len(batch):
                last = batch.loc[batch[order].idxmax()]
                if at is None or last[order] > at:
                    at, value = int(last[order]), last[column]
        state.update((at, value))
        yield pd.DataFrame({key: [k[0]], order: [at], column: [value]})

    schema = f"{key} bigint, {order} bigint, {column} string"
    kept = events.select(key, order, column).groupBy(key).applyInPandasWithState(step, schema, f"{order} bigint, {column} string", "update", GroupStateTimeout.NoTimeout)
    path = _run(kept, "update", _append)
    return spark.read.parquet(path).groupBy(key).agg(F.max_by(column, order).alias(column))


def first_seen(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """Rows whose content has not been seen, the first of each batch; what is known is the table
    written so far, which never forgets, unlike a watermark."""
    spark = rows.sparkSession

    def write(df: DataFrame, number: int, path: str) -> None:
        fresh = df.groupBy(digest).agg(F.min(order).alias(order))
        known = [n for n in range(number) if _there(spark, f"{path}/batch={n}")]
        for n in known:
            fresh = fresh.join(spark.read.parquet(f"{path}/batch={n}").select(digest), digest, "left_anti")
        _append(fresh, number, path)

    return spark.read.parquet(_run(rows, "append", write)).select(digest, order)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
