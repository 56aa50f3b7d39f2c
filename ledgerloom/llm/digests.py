"""Percentiles of large numeric columns by merging centroid digests, certified by counting.

A digest holds a group's values as (mean, weight) centroids, sorted. Values are clustered under
the size function k(q) = d / (2 pi) * asin(2 q - 1): a centroid may span at most 1 of k, so it is
small near the tails. Digests are merged by clustering their centroids once more, so those of
partitions or days combine in any order. Every estimate is then certified: a second pass counts
the values below it and not above it, which gives the true distance of its rank from the wanted
one.

Partial digests are made on the map side, before any shuffle, and merged in blocks of bounded
size: a group with a third of all rows sends a few centroids per partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

COMPRESSION = 400
#: The stated bound on an estimate's rank error, as a share of its group's values; one value in small groups.
RANK_BOUND = 0.005
BUFFER = 500_000
QUANTILES = (0.5, 0.95, 0.99)
MOST_CENTROIDS = 20_000

DIGEST = "means array<double>, weights array<double>"


def cluster(means: np.ndarray, weights: np.ndarray, compression: float = COMPRESSION) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted (mean, weight) points under the size function."""
    if len(means) <= compression / 8:
        return means, weights
    total = weights.sum()
    upto = np.cumsum(weights)
    # A point belongs to the unit of k in which its middle lies: no unit spans more than 1 of k.
    middle = np.clip((upto - weights / 2) / total, 0.0, 1.0)
    unit = np.floor(compression / (2 * math.pi) * (np.arcsin(2 * middle - 1) + math.pi / 2)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    w = np.add.reduceat(weights, start)
    m = np.add.reduceat(means * weights, start) / w
    # The least and the greatest value stay centroids of their own.
    if weights[0] < w[0]:
        m = np.r_[means[0], (m[0] * w[0] - means[0] * weights[0]) / (w[0] - weights[0]), m[1:]]
        w = np.r_[weights[0], w[0] - weights[0], w[1:]]
    if weights[-1] < w[-1]:
        m = np.r_[m[:-1], (m[-1] * w[-1] - means[-1] * weights[-1]) / (w[-1] - weights[-1]), means[-1]]
        w = np.r_[w[:-1], w[-1] - weights[-1], weights[-1]]
    return m, w


def estimate(means: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The value at rank q, between the centroids whose middles enclose it."""
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(q * weights.sum(), middle, means))


def partial_digests(values: DataFrame, keys: list[str]) -> DataFrame:
    """A digest per group and part of a partition. `values` has the keys (strings, null allowed) and `value`."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def out() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True).sort_values("value", kind="stable")
            made = []
            for key, at in whole.groupby(keys, dropna=False, sort=False).indices.items():
                x = whole["value"].to_numpy()[at]
                m, w = cluster(x, np.ones(len(x)))
                made.append((*[None if k is None or k != k else k for k in (key if isinstance(key, tuple) else (key,))], m, w))
            return pd.DataFrame(made, columns=[*keys, "means", "weights"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BUFFER:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    return values.select(*keys, "value").mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + DIGEST)


def _merge(keys: list[str]):  # noqa: ANN202
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for m, w in zip(batch["means"], batch["weights"], strict=True):
                m, w = np.asarray(m, dtype=float), np.asarray(w, dtype=float)
                order = np.lexsort((w, m))
                pairs.append(cluster(m[order], w[order]))
            out = batch[keys].copy()
            out["means"], out["weights"] = [m for m, _ in pairs], [w for _, w in pairs]
            yield out

    return run


def combine(digests: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per group from any number of digests.

    Groups with more centroids than one task should hold are merged in blocks first, so often as
    needed; a block holds about MOST_CENTROIDS.
    """
    schema = ", ".join(f"{k} string" for k in keys) + ", " + DIGEST
    lists = [F.flatten(F.collect_list("means")).alias("means"), F.flatten(F.collect_list("weights")).alias("weights")]
    digests = cut(digests.select(*keys, "means", "weights"))
    while True:
        most = digests.groupBy(*keys).agg(F.sum(F.size("means")).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 2 * MOST_CENTROIDS:
            return digests.groupBy(*keys).agg(*lists).mapInPandas(_merge(keys), schema)
        blocks = -(-most // MOST_CENTROIDS)
        salted = digests.withColumn("_block", F.pmod(F.xxhash64("means", "weights"), F.lit(blocks)))
        digests = cut(salted.groupBy(*keys, "_block").agg(*lists).mapInPandas(_merge(keys), schema))


def certified(values: DataFrame, digests: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Estimates of each group's quantiles and their true rank error, by a pass that counts.

    Gives keys, quantile, value, n, rank_low (values below the estimate), rank_high (values not
    above it), rank_error (distance of q * n from those ranks, as a share of n), error_bound and
    within_bound. The bound is RANK_BOUND, or one value where that is more.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[estimate(np.asarray(m), np.asarray(w), q) for q in quantiles] for m, w in zip(batch["means"], batch["weights"], strict=True)]
            yield batch[keys].assign(estimates=found)

    asked = cut(digests.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", estimates array<double>"))
    few = asked.limit(100_001).count() <= 100_000
    named = [F.col(k).alias(f"_{k}") for k in keys]
    side = asked.select(*named, "estimates")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    counted = values.select(*keys, "value").join(F.broadcast(side) if few else side, same)
    sums = [
        c
        for i in range(len(quantiles))
        for c in (F.count_if(F.col("value") < F.col("estimates")[i]).alias(f"low{i}"), F.count_if(F.col("value") <= F.col("estimates")[i]).alias(f"high{i}"), F.any_value(F.col("estimates")[i]).alias(f"v{i}"))
    ]
    wide = counted.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    long = wide.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"v{i}").alias("value"), F.col(f"low{i}").alias("rank_low"), F.col(f"high{i}").alias("rank_high")) for i, q in enumerate(quantiles)])).alias("_q")).select(*keys, "_q.*", "n")
    wanted = F.col("quantile") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("rank_low") - wanted, wanted - F.col("rank_high")) / F.col("n")
    bound = F.greatest(F.lit(RANK_BOUND), 1 / F.col("n"))
    return long.select(*keys, "quantile", "value", "n", "rank_low", "rank_high", error.alias("rank_error"), bound.alias("error_bound"), (error <= bound).alias("within_bound"))


def _numbers(values: DataFrame, *columns: str) -> DataFrame:
    x = F.col("value").cast("double")
    return cut(values.select(*columns, x.alias("value")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def percentiles(values: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Certified percentiles per group.

    Null, NaN and infinite values are no numbers and are left out; a group without numbers has no
    row. A null key is a group of its own. Repeated values count each time.
    """
    values = _numbers(values, *keys)
    return certified(values, combine(partial_digests(values, keys), keys), keys, quantiles)


def percentiles_by(values: DataFrame, keys: list[str], apart: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Certified percentiles per group and value of `apart` (a string column, as a day), each
    summarised on its own, and, with null in `apart`, per group from those summaries combined.

    Cases as in `percentiles`; a row whose `apart` is null counts under the string `unknown`.
    """
    values = _numbers(values.withColumn(apart, F.coalesce(apart, F.lit("unknown"))), *keys, apart)
    each = cut(combine(partial_digests(values, [*keys, apart]), [*keys, apart]))
    whole = combine(each.drop(apart), keys)
    columns = [*keys, apart, "quantile", "value", "n", "rank_low", "rank_high", "rank_error", "error_bound", "within_bound"]
    apart_rows = certified(values, each, [*keys, apart], quantiles).select(columns)
    return apart_rows.unionByName(certified(values, whole, keys, quantiles).withColumn(apart, F.lit(None).cast("string")).select(columns))
