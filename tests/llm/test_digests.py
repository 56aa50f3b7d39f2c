import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import digests


def test_cluster_bounds_and_weight():
    x = np.sort(np.random.default_rng(1).lognormal(0, 3, 20_000))
    m, w = digests.cluster(x, np.ones(len(x)))
    assert w.sum() == len(x) and len(m) <= digests.COMPRESSION + 2
    assert m[0] == x[0] and m[-1] == x[-1] and (np.diff(m) >= 0).all()
    for q in digests.QUANTILES:
        assert abs(np.searchsorted(x, digests.estimate(m, w, q)) / len(x) - q) < digests.RANK_BOUND


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v), str(i % 5) if i % 11 else None, 1) for k in ("a", None, "ties") for i, v in enumerate(rng.normal(size=3000) if k != "ties" else np.repeat([1.0, 2.0], 1500))]
    rows += [("none", None, "1", 1), ("none", float("nan"), "1", 1), ("one", -4.0, "1", 1), ("one", float("inf"), "1", 1)]
    values = spark.createDataFrame(rows, "k string, value double, day string, n int")
    out = digests.percentiles(values, ["k"]).collect()
    assert {r.k for r in out} == {"a", None, "ties", "one"} and all(r.within_bound for r in out)
    assert [r.value for r in out if r.k == "one"] == [-4.0] * 3
    by = digests.percentiles_by(values, ["k"], "day")
    assert by.where("not within_bound").count() == 0
    whole = {(r.k, r["quantile"]): r for r in by.where("day is null").collect()}
    for r in out:
        assert whole[r.k, r["quantile"]].n == r.n
        low, high = whole[r.k, r["quantile"]].rank_low, whole[r.k, r["quantile"]].rank_high
        assert low - r.error_bound * r.n <= r["quantile"] * r.n <= high + r.error_bound * r.n
    assert by.where("day = 'unknown'").count() > 0
    assert digests.percentiles(values.where("false"), ["k"]).count() == 0


def test_merging_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(digests, "MOST_CENTROIDS", 500)
    values = spark.range(50_000).select(F.lit("k").alias("k"), F.rand(3).alias("value")).repartition(12)
    assert all(r.within_bound for r in digests.percentiles(values, ["k"]).collect())
