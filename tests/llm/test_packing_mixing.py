import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, packing


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 6)), np.array([0, 2.0, 0, 1, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x, 50), x, atol=1e-6)
    assert packing.nnls(a, -np.ones(12), 50).max() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 512])
def test_plan_places_every_length_once(capacity):
    rng = random.Random(capacity)
    histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(60)}
    runs = packing.plan(histogram, capacity)
    ranks, packs, space = {}, {}, {}
    for n, first, many, pack, left in runs:
        assert ranks.get(n, 0) == first
        ranks[n] = first + many
        for p in range(pack, pack + many):
            packs[p] = packs.get(p, 0) + n
            assert space.setdefault(p, left) == left
    assert ranks == histogram
    assert all(packs[p] + space[p] == capacity for p in packs)
    assert sorted(packs) == list(range(len(packs)))
    tokens = sum(n * c for n, c in histogram.items())
    if capacity >= 64:
        assert len(packs) <= 1.25 * tokens / capacity + 1


def test_pack(spark):
    lengths = [0, 1, 5, 10, 10, 10, 11, 25, 30, 0] + [4] * 50
    sizes = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id bigint, n_tokens bigint, pack_id string")
    out = packing.pack(sizes, {"ten": 10}).toPandas()
    whole = out.groupby("doc_id").n_tokens.sum()
    assert list(whole) == lengths
    pieces = out.groupby("doc_id").size()
    assert all(pieces[i] == max(1, -(-n // 10)) for i, n in enumerate(lengths))
    used = out[out.pack_id.notna()].groupby("pack_id").agg(n=("n_tokens", "sum"), unused=("unused_tokens", "first"))
    assert (used.n + used.unused == 10).all()
    assert packing.pack(sizes.where("false"), {"ten": 10}).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 900, 500).astype(float)
    p = np.full(500, 0.37)
    out = mixing.flight(p, size, rng)
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert mixing.flight(np.full(9, 0.5), np.ones(9), rng).sum() == pytest.approx(4.5)


def test_shares(spark):
    rng = random.Random(5)
    rows = [(i, ["a", "a", "a", "b", None, "unlisted"][i % 6], rng.randint(0, 600), 1) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, repeats int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("missing", 0.2, 4)], "source string, target_weight double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    found = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert found["a"].share_reached == pytest.approx(0.5, abs=0.002) and found["b"].share_reached == pytest.approx(0.5, abs=0.002)
    assert found["a"].most_repeats <= 2 and found["b"].most_repeats == 3
    assert found["missing"].tokens_out == 0 and found[None].texts_out == 0 and found["unlisted"].texts_out == 0
    assert mixed.count() == 6000
    again = mixing.mix(sizes.repartition(7), targets)
    assert mixed.exceptAll(again).count() == 0
    assert mixing.mix(sizes.where("false"), targets).count() == 0
    assert mixing.mix(sizes, targets.where("false")).agg(F.sum("repeats")).first()[0] == 0
