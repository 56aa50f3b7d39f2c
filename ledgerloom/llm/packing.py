"""Filling packs of fixed capacity with texts: pattern packing by non-negative least squares.

The lengths' histogram decides everything, and its size is bounded by the capacity, not by the
data. Few-document patterns that fill a pack are enumerated over length bins; how often each is
used is the non-negative least squares solution against the histogram, rounded down and kept
within what is there. What is left goes, longest first, where the least space remains, also into
the space patterns leave. The result is a list of runs: "the texts of length L from rank a on go
to the packs from p on". Every text finds its pack by its rank among texts of its length.

Ranks are taken in two steps - within salts of a length, then the salts' offsets - so that a
length a third of all texts share is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

BINS = 256


def nnls(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 with least |ax - b| by the active-set method."""
    x = np.zeros(a.shape[1])
    passive: list[int] = []
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive.append(best)
        while passive:
            columns = a[:, passive]
            s = np.linalg.lstsq(columns.T @ columns, columns.T @ b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[passive] = s
                break
            now = x[passive]
            bad = s <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - s[bad], 1e-300))
            now = now + step * (s - now)
            x[:] = 0
            x[passive] = np.maximum(now, 0)
            passive = [p for p, v in zip(passive, now, strict=True) if v > 1e-12]
    return x


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Each way in which one, two or three bins add up to a full pack."""
    found: list[tuple[int, ...]] = [(bins,)]
    found += [(bins - i, i) for i in range(1, bins // 2 + 1)]
    found += [(bins - i - j, j, i) for i in range(1, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    return found


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first pack, space left in each pack), ranks and packs from 0."""
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c > 0}
    if not left:
        return []
    bins = min(capacity, BINS)
    bin_of = {n: -(-n * bins // capacity) for n in left}
    stock: dict[int, list[int]] = {}
    for n in sorted(left):
        stock.setdefault(bin_of[n], []).append(n)  # the longest is taken first, from the end
    held = np.zeros(bins + 1)
    for n, c in left.items():
        held[bin_of[n]] += c
    ways = patterns(bins)
    a = np.zeros((bins, len(ways)))
    for k, way in enumerate(ways):
        for b in way:
            a[b - 1, k] += 1
    weight = np.where(np.arange(1, bins + 1) > bins // 4, 1.0, 0.1)
    use = nnls(a * weight[:, None], held[1:] * weight, rounds=2 * bins)
    groups: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-use, kind="stable"):
        if use[k] < 1:
            break
        wanted = int(use[k])
        while wanted:
            lengths: list[int] = []
            for b in ways[k]:
                n = next((n for n in reversed(stock.get(b, [])) if left[n] > lengths.count(n)), None)
                if n is None:
                    break
                lengths.append(n)
            if len(lengths) < len(ways[k]):
                break
            many = min(wanted, *(left[n] // lengths.count(n) for n in lengths))
            for n in lengths:
                left[n] -= many
                if not left[n]:
                    stock[bin_of[n]].remove(n)
            groups.append((tuple(lengths), many))
            wanted -= many
    # Best fit of the rest, longest first; open packs are kept by the space they have.
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(group: tuple[tuple[int, ...], int]) -> None:
        space = capacity - sum(group[0])
        if space not in spaces:
            spaces[space] = []
            insort(order, space)
        spaces[space].append(group)

    for group in groups:
        put(group)
    for n in sorted((n for n in left if left[n]), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(order, n)
            if at == len(order):
                fit = capacity // n
                if count >= fit:
                    put(((n,) * fit, count // fit))
                    count %= fit
                else:
                    put(((n,) * count, 1))
                    count = 0
                continue
            space = order[at]
            lengths, many = spaces[space].pop()
            if not spaces[space]:
                del spaces[space], order[at]
            fit = min(space // n, max(1, count // many))
            took = min(many, count // fit)
            put((lengths + (n,) * fit, took))
            if many > took:
                put((lengths, many - took))
            count -= fit * took
    runs, first, rank = [], 0, dict.fromkeys(histogram, 0)
    for space in sorted(spaces):
        for lengths, many in spaces[space]:
            for n in lengths:
                runs.append((n, rank[n], many, first, space))
                rank[n] += many
            first += many
    return runs


PACKED = "pack_name string, pack_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, unused_tokens bigint"


def pack(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Packs of each capacity: their contents and the space left.

    `sizes` has doc_id and n_tokens; `capacities` maps a pack's name to its capacity. A text is
    split only where it alone exceeds the capacity: into full packs and a rest, told apart by
    `piece` and `first_token`. A text without tokens (null or empty) fills nothing: it comes out
    once per capacity with null pack_id and unused_tokens. A doc_id that comes twice is two texts.
    """
    spark = sizes.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for name, c in sorted(capacities.items())])
    cutting = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0).cast("long"))),
        lambda i: F.struct(i.cast("int").alias("piece"), (i * F.col("capacity")).alias("first_token"), F.least(F.col("capacity"), F.col("n_tokens") - i * F.col("capacity")).alias("length")),
    )
    pieces = (
        sizes.select("doc_id", "n_tokens", F.explode(named).alias("_c"))
        .select("doc_id", "n_tokens", "_c.*")
        .select("doc_id", "pack_name", F.explode(cutting).alias("_p"))
        .select("doc_id", "pack_name", "_p.*", F.pmod(F.xxhash64("doc_id", "_p.piece"), F.lit(salts)).alias("salt"))
    )
    counts = cut(pieces.where("length > 0").groupBy("pack_name", "length", "salt").count())
    # Bounded by the sum of the capacities.
    histograms: dict[str, dict[int, int]] = {name: {} for name in capacities}
    for row in counts.groupBy("pack_name", "length").agg(F.sum("count").alias("n")).collect():
        histograms[row["pack_name"]][row["length"]] = row["n"]
    runs: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
    for name, histogram in histograms.items():
        by_length: dict[int, list] = {}
        for length, *run in plan(histogram, capacities[name]):
            by_length.setdefault(length, []).append(run)
        for length, listed in by_length.items():
            starts, _, firsts, spaces = np.array(sorted(listed), dtype=np.int64).T
            runs[name, length] = starts, firsts, spaces
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packs, spaces = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            ranks = batch["rank"].to_numpy()
            for key, at in batch.groupby(["pack_name", "length"]).indices.items():
                starts, firsts, space = shared.value[key[0], int(key[1])]
                k = np.searchsorted(starts, ranks[at], side="right") - 1
                packs[at] = firsts[k] + ranks[at] - starts[k]
                spaces[at] = space[k]
            yield pd.DataFrame({"pack_name": batch["pack_name"], "pack_id": packs, "doc_id": batch["doc_id"], "piece": batch["piece"], "first_token": batch["first_token"], "n_tokens": batch["length"], "unused_tokens": spaces})

    before = W.partitionBy("pack_name", "length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("pack_name", "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("pack_name", "length", "salt").orderBy("doc_id", "piece")
    ranked = (
        pieces.where("length > 0")
        .withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["pack_name", "length", "salt"])
        .select("pack_name", "doc_id", "piece", "first_token", "length", (F.col("offset") + F.col("_rank")).alias("rank"))
    )
    nothing = pieces.where("length = 0").select("pack_name", F.lit(None).cast("long").alias("pack_id"), "doc_id", "piece", "first_token", F.col("length").alias("n_tokens"), F.lit(None).cast("long").alias("unused_tokens"))
    return ranked.mapInPandas(place, PACKED).unionByName(nothing)
