"""Optimal one-to-one assignment of two sides' rows within a case."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best(worth: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the assignment with the greatest total worth, pairs of no worth left out.

    Shortest augmenting paths on integer potentials; of equal choices the earlier column is taken.
    """
    if not worth.size:
        return []
    if worth.shape[0] > worth.shape[1]:
        return sorted((i, j) for j, i in best(worth.T))
    cost = worth.max() - worth.astype(np.int64)
    n, m = cost.shape
    u, v = np.zeros(n, np.int64), np.zeros(m, np.int64)
    row_of = np.full(m, -1)
    for i in range(n):
        far = np.iinfo(np.int64).max // 4
        dist, parent, done = np.full(m, far), np.full(m, -1), np.zeros(m, bool)
        at, column, shortest = i, -1, 0
        while True:
            reach = shortest + cost[at] - u[at] - v
            better = ~done & (reach < dist)
            dist[better], parent[better] = reach[better], column
            column = int(np.where(done, far, dist).argmin())
            shortest = dist[column]
            done[column] = True
            if row_of[column] < 0:
                break
            at = row_of[column]
        for j in np.flatnonzero(done):
            if j != column:
                u[row_of[j]] += shortest - dist[j]
            v[j] -= shortest - dist[j]
        u[i] += shortest
        while True:
            before = parent[column]
            row_of[column] = i if before < 0 else row_of[before]
            if before < 0:
                break
            column = before
    return sorted((int(i), j) for j, i in enumerate(row_of) if i >= 0 and worth[i, j] > 0)


def assign(edges: DataFrame, case: str = "case_id") -> DataFrame:
    """`case, left, right, worth` of each case's assignment; `edges` has case, left, right (longs)
    and worth (a positive long): other pairs are worth nothing.

    An edge that is the only one of both its rows is in every best assignment and is taken in the
    JVM; the rest of a case's edges are gathered into one row and many cases go to a worker at a
    time. A case is one document's table, so its edges are few, however many cases there are.
    """
    edges = edges.where("worth > 0").select(case, "left", "right", "worth")
    per = lambda c: F.count("*").over(W.partitionBy(case, c))
    marked = edges.withColumns({"_l": per("left"), "_r": per("right")})
    sure = marked.where("_l = 1 and _r = 1").select(case, "left", "right", "worth")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (key, left, right, worth)
                for key, lefts, rights, worths in zip(batch[case], batch["left"], batch["right"], batch["worth"], strict=True)
                for left, right, worth in _solve(lefts.tolist(), rights.tolist(), worths.tolist())
            ]
            yield pd.DataFrame(out, columns=[case, "left", "right", "worth"])

    rest = marked.where("_l > 1 or _r > 1").groupBy(case).agg(*[F.collect_list(c).alias(c) for c in ("left", "right", "worth")])
    kind = dict(edges.dtypes)[case]
    return sure.unionByName(rest.mapInPandas(run, f"{case} {kind}, left bigint, right bigint, worth bigint"))


def _solve(lefts: list, rights: list, worths: list) -> list[tuple]:
    """The best pairs of one case's edges, taken apart into parts that share no row."""
    rows = sorted(zip(lefts, rights, worths, strict=True))
    part: dict = {}

    def root(x: tuple) -> tuple:
        while part.setdefault(x, x) != x:
            part[x] = x = part[part[x]]
        return x

    for left, right, _ in rows:
        part[root((0, left))] = root((1, right))
    parts: dict = {}
    for row in rows:
        parts.setdefault(root((0, row[0])), []).append(row)
    out = []
    for own in parts.values():
        if len({r[0] for r in own}) == 1 or len({r[1] for r in own}) == 1:
            out.append(max(own, key=lambda r: r[2]))  # one row has the choice of several
            continue
        at, to = sorted({r[0] for r in own}), sorted({r[1] for r in own})
        i, j = {x: k for k, x in enumerate(at)}, {x: k for k, x in enumerate(to)}
        worth = np.zeros((len(at), len(to)), np.int64)
        for left, right, w in own:
            worth[i[left], j[right]] = w
        out += [(at[x], to[y], int(worth[x, y])) for x, y in best(worth)]
    return out
