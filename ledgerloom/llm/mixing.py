"""Mixing sources to target weights by cube-method balanced sampling.

The largest mixture in which every source has exactly its share and none is repeated beyond its
cap fixes each source's mean number of repeats. Its whole part is given to every text of the
source; the fraction is each text's inclusion probability. The flight phase moves these
probabilities, within blocks of bounded length, along directions that change neither the expected
number of texts nor the expected number of tokens, until all but two of a block are 0 or 1. What
is left of all blocks is put into blocks again, until one block a source is left. Its last two and
a small reserve of texts kept out of the flight are the landing problem: the error of rounding the
two is made up for by the reserve.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

BLOCK = 4096
RESERVE = 256
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sum(p) and sum(p * size) kept, at most two left fractional."""
    p = p.copy()
    draws = iter(rng.random(len(p) + 1))
    window: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            window.append(k)
        while len(window) == 3:
            a, b, c = window
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(window, u, strict=True) if v)
            down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(window, u, strict=True) if v)
            go = up if next(draws, 0.5) < down / (up + down) else -down
            for i, v in zip(window, u, strict=True):
                p[i] += go * v
            window = [i for i in window if EPS < p[i] < 1 - EPS]
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Outcomes of the units left over: the largest first, each one's error carried to the rest.

    The largest two are rounded to the nearer outcome, the smallest ones to what the tokens still
    wanted ask for; those between are drawn with the rate still wanted.
    """
    p = p.copy()
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    left = left[np.argsort(-size[left], kind="stable")]
    wanted, there = float(p[left] @ size[left]), float(size[left].sum())
    for k, i in enumerate(left):
        rate = min(1.0, max(0.0, wanted / there))
        if k < 2:
            p[i] = float(p[i] >= 0.5)
        elif k >= len(left) - 10:
            p[i] = float(wanted > size[i] / 2)
        else:
            p[i] = float(rng.random() < rate)
        wanted -= p[i] * size[i]
        there -= size[i]
    return p


FLOWN = "doc_id bigint, source string, n_tokens bigint, p double"


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Mean repeats of each listed source that occurs, in the largest mixture its caps allow."""
    there = {s: (w, m) for s, (w, m) in targets.items() if totals.get(s, 0) > 0 and w > 0 and m > 0}
    if not there:
        return {}
    whole = sum(w for w, _ in there.values())
    size = min(m * totals[s] * whole / w for s, (w, m) in there.items())
    return {s: min(float(m), size * w / whole / totals[s]) for s, (w, m) in there.items()}


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """`doc_id, source, n_tokens, repeats` of every text.

    `sizes` has doc_id, source, n_tokens; `targets` source, target_weight, max_repeats, one small
    row a source (its largest weight counts if listed twice). Weights are taken over the listed
    sources that occur with tokens; those that do not occur can contribute nothing. Texts of
    unlisted or null sources and texts without tokens have 0 repeats. No text's repeats exceed
    its source's cap. The same seed gives the same mixture on any partitioning.
    """
    sizes = sizes.select("doc_id", "source", "n_tokens")
    listed = targets.where("source is not null and target_weight > 0 and max_repeats > 0").groupBy("source").agg(F.max_by(F.struct("target_weight", "max_repeats"), "target_weight").alias("t")).select("source", "t.*")
    wanted = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in listed.collect()}
    full = sizes.where("n_tokens > 0")
    # One row a listed source; the sources are as many as the table of targets lists.
    found = full.join(F.broadcast(listed.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")).collect()
    totals, texts = {r["source"]: r["tokens"] for r in found}, {r["source"]: r["texts"] for r in found}
    rate = rates(totals, wanted)
    parts = {s: (math.floor(r + EPS), max(0.0, r - math.floor(r + EPS))) for s, r in rate.items()}
    whole = F.lit(0)
    reserve, n_texts = F.lit(0), F.lit(1)
    fraction = F.lit(0.0)
    blocks = F.lit(1)
    for s, (base, share) in parts.items():
        here = F.col("source") == s
        whole = F.when(here, F.lit(base)).otherwise(whole)
        fraction = F.when(here, F.lit(share)).otherwise(fraction)
        blocks = F.when(here, F.lit(-(-texts[s] // BLOCK))).otherwise(blocks)
        n_texts = F.when(here, F.lit(texts[s])).otherwise(n_texts)
        reserve = F.when(here, F.lit(min(RESERVE, -(-texts[s] // 4)))).otherwise(reserve)
    most = max([-(-n // BLOCK) for n in texts.values()], default=1)

    def fly(last: bool):  # noqa: ANN202
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n_tokens", "h", "doc_id"], ascending=[False, True, True], kind="stable")
            name = sum((i + 1) * b for i, b in enumerate(str(key[0]).encode()))
            p, size = group["p"].to_numpy(dtype=float), group["n_tokens"].to_numpy(dtype=float)
            rng = np.random.default_rng([seed, name, int(key[1])])
            flown = ~group["reserved"].to_numpy(dtype=bool)
            p[flown] = flight(p[flown], size[flown], rng)
            if last:
                p = landing(p, size, rng)
            return pd.DataFrame({"doc_id": group["doc_id"], "source": group["source"], "n_tokens": group["n_tokens"], "p": np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))})

        return run

    h = F.xxhash64("doc_id", F.lit(seed))
    open_texts = full.select("*", fraction.alias("p"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), n_texts) < reserve).alias("reserved")).where(F.col("p") > 0)
    going = open_texts.where("not reserved")
    chosen = None
    while True:
        last = most <= 1
        if last:
            going = going.unionByName(open_texts.where("reserved"))
        block = F.lit(0).cast("long") if last else F.pmod(h, blocks)
        flown = cut(going.withColumns({"h": h, "block": block}).groupBy("source", "block").applyInPandas(fly(last), FLOWN))
        settled = flown.where("p = 1").select("doc_id", "source")
        chosen = settled if chosen is None else chosen.unionByName(settled)
        if last:
            break
        going = flown.where("p > 0 and p < 1").withColumn("reserved", F.lit(False))
        blocks, most = F.ceil(blocks / (BLOCK // 2)), -(-most // (BLOCK // 2))
    extra = chosen.groupBy("doc_id", "source").agg(F.count("*").alias("extra"))
    out = sizes.join(extra, ["doc_id", "source"], "left")
    repeats = F.when(F.col("n_tokens") > 0, whole).otherwise(0) + F.coalesce("extra", F.lit(0))
    return out.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: its texts and tokens, what it gives to the mixture, its target share and the share reached."""
    own = mixed.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("repeats").cast("long").alias("texts_out"),
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_out"),
        F.max("repeats").alias("most_repeats"),
    )
    own = own.withColumn("total", F.sum("tokens_out").over(W.partitionBy(F.lit(1))))  # one row a source
    return (
        targets.groupBy("source").agg(F.max_by(F.struct("target_weight", "max_repeats"), "target_weight").alias("t")).select("source", "t.*")
        .join(own, "source", "full")
        .select(
            "source", "target_weight", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "tokens", "texts_out", "tokens_out", "most_repeats")],
            F.coalesce(F.try_divide("tokens_out", "total"), F.lit(0.0)).alias("share_reached"),
        )
    )
