"""How findings compare with what was put into the cases, and what pairing cost before any rule ran.

A finding and an injection are the same if case, type and place (kind and line, null-safe) are.
Tables: truth (case_id, type, place_kind, place_line, band), found (the same without band),
negatives (case_id, kind, po_line, invoice_line), key (case_id, po_line, invoice_line: the line a
purchase-order line was made from, null for one it was given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import matching, scoring

PLACE = ["case_id", "type", "place_kind", "place_line"]
# The types whose injections have a band, and the kinds of lines built to tempt the matcher.
BANDED = ("price variance", "short-ship", "over-ship", "tax mismatch")
NEGATIVES = ("rounding drift", "just inside", "billed below")


def _met(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Every distinct (case, type, place) of either side with `t` and `f`."""
    both = truth.select(*PLACE, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(*PLACE, F.lit(0).alias("t"), F.lit(1).alias("f")))
    return both.groupBy(*PLACE).agg(F.max("t").alias("t"), F.max("f").alias("f"))


def _every(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")


def type_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """hits, misses, false alarms with precision, recall and F1 of each type; a type without any has a row of zeros."""
    t, f = F.col("t"), F.col("f")
    per = _met(found, truth).groupBy("type").agg(F.sum(t * f).alias("matched"), F.sum(t * (1 - f)).alias("missing"), F.sum((1 - t) * f).alias("spurious"))
    full = _every(found, "type", matching.TYPES).join(per, "type", "left").select("type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "missing", "spurious")])
    return scoring.with_scores(full).withColumnsRenamed({"matched": "hits", "missing": "misses", "spurious": "false_alarms"})


def band_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """`type, band, hits, misses, recall` of injections with a band; every banded type and band has a row."""
    hit = found.select(*PLACE).distinct().withColumn("_hit", F.lit(1))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in PLACE]
    met = truth.where("band is not null").alias("a").join(hit.alias("b"), keys[0] & keys[1] & keys[2] & keys[3], "left").select("a.type", "a.band", F.coalesce("_hit", F.lit(0)).alias("hit"))
    per = met.groupBy("type", "band").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))
    every = _every(found, "type", BANDED).withColumn("band", F.explode(F.array(F.lit("near"), F.lit("far"))))
    full = every.join(per, ["type", "band"], "left").select("type", "band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "misses")])
    return full.select("*", F.round(scoring.ratio(F.col("hits"), F.col("hits") + F.col("misses")), 6).alias("recall"))


def hard_negatives(found: DataFrame, truth: DataFrame, negatives: DataFrame) -> DataFrame:
    """`kind, placed, false_alarms` of the lines built to tempt, met on their purchase-order line or
    the invoice line an extra line for them would be on; `elsewhere` counts the other false alarms."""
    places = F.explode(F.array(F.struct(F.lit("po line").alias("place_kind"), F.col("po_line").alias("place_line")), F.struct(F.lit("invoice line").alias("place_kind"), F.col("invoice_line").alias("place_line"))))
    # Where two share a place the last one listed counts.
    at = negatives.select("case_id", "kind", "po_line", places.alias("_p")).select("case_id", "kind", "po_line", "_p.*").groupBy("case_id", "place_kind", "place_line").agg(F.max_by("kind", "po_line").alias("kind"))
    alarms = _met(found, truth).where("t = 0").join(at, ["case_id", "place_kind", "place_line"], "left").groupBy(F.coalesce("kind", F.lit("elsewhere")).alias("kind")).agg(F.count("*").alias("false_alarms"))
    placed = negatives.groupBy("kind").agg(F.count("*").alias("placed"))
    every = _every(found, "kind", (*NEGATIVES, "elsewhere"))
    return every.join(placed, "kind", "left").join(alarms, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("placed", "false_alarms")])


def clean_case_rate(cases: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: cases nothing was put into, how many of them carry a finding, and their share (0 of none)."""
    clean = cases.select("case_id").distinct().join(truth.select("case_id"), "case_id", "left_anti")
    hit = clean.join(found.select("case_id").distinct().withColumn("_f", F.lit(1)), "case_id", "left")
    sums = hit.agg(F.count("*").alias("clean_cases"), F.count("_f").alias("with_finding"))
    return sums.select("*", F.round(F.coalesce(scoring.share(F.col("with_finding"), F.col("clean_cases")), F.lit(0.0)), 6).alias("rate"))


def crossed_pairs(pairings: DataFrame, key: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: pairings whose purchase-order line was made from an invoice line (keyed), of those
    the ones paired with another (crossed), and of these the ones between lines alike on every
    pairing cell. `lines` are the invoice's lines: case_id, pos, fields. Only those of crossed pairs
    are looked at, and found by their case, as a case's lines lie together."""
    met = pairings.select("case_id", "po_line", F.col("invoice_line").alias("paired")).join(key.where("invoice_line is not null").select("case_id", "po_line", F.col("invoice_line").alias("answers")), ["case_id", "po_line"])
    crossed = met.where("paired <> answers")
    asked = crossed.groupBy("case_id").agg(F.flatten(F.collect_list(F.array("paired", "answers"))).alias("_asked"))
    signs = matching.cells(lines.join(asked, "case_id").where("array_contains(_asked, pos)"), "case_id", "pos").select("case_id", "pos", matching.signature().alias("sign"))
    alike = (
        crossed.join(signs.select("case_id", F.col("pos").alias("paired"), F.col("sign").alias("_a")), ["case_id", "paired"]).join(signs.select("case_id", F.col("pos").alias("answers"), F.col("sign").alias("_b")), ["case_id", "answers"])
        .agg(F.count_if(F.col("_a") == F.col("_b")).alias("alike"))
    )
    sums = met.agg(F.count("*").alias("keyed"), F.count_if(F.col("paired") != F.col("answers")).alias("crossed"))
    return sums.join(alike)  # one row each


def relabeled(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings on a reading's invoice lines moved to the labelled line the line scorer pairs each
    with (null where with none); other places stay. `pairs` has case_id, right (as read), left (as labelled)."""
    moved = found.join(pairs.select("case_id", F.col("right").alias("place_line"), F.col("left").alias("_l")), ["case_id", "place_line"], "left")
    return moved.select(*[(F.when(F.col("place_kind") == "invoice line", F.col("_l")).otherwise(F.col("place_line")).alias("place_line") if c == "place_line" else F.col(c)) for c in found.columns])


def floor_cost(cases: DataFrame, pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row over the first clean case of each document: reading lines the line scorer pairs with
    a labelled one, and of those the ones the matcher left alone because their best candidate was
    below the floor. `cases` has case_id, doc, clean; `pairs` case_id, right; findings as matched."""
    first = cases.where("clean").withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy("case_id"))).where("_n = 1").select("case_id")
    below = findings.where("type = 'extra line' and candidate.reason = 'below the floor'").select("case_id", F.col("place_line").alias("right"), F.lit(1).alias("_b"))
    met = pairs.select("case_id", "right").join(first, "case_id", "left_semi").join(below, ["case_id", "right"], "left")
    return met.agg(F.count("*").alias("paired"), F.count("_b").alias("unpaired"))
