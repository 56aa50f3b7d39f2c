"""Scoring of readings against labels, and the statistics over the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import normalize
from ledgerloom.session import cut


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 1 where there is nothing to get wrong."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def share(count: Column, n: Column) -> Column:
    """count / n, null on n = 0."""
    return count / F.nullif(n, F.lit(0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def field_flags(labeled: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct comparable values of both sides, met on keys, fieldtype and value:
    keys, fieldtype, norm, gold, guess. Blank values are absent. Both sides have keys, fieldtype, text."""
    norm = normalize.comparable(F.col("fieldtype"), F.col("text"))
    side = lambda df, gold: df.select(*keys, "fieldtype", "text", F.lit(gold).alias("gold"), F.lit(1 - gold).alias("guess"))
    # One shuffle, on the keys: the grouping below keeps that partitioning, and values are made
    # comparable after it, in parallel however few files they came from.
    both = side(labeled, 1).unionByName(side(read, 0)).repartition(*keys).withColumn("norm", norm)
    # Blanks go after the grouping: a filter on the key would be pushed below it and make every value comparable twice.
    return both.groupBy(*keys, "fieldtype", "norm").agg(F.max("gold").alias("gold"), F.max("guess").alias("guess"), F.max(F.length("norm")).alias("_n")).where("_n > 0").drop("_n")


def counted(flags: DataFrame, by: list[str]) -> DataFrame:
    """matched, missing and spurious values, with precision, recall and F1."""
    sums = flags.groupBy(*by).agg(
        F.sum(F.col("gold") * F.col("guess")).alias("matched"),
        F.sum(F.col("gold") * (1 - F.col("guess"))).alias("missing"),
        F.sum((1 - F.col("gold")) * F.col("guess")).alias("spurious"),
    )
    return with_scores(sums)


def with_scores(sums: DataFrame) -> DataFrame:
    precision = ratio(F.col("matched"), F.col("matched") + F.col("spurious"))
    recall = ratio(F.col("matched"), F.col("matched") + F.col("missing"))
    return sums.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1(precision, recall), 6).alias("f1"))


# Each gross fieldtype beside its net one; the classes of errors in report order.
NET_FOR_GROSS = {
    "amount_total_gross": "amount_total_net", "tax_detail_gross": "tax_detail_net", "line_item_amount_gross": "line_item_amount_net", "line_item_unit_price_gross": "line_item_unit_price_net",
}
VALUE_CLASSES = ("net for gross", "gross for net", "misread date", "wrong", "missing", "spurious")
ROW_CLASSES = ("wrong row", "missing row", "spurious row")
OTHER_FIELDTYPE = "other fieldtype"


def value_errors(flags: DataFrame, keys: list[str], known: list[str] | None = None) -> DataFrame:
    """`keys, class, fieldtype, n`: missing and spurious values told apart, scope by scope.

    A value labelled under one of a gross and net pair and read under the other is filed beside it;
    of what is left of a fieldtype in a scope, pairs are `wrong` (`misread date` of a date) and the
    rest `missing` or `spurious`. Every class adds back to its side's misses. Fieldtypes outside
    `known` are counted as one. One grouping by value and one by fieldtype, both on the scope.
    """
    family = F.create_map(*[F.lit(x) for g, n in NET_FOR_GROSS.items() for x in (n, g)])
    off = flags.where("gold <> guess").select(*keys, "fieldtype", "norm", (F.col("gold") == 1).alias("_missing"), F.coalesce(family[F.col("fieldtype")], F.col("fieldtype")).alias("_family"))
    gross = F.col("fieldtype") == F.col("_family")
    w = W.partitionBy(*keys, "_family", "norm")
    met = lambda a, b: (F.max(F.when(a, 1).otherwise(0)).over(w) == 1) & (F.max(F.when(b, 1).otherwise(0)).over(w) == 1)
    missing = F.col("_missing")
    ng, gn = met(missing & gross, ~missing & ~gross), met(missing & ~gross, ~missing & gross)
    filed = F.when(F.when(missing, gross).otherwise(~gross), ng).otherwise(gn)
    per = off.withColumn("_filed", filed).groupBy(*keys, "fieldtype").agg(
        F.count_if(missing & ~F.col("_filed")).alias("m"), F.count_if(~missing & ~F.col("_filed")).alias("s"), F.count_if(missing & F.col("_filed")).alias("f")
    )
    pairs = F.least("m", "s")
    date = F.col("fieldtype").isin(*normalize.DATE_FIELDTYPES)
    beside = F.when(F.col("fieldtype").isin(*NET_FOR_GROSS), "net for gross").otherwise("gross for net")
    shown = F.col("fieldtype") if known is None else F.when(F.col("fieldtype").isin(*known), F.col("fieldtype")).otherwise(OTHER_FIELDTYPE)
    classes = [(beside, F.col("f")), (F.when(date, "misread date").otherwise("wrong"), pairs), (F.lit("missing"), F.col("m") - pairs), (F.lit("spurious"), F.col("s") - pairs)]
    listed = per.select(*keys, shown.alias("fieldtype"), F.explode(F.array(*[F.struct(c.alias("class"), n.alias("n")) for c, n in classes])).alias("_c")).where("_c.n > 0")
    return listed.select(*keys, "_c.class", "fieldtype", "_c.n").groupBy(*keys, "class", "fieldtype").agg(F.sum("n").alias("n"))


def error_classes(flags: DataFrame, keys: list[str], known: list[str] | None = None) -> DataFrame:
    """`class, fieldtype, n, documents`: value errors over all scopes, and the documents (the first key) with any."""
    return value_errors(flags, keys, known).groupBy("class", "fieldtype").agg(F.sum("n").alias("n"), F.countDistinct(keys[0]).alias("documents"))


def ranked_errors(errors: DataFrame) -> DataFrame:
    """Errors with `place`: most first, then by class in report order, then by fieldtype."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(VALUE_CLASSES) for x in (c, i)])
    return errors.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), order[F.col("class")], "fieldtype")))  # a row a class and fieldtype


def error_totals(classes: DataFrame) -> DataFrame:
    """One row: the false negatives and false positives that classes (class, n) stand for."""
    spurious, missing = F.col("class").isin("spurious", "spurious row"), F.col("class").isin("missing", "missing row")
    total = lambda c: F.coalesce(F.sum(F.when(~c, F.col("n"))), F.lit(0))
    return classes.agg(total(spurious).alias("false_negatives"), total(missing).alias("false_positives"))


def judged_values(written: DataFrame, confidence: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, fieldtype, norm, confidence, correct`: each distinct value read, at its highest
    confidence (null where it has none), and whether it was matched.

    `written` and `confidence` have keys, fieldtype, pos and text or confidence: they meet by
    position before blanks are dropped."""
    met = written.join(confidence.select(*keys, "fieldtype", "pos", "confidence"), [*keys, "fieldtype", "pos"], "left").where(F.trim("text") != "")
    best = met.withColumn("norm", normalize.comparable(F.col("fieldtype"), F.col("text"))).groupBy(*keys, "fieldtype", "norm").agg(F.max("confidence").alias("confidence"))
    return best.join(flags.where("guess = 1").select(*keys, "fieldtype", "norm", F.col("gold").alias("correct")), [*keys, "fieldtype", "norm"])


def calibration(judged: DataFrame) -> DataFrame:
    """Ten buckets of confidence, the last closed at 1.0, and one for values without: bucket
    (null there), n, correct, accuracy (null on none). `judged` has confidence and correct (0/1)."""
    edges = [k / 10 for k in range(1, 10)]
    bucket = sum((F.when(F.col("confidence") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    one = judged.select(F.when(F.col("confidence").isNotNull(), bucket).otherwise(F.lit(-1)).alias("bucket"), "correct").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))
    every = judged.sparkSession.range(-1, 10).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(one, "bucket", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "correct")})
    return full.select("bucket", "n", F.col("correct").cast("long").alias("correct"), F.round(share(F.col("correct"), F.col("n")), 6).alias("accuracy"))


def edge_sweep(readings: DataFrame) -> DataFrame:
    """For each edge 0.1 .. 0.9: readings that are wrong and caught by the check alone, by low
    confidence alone, by both, by neither, and right ones flagged. `readings` has failed, wrong
    (booleans) and least_confidence (null where none is given)."""
    edges = F.explode(F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("edge")
    low = F.coalesce(F.col("least_confidence") < F.col("edge"), F.lit(False))
    return readings.select("*", edges).groupBy("edge").agg(
        F.count_if(F.col("wrong") & F.col("failed") & ~low).alias("check_only"),
        F.count_if(F.col("wrong") & ~F.col("failed") & low).alias("confidence_only"),
        F.count_if(F.col("wrong") & F.col("failed") & low).alias("both"),
        F.count_if(F.col("wrong") & ~F.col("failed") & ~low).alias("neither"),
        F.count_if(~F.col("wrong") & low).alias("false_alarms"),
    )


def nearest_rank(value: str, percent: int) -> Column:
    """The nearest-rank percentile, 0 of no values."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100}) within group (order by {value})"), F.lit(0.0))


def auroc(scores: DataFrame) -> DataFrame:
    """Weighted area under the ROC per stratum, ties half: the mean over strata of the chance that
    a positive scores above a negative. `scores` has stratum, score, positive (0/1).

    Scores are counted before they are ranked, so a window holds distinct scores only."""
    by = scores.groupBy("stratum", "score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("q"))
    below = W.partitionBy("stratum").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    u = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2)
    per = by.withColumn("u", u).groupBy("stratum").agg(F.sum("u").alias("u"), F.sum("p").alias("n"), F.sum("q").alias("m"))
    return per.select("stratum", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), F.round(F.col("u") / F.nullif(F.col("n") * F.col("m"), F.lit(0)), 6).alias("auroc"))


def quantile_cut(scores: DataFrame, keeps: list[float]) -> DataFrame:
    """For each share to keep, the least score at or below which that share of all weight lies
    (`cut`), and the share of outside scores strictly above it. `scores` has score, weight and
    inside (0/1): weights of inside scores make the cut."""
    by = scores.groupBy("score").agg(F.sum(F.col("weight") * F.col("inside")).alias("w"), F.sum(F.col("weight") * (1 - F.col("inside"))).alias("o"))
    whole = W.partitionBy(F.lit(0))  # distinct scores, pre-aggregated
    upto = whole.orderBy("score").rowsBetween(W.unboundedPreceding, 0)
    run = by.select("score", (F.sum("w").over(upto) / F.sum("w").over(whole)).alias("kept"), (1 - F.sum("o").over(upto) / F.sum("o").over(whole)).alias("above"))
    asked = run.select("*", F.explode(F.array(*[F.lit(k) for k in keeps])).alias("keep")).where(F.col("kept") >= F.col("keep") - 1e-9)
    return asked.groupBy("keep").agg(F.min_by(F.struct(F.col("score").alias("cut"), "above"), "score").alias("_c")).select("keep", F.round("_c.cut", 6).alias("cut"), F.round("_c.above", 6).alias("rejected"))


def compare_metrics(before: DataFrame, after: DataFrame, noise: DataFrame) -> DataFrame:
    """Metrics of two runs side by side: drop, noise, and whether the drop is beyond it."""
    both = before.select("name", F.col("value").alias("before")).join(after.select("name", F.col("value").alias("after")), "name", "full").join(noise.select("name", "noise"), "name", "left")
    drop = F.round(F.col("before") - F.col("after"), 12)
    return both.select(
        "name", "before", "after", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("kept").alias("kind"),
        F.round(drop, 9).alias("drop"), F.coalesce(drop > F.coalesce("noise", F.lit(0.0)), F.lit(False)).alias("regressed"),
    )


def table_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of two tables that differ: keys, column, left, right, as strings, null-safe."""
    values = [c for c in left.columns if c not in keys]
    cells = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in values])).alias("_c")).select(*keys, "_c.*")
    return cells(left, "left").join(cells(right, "right"), [*keys, "column"], "full").where(~F.col("left").eqNullSafe(F.col("right")))


def tree_digest(files: DataFrame) -> DataFrame:
    """sha256 over a tree's sorted `path blob` lines. `files` has tree, path, blob; a tree's file
    list is one row, as the digest is of all its lines."""
    line = F.concat_ws(" ", "path", "blob")
    return files.groupBy("tree").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def found_against_truth(found: DataFrame, truth: DataFrame, keys: list[str], by: str, kinds: DataFrame) -> DataFrame:
    """Hits, misses and false alarms per kind, met null-safely on the keys and the kind; kinds
    without any stay with zeros. `kinds` has the column `by`."""
    both = truth.select(*keys, by, F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(found.select(*keys, by, F.lit(0).alias("t"), F.lit(1).alias("f")))
    per = both.groupBy(*keys, by).agg(F.max("t").alias("t"), F.max("f").alias("f")).groupBy(by).agg(
        F.sum(F.col("t") * F.col("f")).alias("hits"), F.sum(F.col("t") * (1 - F.col("f"))).alias("misses"), F.sum((1 - F.col("t")) * F.col("f")).alias("false_alarms")
    )
    return kinds.select(by).join(per, by, "left").select(by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hits", "misses", "false_alarms")])


def choose_depth(points: DataFrame, within: float = 0.01) -> DataFrame:
    """The smallest setting whose score is within `within` of the best. `points` has setting, score."""
    best = points.agg(F.max("score").alias("best"))
    return points.join(F.broadcast(best), F.col("score") >= F.col("best") - within).agg(F.min("setting").alias("setting"))


def headline(exact: Column, noisy: Column, weight: float = 2 / 3) -> Column:
    """Exact and noisy rates weighed together; one alone where the other is missing."""
    return F.coalesce(weight * exact + (1 - weight) * noisy, exact, noisy)
