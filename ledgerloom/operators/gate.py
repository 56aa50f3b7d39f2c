"""Checks of a reading's header, their verdicts and what they catch.

Headers come one row a document: doc and a map `fields` of fieldtype to printed texts. Checks are
expressions on that row - nothing is exploded to compare the values of two fieldtypes, and every
list is judged by its extremes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, normalize
from ledgerloom.operators.scoring import ratio

# The neutral rules in report order with the fieldtypes they compare; a region's rules with theirs.
DATES, TOTALS = ("date_issue", "date_due"), ("amount_total_gross", "amount_due")
RULES = ("dates sane", "totals agree")
REGIONAL = {
    "do": {"vendor RNC": "vendor_tax_id", "customer RNC": "customer_tax_id", "NCF": "document_id", "modified NCF": "document_id_modified"},
}
TOLERANCE = "0.01"


def _valid(rule: str):  # noqa: ANN202
    return identifiers.receipt if rule.endswith("NCF") else lambda value: identifiers.taxpayer(value) | identifiers.citizen(value)


def _texts(fieldtype: str) -> Column:
    """A fieldtype's texts, blank ones absent; an empty array where it has none."""
    return F.coalesce(F.filter(F.get(F.array(F.col("fields")[fieldtype]), F.lit(0)), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def _used(*fieldtypes: str) -> Column:
    under = lambda t: lambda x: F.struct(F.lit(t).alias("fieldtype"), x.alias("text"))
    return F.concat(*[F.transform(_texts(t), under(t)) for t in fieldtypes])


NOTHING = "array<struct<fieldtype:string,text:string>>"


def _check(rule: str, fieldtypes: tuple[str, str], first: str, second: str, holds: str) -> Column:
    """A rule over two fieldtypes' values, read into the columns `first` and `second`: absent where one has none, unreadable where one does not read."""
    outcome = F.expr(f"case when size({first}) = 0 or size({second}) = 0 then 'absent' when exists({first}, x -> x is null) or exists({second}, x -> x is null) then 'unreadable' when {holds} then 'passed' else 'failed' end")
    return F.struct(F.lit(rule).alias("rule"), outcome.alias("outcome"), F.when(outcome.isin("passed", "failed"), _used(*fieldtypes)).otherwise(F.array().cast(NOTHING)).alias("used"))


def checks(headers: DataFrame, region: str | None = None, admitted: list[str] | None = None, day_first: bool = False) -> DataFrame:
    """`doc, rule, outcome, used` of each rule on each header: passed, failed, absent, paid or
    unreadable, and the values compared (none where the rule could not check).

    A rule holds only if every combination of the listed values does: the latest issue on or
    before the earliest due date, every gross within a cent of every due. A document already paid
    has no totals to agree. Of a region's rules those admitted run (all, unless given). A null or
    empty map has every rule absent.
    """
    read = headers.select(
        "doc", "fields", *[F.transform(_texts(t), lambda x: normalize.date(x, day_first)).alias(f"_{n}") for t, n in zip(DATES, "ab", strict=True)],
        *[F.transform(_texts(t), lambda x: normalize.number(x).try_cast("decimal(28,8)")).alias(f"_{n}") for t, n in zip(TOTALS, "cd", strict=True)],
    )
    dates = _check("dates sane", DATES, "_a", "_b", "array_max(_a) <= array_min(_b)")
    totals = _check("totals agree", TOTALS, "_c", "_d", f"array_max(_c) - array_min(_d) <= {TOLERANCE} and array_max(_d) - array_min(_c) <= {TOLERANCE}")
    paid = F.struct(F.lit("totals agree").alias("rule"), F.lit("paid").alias("outcome"), F.array().cast(NOTHING).alias("used"))
    every = [dates, F.when(F.size(_texts("amount_paid")) > 0, paid).otherwise(totals)]
    for rule, fieldtype in REGIONAL.get(region or "", {}).items():
        if admitted is None or rule in admitted:
            values = _texts(fieldtype)
            outcome = F.when(F.size(values) == 0, "absent").when(F.forall(values, _valid(rule)), "passed").otherwise("failed")
            every.append(F.struct(F.lit(rule).alias("rule"), outcome.alias("outcome"), F.when(F.size(values) > 0, _used(fieldtype)).otherwise(F.array().cast(NOTHING)).alias("used")))
    return read.select("doc", F.explode(F.array(*every)).alias("_c")).select("doc", "_c.*")


def verdicts(checked: DataFrame) -> DataFrame:
    """`doc, verdict`: failed if any rule failed, passed if one passed, else not checked."""
    has = lambda outcome: F.bool_or(F.col("outcome") == outcome)
    return checked.groupBy("doc").agg(F.when(has("failed"), "failed").when(has("passed"), "passed").otherwise("not checked").alias("verdict"))


def totals(checked: DataFrame) -> DataFrame:
    """One row: documents passed, failed and not checked, the pass rate over those checked, and how
    many readings each neutral rule could not read."""
    per = checked.groupBy("doc").agg(
        F.bool_or(F.col("outcome") == "failed").alias("_f"), F.bool_or(F.col("outcome") == "passed").alias("_p"),
        *[F.bool_or((F.col("rule") == r) & (F.col("outcome") == "unreadable")).alias(f"unreadable {r}") for r in RULES],
    )
    passed, failed = F.count_if(~F.col("_f") & F.col("_p")), F.count_if(F.col("_f"))
    return per.agg(
        passed.alias("passed"), failed.alias("failed"), F.count_if(~F.col("_f") & ~F.col("_p")).alias("not_checked"), F.round(ratio(passed, passed + failed), 6).alias("pass_rate"),
        *[F.count_if(F.col(f"unreadable {r}")).alias(f"unreadable_{r.split()[0]}") for r in RULES],
    )


def outcomes(checked: DataFrame) -> DataFrame:
    """`rule, outcome, n` over all readings."""
    return checked.groupBy("rule", "outcome").agg(F.count("*").alias("n"))


def admission(labels: DataFrame, region: str | None, coverage: list[str] | None = None) -> DataFrame:
    """`rule, fieldtype, labeled, broken, admitted` of a region's rules against a set's own labels:
    admitted where some document has a label and none breaks the rule. Fieldtypes outside the
    coverage are left out; a region without rules gives no rows."""
    rules = [(r, t) for r, t in REGIONAL.get(region or "", {}).items() if coverage is None or t in coverage]
    counts = [x for r, t in rules for x in (F.count_if(F.size(_texts(t)) > 0), F.count_if(~F.forall(_texts(t), _valid(r))))]
    if not rules:
        return labels.select(F.lit("").alias("rule"), F.lit("").alias("fieldtype"), F.lit(0).cast("long").alias("labeled"), F.lit(0).cast("long").alias("broken"), F.lit(False).alias("admitted")).where("false")
    one = labels.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)])
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("fieldtype"), F.col(f"_{2 * i}").alias("labeled"), F.col(f"_{2 * i + 1}").alias("broken")) for i, (r, t) in enumerate(rules)])
    return one.select(F.explode(listed).alias("_a")).select("_a.*", ((F.col("_a.labeled") > 0) & (F.col("_a.broken") == 0)).alias("admitted"))


def wrong(checked: DataFrame, flags: DataFrame, coverage: list[str] | None = None) -> DataFrame:
    """`doc, wrong` of every checked document: whether a (covered) value a rule compared is not
    among the values the field scorer matched. `flags` are the scorer's (doc, fieldtype, norm, gold, guess)."""
    used = checked.select("doc", F.explode("used").alias("_u")).select("doc", "_u.fieldtype", normalize.comparable(F.col("_u.fieldtype"), F.col("_u.text")).alias("norm"))
    if coverage is not None:
        used = used.where(F.col("fieldtype").isin(*coverage))
    matched = flags.where("gold = 1 and guess = 1").select("doc", "fieldtype", "norm", F.lit(True).alias("_m"))
    unmatched = used.distinct().join(matched, ["doc", "fieldtype", "norm"], "left").where("_m is null").select("doc").distinct().withColumn("wrong", F.lit(True))
    return checked.select("doc").distinct().join(unmatched, "doc", "left").select("doc", F.coalesce("wrong", F.lit(False)).alias("wrong"))


def ablation(judged: DataFrame) -> DataFrame:
    """One row of checked readings: wrong and failed (catches), wrong and passed (misses), right and
    failed (false alarms). `judged` has verdict and wrong."""
    is_ = lambda verdict, bad: F.count_if((F.col("verdict") == verdict) & (F.col("wrong") == F.lit(bad)))
    return judged.agg(is_("failed", True).alias("catches"), is_("passed", True).alias("misses"), is_("failed", False).alias("false_alarms"))


def gated_confidence(checked: DataFrame, written: DataFrame) -> DataFrame:
    """`doc, confidence`: of every value a checked rule compared, its confidence; null for one the
    reading gives none, as a derived value. `written` has doc, fieldtype, text, confidence."""
    used = checked.select("doc", F.explode("used").alias("_u")).select("doc", "_u.*").distinct()
    met = used.join(written.select("doc", "fieldtype", "text", "confidence"), ["doc", "fieldtype", "text"], "left")
    return met.select("doc", "confidence")


def below_edge(confidences: Column, edge: Column) -> Column:
    """Whether the lowest confidence there is lies below the edge; false where there is none."""
    return F.coalesce(F.array_min(F.filter(confidences, lambda x: x.isNotNull())) < edge, F.lit(False))
