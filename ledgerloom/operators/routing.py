"""Which documents a policy sends to review, and what slips past it.

A standing is what is known of a document where it is routed: doc, shortcut (why it stopped early,
or null), gate (verdict or null), holds (types found that hold), confidence (of the values the gate
compared). Policies are a table of a dozen rows; every rung is one pass over the standings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import gate
from ledgerloom.operators.matching import SEVERITY, TYPES
from ledgerloom.operators.scoring import share

# The reasons a document stops early, and the ladder of policies, each adding to the one before.
EXTRACTION_FAILED = "extraction failed"
SHORTCUTS = (EXTRACTION_FAILED, *(f"pipeline failed at {s}" for s in ("received", "extracted", "validated", "resolved", "matched")))
HOLDS = tuple(t for t in TYPES if SEVERITY[t] == "hold")
LADDER = [
    ("P0", "nothing", False, False, (), None),
    ("P1", "extraction or pipeline failed", True, False, (), None),
    ("P2", "gate failed", True, True, (), None),
    ("P3", "match held on price variance or tax mismatch", True, True, ("price variance", "tax mismatch"), None),
    ("P4", "match held on any hold type, the loop's policy", True, True, HOLDS, None),
]
LOW_CONFIDENCE = "confidence below the edge"
POLICY = "name string, adds string, shortcuts boolean, gate boolean, holds array<string>, edge double"


def policies(spark: SparkSession, confidence: bool = True, only: str | None = None) -> DataFrame:
    """The ladder as a table; with confidence, its last rung at each edge from 0.1 to 0.9."""
    edges = [("P5", f"confidence below {k / 10:.1f}", True, True, HOLDS, k / 10) for k in range(1, 10)] if confidence else []
    return spark.createDataFrame([(n, a, s, g, list(h), e) for n, a, s, g, h, e in LADDER + edges if only in (None, n)], POLICY)


def route() -> Column:
    """The reasons a policy finds in a standing, in reading order; none approves the document. Over
    columns of both: shortcut, gate, holds, confidence and p.shortcuts, p.gate, p.holds, p.edge."""
    stopped = F.col("p.shortcuts") & F.col("shortcut").isNotNull()
    return F.array_compact(F.array(
        F.when(stopped & (F.col("shortcut") == EXTRACTION_FAILED), F.lit(EXTRACTION_FAILED)),
        F.when(F.col("p.gate") & (F.col("s.gate") == "failed"), F.lit("gate failed")),
        F.when(F.arrays_overlap(F.coalesce(F.col("s.holds"), F.array().cast("array<string>")), F.col("p.holds")), F.lit("match held")),
        F.when(F.col("p.edge").isNotNull() & gate.below_edge(F.col("confidence"), F.col("p.edge")), F.lit(LOW_CONFIDENCE)),
        F.when(stopped & (F.col("shortcut") != EXTRACTION_FAILED), F.col("shortcut")),
    ))


def routed(standings: DataFrame, policy: DataFrame) -> DataFrame:
    """Each standing under each policy: all its columns with `policy`, `edge`, `reasons`."""
    met = standings.alias("s").join(F.broadcast(policy.limit(100)).alias("p"))  # a dozen policies
    return met.select("s.*", F.col("p.name").alias("policy"), "p.edge", "p.adds", route().alias("reasons"))


def standings(verdicts: DataFrame, findings: DataFrame, shortcuts: DataFrame | None = None) -> DataFrame:
    """`doc, shortcut, gate, holds` from the gate's verdicts and the match's findings (case_id is the
    document): hold types once each, in report order. `shortcuts` has doc and reasons."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TYPES) for x in (t, i)])
    held = findings.where("severity = 'hold'").groupBy(F.col("case_id").alias("doc")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct(order[F.col("type")].alias("_o"), "type"))), lambda x: x["type"]).alias("holds")
    )
    out = verdicts.select("doc", F.col("verdict").alias("gate")).join(held, "doc", "full").withColumn("holds", F.coalesce("holds", F.array().cast("array<string>")))
    if shortcuts is None:
        return out.withColumn("shortcut", F.lit(None).cast("string"))
    return out.join(shortcuts.select("doc", shortcut_of(F.col("reasons")).alias("shortcut")), "doc", "full")


def shortcut_of(reasons: Column) -> Column:
    """The first of a document's reasons that stopped it early; null without one."""
    return F.get(F.filter(reasons, lambda x: x.isin(*SHORTCUTS)), F.lit(0))


def ladder(cases: DataFrame, policy: DataFrame) -> DataFrame:
    """Per policy: documents, how many it reviews, how many of those it approves escaped, by cause -
    a hold injected into them (`injected`, an array of types) or a gate value misread (`misread`, an
    array of fieldtypes) - and the rates. Null escape rate where nothing is approved."""
    approved = F.size("reasons") == 0
    held, read = F.exists("injected", lambda t: t.isin(*HOLDS)), F.size("misread") > 0
    sums = routed(cases, policy).groupBy("policy", "edge", "adds").agg(
        F.count("*").alias("documents"), F.count_if(~approved).alias("reviewed"), F.count_if(approved & (held | read)).alias("escaped"),
        F.count_if(approved & held).alias("injected_hold"), F.count_if(approved & read).alias("misread"),
    )
    rest = F.col("documents") - F.col("reviewed")
    return sums.select(
        "*", F.round(F.col("reviewed") / F.col("documents"), 6).alias("review_rate"), F.round(share(F.col("escaped"), rest), 6).alias("escape_rate"),
        F.round(share(F.col("injected_hold"), rest), 6).alias("injected_rate"), F.round(share(F.col("misread"), rest), 6).alias("misread_rate"),
    )


def escapes(cases: DataFrame, policy: DataFrame) -> DataFrame:
    """`cause, name, documents`: the documents a policy approved although a hold was injected or a
    gate value misread, by type and fieldtype, a document once under each it carries."""
    free = routed(cases, policy).where(F.size("reasons") == 0)
    by = lambda cause, values: free.select(F.lit(cause).alias("cause"), F.explode(F.array_distinct(values)).alias("name"))
    return by("injected", F.filter("injected", lambda t: t.isin(*HOLDS))).unionByName(by("misread", F.col("misread"))).groupBy("cause", "name").agg(F.count("*").alias("documents"))


def misrouted(cases: DataFrame, policy: DataFrame) -> DataFrame:
    """Cases whose saved `status` and `routing_reasons` the policy does not give back: none in a sound run."""
    given = routed(cases, policy)
    status = F.when(F.size("reasons") > 0, "needs_review").otherwise("approved")
    return given.where((F.col("status") != status) | (F.col("routing_reasons") != F.col("reasons")))


def misread(flags: DataFrame) -> DataFrame:
    """`doc, misread`: the gate's fieldtypes whose reading holds a value its label does not."""
    types = (*gate.DATES, *gate.TOTALS)
    order = F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)])
    bad = flags.where((F.col("gold") == 0) & F.col("fieldtype").isin(*types)).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct(order[F.col("fieldtype")].alias("_o"), "fieldtype"))).alias("_m"))
    return bad.select("doc", F.transform("_m", lambda x: x["fieldtype"]).alias("misread"))
