"""The document pipeline as tables: claims, moves under compare-and-set, retries, costs.

Documents: id, status, lease_until, taken_at, lapses (a map of status to count). A step of many
workers is one set of moves over the table: each names the status it took the document at, and
only moves whose document still stands there are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The order of statuses, where it ends, how long a lease lasts, how many may lapse, and how calls are retried.
NEXT = {"received": "extracted", "extracted": "validated", "validated": "resolved", "resolved": "matched", "matched": "approved"}
FINAL, PENDING = ("approved", "rejected", "needs_review"), tuple(NEXT)
LEASE_MINUTES, LAPSES = 10, 3
ATTEMPTS, COST_CAP, BACKOFF = 3, "0.05", 2.0


def queue(documents: DataFrame, status: str) -> DataFrame:
    """The documents at a status, the oldest (lowest id) first."""
    return documents.where(F.col("status") == status).orderBy("id")


def claim(documents: DataFrame, now: Column, workers: int) -> DataFrame:
    """The oldest pending documents whose lease is free, one a worker, leased from now: a lease still
    set has lapsed and is counted against the status."""
    free = documents.where(F.col("status").isin(*PENDING) & (F.col("lease_until").isNull() | (F.col("lease_until") < now))).orderBy("id").limit(workers)
    own = F.coalesce(F.get(F.array(F.col("lapses")[F.col("status")]), F.lit(0)), F.lit(0))
    lapses = F.when(F.col("lease_until").isNull(), F.col("lapses")).otherwise(
        F.map_concat(F.map_filter(F.coalesce("lapses", F.create_map().cast("map<string,int>")), lambda k, _: k != F.col("status")), F.create_map("status", own + 1))
    )
    return free.withColumns({"lapses": lapses, "taken_at": now, "lease_until": now + F.expr(f"interval {LEASE_MINUTES} minutes")})


def move(claimed: DataFrame, outcome: DataFrame) -> DataFrame:
    """`id, from_status, to_status, taken_at, reasons` of each claimed document: on to the next status,
    or to review - after the third lapse at a status, when nothing could be extracted, or at the end
    for the reasons known. `outcome` has id, extracted (boolean) and reasons (known so far)."""
    met = claimed.join(outcome, "id", "left")
    lapsed = F.coalesce(F.get(F.array(F.col("lapses")[F.col("status")]), F.lit(0)), F.lit(0)) >= LAPSES
    known = F.coalesce("reasons", F.array().cast("array<string>"))
    unread = (F.col("status") == "received") & ~F.coalesce("extracted", F.lit(True))
    to = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])[F.col("status")]
    review = lapsed | unread | ((F.col("status") == "matched") & (F.size(known) > 0))
    reasons = (
        F.when(lapsed, F.concat(known, F.array(F.concat(F.lit("pipeline failed at "), "status")))).when(unread, F.array(F.lit("extraction failed"))).when(F.col("status") == "matched", known).otherwise(F.array().cast("array<string>"))
    )
    return met.select("id", F.col("status").alias("from_status"), F.when(review, "needs_review").otherwise(to).alias("to_status"), "taken_at", reasons.alias("reasons"))


def commit(documents: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents after the moves, and the moves refused because the document no longer stands
    where they took it. Of several moves of one document the first by taken_at is made."""
    first = moves.withColumn("_n", F.row_number().over(W.partitionBy("id", "from_status").orderBy("taken_at"))).where("_n = 1").drop("_n")
    met = documents.join(first.select("id", F.col("from_status").alias("_from"), F.col("to_status").alias("_to")), (documents["id"] == first["id"]) & (documents["status"] == F.col("_from")), "left").drop(first["id"])
    moved = F.col("_to").isNotNull()
    after = met.select(*[(F.when(moved, F.col("_to")).otherwise(F.col("status")).alias("status") if c == "status" else F.when(~moved, F.col(c)).alias(c) if c in ("lease_until", "taken_at") else F.col(c)) for c in documents.columns])
    made = first.join(documents.select("id", F.col("status").alias("from_status")), ["id", "from_status"], "left_semi").select("id", "taken_at")
    return after, moves.join(made, ["id", "taken_at"], "left_anti")


def decide(documents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewers' decisions (id, to_status) made on documents in review, and those refused."""
    return commit(documents, decisions.select("id", F.lit("needs_review").alias("from_status"), "to_status", F.coalesce(*[F.col(c) for c in ("taken_at",) if c in decisions.columns], F.lit(None).cast("timestamp")).alias("taken_at")))


def retried(attempts: DataFrame) -> DataFrame:
    """What trying again makes of calls that could fail: `document, attempts, cost, failure, waited`.

    `attempts` has document, number (from 1), cost (decimal), error (null on success), status_code.
    A call is retried up to ATTEMPTS times, after 2, 4, .. seconds, until one succeeds, one fails for
    good (a 4xx status but 408, 409 and 429) or the cap is spent; later rows are not looked at."""
    retryable = F.col("status_code").isNull() | F.col("status_code").isin(408, 409, 429) | (F.col("status_code") >= 500)
    w = W.partitionBy("document").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.when(F.col("error").isNull() | ~retryable, 1).otherwise(0)).over(w), F.lit(0)) == 1
    spent = F.coalesce(F.sum("cost").over(w), F.lit(0))
    made = attempts.withColumns({"_stop": stopped | (F.col("number") > ATTEMPTS), "_over": (spent >= F.lit(COST_CAP).cast("decimal(10,6)")) & (F.col("number") > 1)})
    over = W.partitionBy("document").orderBy("number")
    ran = made.withColumn("_out", F.max(F.when(F.col("_stop") | F.col("_over"), 1).otherwise(0)).over(over) == 1).where("not _out")
    per = ran.groupBy("document").agg(F.count("*").alias("attempts"), F.sum("cost").alias("cost"), F.max_by("error", "number").alias("failure"), F.sum(F.when(F.col("number") > 1, F.lit(BACKOFF) * F.pow(F.lit(2.0), F.col("number") - 2)).otherwise(0.0)).alias("waited"))
    return per


def price(usage: dict[str, Column], rates: dict[str, str]) -> Column:
    """What calls cost by list price: tokens per million - cached ones and cache writes, counted inside
    the input, at their own rates - and pages per thousand. A rate or count not given is 0."""
    n = lambda k: F.coalesce(usage.get(k, F.lit(0)), F.lit(0)).cast("decimal(20,0)")
    r = lambda k: F.lit(rates.get(k, "0")).cast("decimal(12,6)")
    tokens = (n("input") - n("cached") - n("written")) * r("input") + n("cached") * r("cached") + n("written") * r("written") + n("output") * r("output")
    return (tokens / F.lit(1_000_000) + n("pages") * r("pages") / F.lit(1_000)).cast("decimal(28,12)")


def works(log: DataFrame) -> DataFrame:
    """Transitions with `wait`, from the commit before to the take, and `work`, from take to commit, in
    seconds. `log` has document, id, taken_at, committed_at."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    before = F.lag(seconds("committed_at")).over(W.partitionBy("document").orderBy("id"))
    return log.withColumns({"wait": seconds("taken_at") - before, "work": seconds("committed_at") - seconds("taken_at")})


def trace(log: DataFrame) -> DataFrame:
    """`document, id, step, status, after`: each document's transitions in order, numbered from 1, and the seconds since the first."""
    w = W.partitionBy("document").orderBy("id")
    seconds = F.col("committed_at").cast("timestamp").cast("double")
    return log.select("document", "id", F.row_number().over(w).alias("step"), F.col("to_status").alias("status"), F.round(seconds - F.first(seconds).over(w), 3).alias("after"))
