"""Queries of the operators of this package and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import addresses, catalogue, digests, mixing, names, packing, subjects, tokens
from ledgerloom.session import cut, latest, table


def p1_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address record, by the key it has in p1_found."""
    fields = ["vendor_address", "customer_billing_address", "customer_delivery_address"]
    invoices = latest(table(spark, sf_dir, "invoices").select("invoice_id", *fields, "loaded_at"), "invoice_id")
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    return invoices.select("invoice_id", named.alias("_f")).where("_f.text is not null").select(F.concat_ws("/", F.col("invoice_id").cast("string"), "_f.field").alias("address_id"), "_f.text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_location(p1_addresses(spark, sf_dir))


def p1_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The street identifier, number and unit of each address record that spells out a place."""
    return addresses.resolve(p1_addresses(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = latest(table(spark, sf_dir, "line_items").select("line_id", F.col("line_item_description").alias("text"), "loaded_at"), "line_id")
    return catalogue.match(lines, table(spark, sf_dir, "entries"))


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptions without an entry, by how often they come."""
    lines = latest(table(spark, sf_dir, "line_items").select("line_id", F.col("line_item_description").alias("text"), "loaded_at"), "line_id")
    free = catalogue.match(lines, table(spark, sf_dir, "entries")).where(F.col("sku") == catalogue.UNMATCHED)
    return lines.join(free, "line_id", "left_semi").groupBy(F.lower(F.trim("text")).alias("description")).agg(F.count("*").alias("lines"))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of calls and latencies of run documents. A latency below zero is impossible; a
    negative cost is a reversal and counts."""
    calls = latest(table(spark, sf_dir, "vendor_calls").select("id", "served_model", "cost", "started_at", "loaded_at"), "id")
    runs = latest(table(spark, sf_dir, "run_documents").select("run_row_id", "served_model", "latency", "finished_at", "loaded_at"), "run_row_id")
    return calls.select(F.lit("cost").alias("measure"), "served_model", F.to_date("started_at").cast("string").alias("day"), F.col("cost").cast("double").alias("value")).unionByName(
        runs.where("latency >= 0").select(F.lit("latency").alias("measure"), "served_model", F.to_date("finished_at").cast("string").alias("day"), F.col("latency").alias("value"))
    )


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and day, each day summarised apart, and (day null) per model from the days combined."""
    return digests.percentiles_by(p4_values(spark, sf_dir), ["measure", "served_model"], apart="day")


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model, summarised over all its rows at once."""
    return digests.percentiles(p4_values(spark, sf_dir), ["measure", "served_model"])


def p4_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which estimates keep their bound, and over how many values: all do."""
    whole = p4_whole(spark, sf_dir)
    return whole.select("measure", "served_model", F.col("quantile").cast("double").alias("quantile"), "n", "within_bound")


P4_CERTIFIED = """
with calls as (select id, served_model, cost, row_number() over (partition by id order by loaded_at desc) as r from vendor_calls),
runs as (select run_row_id, served_model, latency, row_number() over (partition by run_row_id order by loaded_at desc) as r from run_documents),
x as (
  select 'cost' as measure, served_model, count(*) as n from calls where r = 1 and cost is not null group by served_model
  union all
  select 'latency', served_model, count(*) from runs where r = 1 and latency >= 0 and not isnan(latency) and not isinf(latency) group by served_model)
select measure, served_model, q.quantile, n, true as within_bound
from x, (values (0.5::double), (0.95::double), (0.99::double)) q(quantile)
"""


def p6_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name record, by the key it has in p6_found."""
    invoices = latest(table(spark, sf_dir, "invoices").select("invoice_id", "vendor_name", "customer_billing_name", "loaded_at"), "invoice_id")
    labels = table(spark, sf_dir, "regional_labels").where("label_id is not null")
    named = [(invoices, "invoice_id", "vendor_name", "vendor_name"), (invoices, "invoice_id", "customer_billing_name", "customer_billing_name"), (labels, "label_id", "vendor_name", "label_vendor_name")]
    parts = [df.where(F.col(column).isNotNull()).select(F.concat_ws("/", F.col(key).cast("string"), F.lit(name)).alias("name_id"), F.col(column).alias("text")) for df, key, column, name in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_party(p6_names(spark, sf_dir))


def p6_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The party of each name record, with the size of the party."""
    found = names.resolve(p6_names(spark, sf_dir))
    return found.join(found.groupBy("party").agg(F.count("*").alias("records")), "party")


def _sizes(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return cut(tokens.sized(table(spark, sf_dir, "documents"), *keep))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The capacities asked for: a handful of rows."""
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").where("pack_name is not null and capacity_tokens > 0").collect()}


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sizes(spark, sf_dir), _capacities(spark, sf_dir))


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: packs, tokens in them, the space left and its share."""
    capacities = table(spark, sf_dir, "pack_sizes")
    one = p7_packs(spark, sf_dir).where("pack_id is not null").groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("tokens"), F.max("unused_tokens").alias("unused"))
    return (
        one.groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused_tokens")).join(capacities, "pack_name")
        .select("pack_name", "capacity_tokens", "packs", "tokens", "unused_tokens", (F.col("unused_tokens") / (F.col("packs") * F.col("capacity_tokens"))).alias("unused_share"))
    )


def p8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sizes(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_repeats(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subjects"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus deals with each subject: the known subjects and those found."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    known = table(spark, sf_dir, "subject_examples").where("subject <> 'none'").select("doc_id", "subject")
    both = p9_found(spark, sf_dir).unionByName(known).distinct().join(documents, "doc_id")
    return both.groupBy("subject").agg(F.count("*").alias("documents"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every text with tokens is packed once, in one piece if it fits, and no pack overflows."""
    capacities = table(spark, sf_dir, "pack_sizes").select("pack_name", "capacity_tokens")
    packs = cut(p7_packs(spark, sf_dir).where("pack_id is not null"))
    texts = packs.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces")).join(capacities, "pack_name")
    own = texts.groupBy("pack_name").agg(F.count("*").alias("texts"), F.bool_and(F.col("pieces") == F.ceil(F.col("n") / F.col("capacity_tokens"))).alias("once"))
    full = packs.groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("n"), F.max("unused_tokens").alias("unused")).join(capacities, "pack_name")
    fits = full.groupBy("pack_name").agg(F.bool_and(F.col("n") + F.col("unused") == F.col("capacity_tokens")).alias("fits"))
    return own.join(fits, "pack_name")


P7_WHOLE = "select pack_name, (select count(*) from documents where text is not null and text <> '') as texts, true as once, true as fits from pack_sizes"


def p8_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, its texts and whether none is repeated beyond its cap."""
    mixed = p8_repeats(spark, sf_dir).join(table(spark, sf_dir, "mix_targets").select("source", "max_repeats"), "source", "left")
    return mixed.groupBy("source").agg(F.count("*").alias("texts"), F.bool_and(F.col("repeats") <= F.coalesce("max_repeats", F.lit(0))).alias("capped"))


P8_CAPPED = "select source, count(*) as texts, true as capped from documents group by source"


QUERIES = {
    "p1_found": p1_found,
    "p1_locations": p1_locations,
    "p2_found": p2_found,
    "p2_unmatched": p2_unmatched,
    "p4_percentiles": p4_percentiles,
    "p4_whole": p4_whole,
    "p4_certified": p4_certified,
    "p6_found": p6_found,
    "p6_parties": p6_parties,
    "p7_packs": p7_packs,
    "p7_unused": p7_unused,
    "p7_whole": p7_whole,
    "p8_repeats": p8_repeats,
    "p8_capped": p8_capped,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
ORACLES = {"p4_certified": P4_CERTIFIED, "p7_whole": P7_WHOLE, "p8_capped": P8_CAPPED}
