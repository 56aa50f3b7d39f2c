"""Queries of the training-data operators that belong to the core: problems 3 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, units
from ledgerloom.session import latest, table

FOUND = ["origin", "record_id", "child", "item_pos", "item_name", "value_pos"]


def p3_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = latest(table(spark, sf_dir, "pipeline_documents").select("id", "reading", "match", "loaded_at"), "id")
    corrections = latest(table(spark, sf_dir, "corrections").select("correction_id", "corrections", "loaded_at"), "correction_id")
    return nested.shred(documents, "id", {"reading": "reading", "match": "match"}).unionByName(nested.shred(corrections, "correction_id", {"corrections": "corrections"}))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child rows the cases name; shapes no route takes are told by p3_variants."""
    return p3_children(spark, sf_dir).where(F.col("child") != nested.UNKNOWN).select(*FOUND)


def p3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural variants met, known and unknown, and how often."""
    return nested.variants(p3_children(spark, sf_dir))


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of header values, linked to their document."""
    return nested.subtype(p3_children(spark, sf_dir), "field").select("record_id", "item_name", "value_pos", "value", "number")


def p3_pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of one variant: pairings, linked to their document."""
    return nested.subtype(p3_children(spark, sf_dir), "pairing").select("record_id", "item_pos", "invoice_line", "po_line", "code", "description")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = latest(
        table(spark, sf_dir, "line_items").select(
            "line_id",
            F.col("line_item_quantity").alias("quantity"),
            F.col("line_item_units_of_measure").alias("unit"),
            F.col("line_item_description").alias("description"),
            "loaded_at",
        ),
        "line_id",
    )
    return units.base_amounts(lines.withColumn("at", F.unix_timestamp("loaded_at")), table(spark, sf_dir, "base_units"))


QUERIES = {"p3_found": p3_found, "p3_variants": p3_variants, "p3_fields": p3_fields, "p3_pairings": p3_pairings, "p5_found": p5_found}
ORACLES: dict[str, str] = {}
