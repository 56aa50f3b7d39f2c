"""Readers and writers of annotations, predictions, pinned CSV sets, run files and period files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CELL = "fieldtype: string, text: string, page: int, bbox: array<double>"
# The layout of the files.
ANNOTATION = f"field_extractions array<struct<{_CELL}>>, line_item_extractions array<struct<{_CELL}, line_item_id: int>>, metadata struct<page_count: int, source: string, original_filename: string, currency: string, document_type: string, language: string>"
RUN = "backend string, requested_model string, documents array<struct<document_id: string, pages: int, attempts: int, input_tokens: bigint, output_tokens: bigint, cost: string, latency: double, predicted: boolean, failure: string, served_model: string>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """`doc` (the file's name) and the annotation; unknown keys are left out, a file that is no
    annotation fails the read."""
    read = spark.read.schema(ANNOTATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def header_values(found: DataFrame) -> DataFrame:
    """`doc, fieldtype, ord, text` of an annotation's header, in document order."""
    return found.select("doc", F.posexplode("field_extractions").alias("ord", "_f")).select("doc", "_f.fieldtype", "ord", "_f.text")


def line_cells(found: DataFrame) -> DataFrame:
    """`doc, line, fieldtype, ord, text`: lines are numbered from 0 by ascending line_item_id."""
    cells = found.select("doc", F.posexplode("line_item_extractions").alias("ord", "_c")).select("doc", "ord", "_c.*")
    line = F.dense_rank().over(W.partitionBy("doc").orderBy("line_item_id")) - 1
    return cells.select("doc", line.alias("line"), "fieldtype", "ord", "text")


def by_fieldtype(values: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, fields`: texts by fieldtype in document order, as a map of lists."""
    listed = values.groupBy(*keys, "fieldtype").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))
    return listed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fieldtype", "texts")))).alias("fields"))


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """`doc` of each id in a JSON array file."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("doc"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """`doc, fieldtype, ord, text` of the header fields of a predictions file; a value may be
    written alone, in a list, or as null, and null and blank ones are absent."""
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<fields: map<string, string>>>")).alias("doc", "_p"))
    fields = docs.select("doc", F.explode("_p.fields").alias("fieldtype", "_v"))
    texts = F.when(F.col("_v").startswith("["), F.from_json("_v", "array<string>")).otherwise(F.array("_v"))
    return fields.select("doc", "fieldtype", F.posexplode(texts).alias("ord", "text")).where("trim(text) <> ''")


def pinned_csv(spark: SparkSession, path: str, sha256: str, key: str) -> DataFrame:
    """A CSV file with a header, whose bytes and key are checked: another digest or a key that
    comes twice raises ValueError."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if digest != sha256:
        raise ValueError(f"{path} has digest {digest}, not {sha256}")
    rows = spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    twice = rows.groupBy(key).count().where("count > 1").first()
    if twice:
        raise ValueError(f"{path} lists {twice[0]} more than once")
    return rows


def run_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a run file."""
    return spark.read.schema(RUN).option("multiLine", True).option("mode", "FAILFAST").json(path).select("backend", "requested_model", F.explode("documents").alias("_d")).select("backend", "requested_model", "_d.*")


def write_periods(lines: DataFrame, path: str) -> None:
    """Text files, one folder a period, lines in order. `lines` has period, ord and line; a period
    is sorted within its partition, never gathered on the driver."""
    lines.repartition("period").sortWithinPartitions("period", "ord").select("period", F.col("line").alias("value")).write.mode("overwrite").option("lineSep", "\r\n").partitionBy("period").text(path)
