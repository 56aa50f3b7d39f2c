"""Reviewers' edits folded onto readings, and the net corrections they leave.

Edits: doc, seq, kind (header, cell, line removed, line restored, line added), line, fieldtype,
value. Readings in long form: header values (doc, fieldtype, texts), line cells (doc, line,
fieldtype, texts) and line counts (doc, lines). Every step is a grouping on the document and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import normalize


def illegal(edits: DataFrame, counts: DataFrame) -> DataFrame:
    """`doc, seq, error` of each document's first edit that names a line not there to take it: no such
    line yet, a removed line edited or removed again, a line restored that is not removed."""
    before = W.partitionBy("doc").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    at_line = W.partitionBy("doc", "line").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    there = F.coalesce("lines", F.lit(0)) + F.coalesce(F.count_if(F.col("kind") == "line added").over(before), F.lit(0))
    gone = F.coalesce(F.last(F.when(F.col("kind") == "line removed", True).when(F.col("kind") == "line restored", False), ignorenulls=True).over(at_line), F.lit(False))
    seen = edits.join(counts, "doc", "left").withColumns({"_there": there, "_gone": gone}).where("kind in ('cell', 'line removed', 'line restored')")
    shown = F.col("line").cast("string")
    error = (
        F.when((F.col("line") < 0) | (F.col("line") >= F.col("_there")), F.concat(F.lit("the reading has no line "), shown))
        .when((F.col("kind") == "line restored") & ~F.col("_gone"), F.concat(F.lit("line "), shown, F.lit(" is not removed")))
        .when((F.col("kind") != "line restored") & F.col("_gone"), F.concat(F.lit("line "), shown, F.lit(" is removed")))
    )
    return seen.withColumn("error", error).where("error is not null").groupBy("doc").agg(F.min_by(F.struct("seq", "error"), "seq").alias("_e")).select("doc", "_e.*")


def _left(value: Column) -> Column:
    return F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))


def _read(texts: Column) -> Column:
    return F.coalesce(F.filter(texts, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def corrections(edits: DataFrame, header: DataFrame, cells: DataFrame, counts: DataFrame) -> DataFrame:
    """`doc, kind, line, fieldtype, read, left`: what the edits change in the end, of documents whose
    edits are all legal. A value put back as it was read, blank cells left blank, a line removed and
    restored or added and removed are no correction; a blank leaves a value unread; a line removed
    or added gives one row for each of its cells (one without a fieldtype if it has none)."""
    ok = edits.join(illegal(edits, counts).select("doc"), "doc", "left_anti")
    value = F.trim(F.coalesce("value", F.lit("")))
    heads = ok.where("kind = 'header'").groupBy("doc", "fieldtype").agg(F.max_by(value, "seq").alias("value"))
    headed = heads.join(header, ["doc", "fieldtype"], "left").select("doc", F.lit("header").alias("kind"), F.lit(None).cast("long").alias("line"), "fieldtype", _read(F.col("texts")).alias("read"), _left(F.col("value")).alias("left"))
    removed = ok.where("kind in ('line removed', 'line restored')").groupBy("doc", "line").agg(F.max_by("kind", "seq").alias("kind")).where("kind = 'line removed'").select("doc", "line")
    placed = ok.where("kind = 'cell'").groupBy("doc", "line", "fieldtype").agg(F.max_by(value, "seq").alias("value")).join(removed, ["doc", "line"], "left_anti").join(counts, "doc", "left")
    met = placed.join(cells, ["doc", "line", "fieldtype"], "left")
    kind = F.when(F.col("line") < F.coalesce("lines", F.lit(0)), "cell").otherwise("line added")
    celled = met.select("doc", kind.alias("kind"), "line", "fieldtype", _read(F.col("texts")).alias("read"), _left(F.col("value")).alias("left"))
    gone = removed.join(counts, "doc").where("line < lines").join(cells, ["doc", "line"], "left").select("doc", F.lit("line removed").alias("kind"), "line", "fieldtype", _read(F.col("texts")).alias("read"), F.array().cast("array<string>").alias("left"))
    net = headed.unionByName(celled).where(F.col("read") != F.col("left"))
    return net.unionByName(gone)


def edited(edits: DataFrame, header: DataFrame, cells: DataFrame, counts: DataFrame) -> DataFrame:
    """`doc, line, fieldtype, texts` of the readings as left (line null in the header): each value
    corrected in place, lines removed left out, lines added with what was left on them."""
    net = corrections(edits, header, cells, counts)
    read = header.select("doc", F.lit(-1).cast("long").alias("line"), "fieldtype", "texts").unionByName(cells.select("doc", "line", "fieldtype", "texts"))
    gone = net.where("kind = 'line removed'").select("doc", "line").distinct()
    left = net.where("kind <> 'line removed'").select("doc", F.coalesce("line", F.lit(-1).cast("long")).alias("line"), "fieldtype", "left")
    both = read.join(gone, ["doc", "line"], "left_anti").join(left, ["doc", "line", "fieldtype"], "full").select("doc", F.nullif("line", F.lit(-1)).alias("line"), "fieldtype", F.coalesce("left", "texts").alias("texts"))
    return both.where(F.size("texts") > 0)


def kept_confidence(confidence: DataFrame, net: DataFrame) -> DataFrame:
    """The confidence (doc, line - null in the header -, fieldtype, confidence) of values nobody changed."""
    at = F.coalesce(F.col("line"), F.lit(-1).cast("long"))
    changed = net.select("doc", at.alias("_at"), F.when(F.col("kind") != "line removed", F.col("fieldtype")).alias("_f"))
    whole = changed.where("_f is null").select("doc", "_at").distinct()
    return confidence.withColumn("_at", at).join(whole, ["doc", "_at"], "left_anti").join(changed.where("_f is not null").select("doc", "_at", F.col("_f").alias("fieldtype")).distinct(), ["doc", "_at", "fieldtype"], "left_anti").drop("_at")


def reading_digest(values: DataFrame) -> DataFrame:
    """`doc, digest`: sha256 of a reading's values however they were written; `values` has doc, line
    (null in the header), fieldtype, texts. A document's values are one row, as the digest is of all of them."""
    cell = F.to_json(F.struct(F.coalesce("line", F.lit(-1)).alias("line"), "fieldtype", "texts"))
    return values.where(F.size("texts") > 0).groupBy("doc").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(cell)), "\n"), 256).alias("digest"))


def tallies(net: DataFrame, run: DataFrame, label: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """`part, name, corrections, read_right, label_agrees`: corrections by header field, cell and kind
    of line, and how many of them a run and the labels hold. Header and cell values agree as distinct
    comparable values; a line removed agrees where the other side has no such line, one added where
    each of its cells does. `run` and `label` have doc, line, fieldtype, texts; documents in `own`,
    whose reading is the run's own, are left out."""
    net = net if own is None else net.join(own.select("doc"), "doc", "left_anti")
    at = F.coalesce(F.col("line"), F.lit(-1).cast("long"))
    alike = lambda a, b: _norms(a) == _norms(b)
    out = net.withColumn("_at", at)
    for name, side in (("run", run), ("label", label)):
        values = side.select("doc", at.alias("_at"), "fieldtype", F.col("texts").alias(f"_{name}"))
        lines = values.select("doc", "_at").distinct().withColumn(f"_{name}_line", F.lit(True))
        out = out.join(values, ["doc", "_at", "fieldtype"], "left").join(lines, ["doc", "_at"], "left")
        holds = F.when(F.col("kind") == "line removed", F.col(f"_{name}_line").isNull()).otherwise(alike(F.col("left"), F.coalesce(f"_{name}", F.array().cast("array<string>"))))
        out = out.withColumn(f"_{name}_ok", holds)
    part = F.when(F.col("kind").isin("header", "cell"), F.col("kind")).otherwise("line")
    name = F.when(F.col("kind").isin("header", "cell"), F.col("fieldtype")).otherwise(F.col("kind"))
    one = out.groupBy("doc", "_at", part.alias("part"), name.alias("name")).agg(F.bool_and("_run_ok").alias("r"), F.bool_and("_label_ok").alias("l"))
    return one.groupBy("part", "name").agg(F.count("*").alias("corrections"), F.count_if("r").alias("read_right"), F.count_if("l").alias("label_agrees"))


def _norms(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, lambda x: F.coalesce(normalize.number(x), normalize.text(x))), lambda x: x != "")))
