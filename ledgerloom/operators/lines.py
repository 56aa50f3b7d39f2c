"""Scores of line tables: labelled rows paired with read rows, then judged cell by cell.

Cells come in long form - doc, line, fieldtype, text - or as documents that hold their rows. A
document's two tables are paired and judged within one row, so nothing but the cells is shuffled and
nothing is written between. Two rows can only be paired if they agree on a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators import scoring
from ledgerloom.operators.matching import chosen, once, with_


def _gathered(cells: DataFrame, name: str) -> DataFrame:
    rows = cells.groupBy("doc", "line").agg(F.collect_list(F.struct("fieldtype", "text")).alias("cells"))
    return rows.groupBy("doc").agg(F.collect_list(F.struct("line", "cells")).alias(name))


def _values(rows: str) -> Column:
    """Rows with the distinct comparable values of their cells; a blank text is no value."""
    value = lambda c: F.struct(c["fieldtype"].alias("fieldtype"), normalize.comparable(c["fieldtype"], c["text"]).alias("norm"))
    values = lambda cells: F.array_distinct(F.filter(F.transform(F.filter(cells, lambda c: c["text"].isNotNull()), value), lambda v: F.length(v["norm"]) > 0))
    return F.transform(F.coalesce(rows, F.array()), lambda r: F.struct(r["line"].alias("line"), values(r["cells"]).alias("values")))


def paired(documents: DataFrame) -> DataFrame:
    """`documents` (doc, and `gold` and `guess`, arrays of line and values) with `_rows`: every labelled
    row with the read row paired with it, then the read rows left over, as left, right, correct, gold, guess.

    The worth of a pair is how many values it shares, and only between equals whether nothing else is in either.
    """
    pick = "left:bigint,right:bigint,n:bigint,exact:boolean,worth:bigint"
    met = "transform(guess, r -> struct(cast(g.line as bigint) as left, cast(r.line as bigint) as right, cast(size(array_intersect(g.values, r.values)) as bigint) as n, size(g.values) as a, size(r.values) as b))"
    graded = "struct(e.left, e.right, e.n, e.n = e.a and e.n = e.b, e.n * (least(size(gold), size(guess)) + 1L) + if(e.n = e.a and e.n = e.b, 1L, 0L))"
    df = with_(documents, _edges=f"cast(flatten(transform(gold, g -> transform(filter({met}, e -> e.n > 0), e -> {graded}))) as array<struct<{pick}>>)")
    df = df.withColumn("_chosen", chosen(F.expr("case when size(_edges) > 0 then array_join(transform(_edges, e -> concat(e.left, ',', e.right, ',', e.worth)), ';') end")))
    df = with_(df, _pairs="coalesce(transform(_chosen, k -> _edges[k]), array())")
    df = with_(df, _left="transform(_pairs, p -> p.left)", _right="transform(_pairs, p -> p.right)", _at="transform(guess, r -> cast(r.line as bigint))")
    row = lambda left, right, correct, gold, guess: f"named_struct('left', {left}, 'right', {right}, 'correct', {correct}, 'gold', {gold}, 'guess', {guess})"
    none = "cast(array() as array<struct<fieldtype:string,norm:string>>)"
    own = "get(_pairs, cast(array_position(_left, cast(g.line as bigint)) as int) - 1)"
    labeled = f"transform(gold, g -> {row('cast(g.line as bigint)', f'{own}.right', f'coalesce({own}.exact, false)', 'g.values', f'coalesce(get(guess, cast(array_position(_at, {own}.right) as int) - 1).values, {none})')})"
    free = f"transform(filter(guess, r -> not array_contains(_right, cast(r.line as bigint))), r -> {row('cast(null as bigint)', 'cast(r.line as bigint)', 'false', none, 'r.values')})"
    return with_(df, _rows=f"concat({labeled}, {free})").select(*[c for c in documents.columns if c not in ("gold", "guess")], "_pairs", "_rows")


class Scored:
    """A line table's scores, from the rows and the cells of either side.

    `labeled` and `read` have doc, line, fieldtype, text; a row without any text is told by a row
    with a null one. Repeated rows are rows of their own; a table of no rows scores nothing.
    """

    def __init__(self, labeled: DataFrame, read: DataFrame) -> None:
        self._hold(_gathered(labeled, "gold").join(_gathered(read, "guess"), "doc", "full"))

    @classmethod
    def of(cls, documents: DataFrame) -> Scored:
        """Scores of documents that hold their rows: doc, and `gold` and `guess`, arrays of line and `cells`,
        arrays of fieldtype and text; also, if given, `confidence`, an array of line, fieldtype, confidence."""
        self = cls.__new__(cls)
        self._hold(documents)
        return self

    def _hold(self, documents: DataFrame) -> None:
        kept = [c for c in documents.columns if c == "confidence"]
        self._documents = paired(documents.select("doc", *kept, once(_values("gold")).alias("gold"), once(_values("guess")).alias("guess")))

        self.pairs = self._documents.select("doc", F.inline_outer("_pairs")).where("left is not null").select("doc", "left", "right", "n", "exact")

    def _each(self, *keep: str) -> DataFrame:
        return self._documents.select("doc", *keep, F.inline_outer("_rows")).where("correct is not null")

    def rows(self) -> DataFrame:
        """`doc, left, right, correct`: every labelled row with the read row paired with it, then
        the read rows left over. A row is correct if paired and nothing differs."""
        return self._each().select("doc", "left", "right", "correct")

    def score(self, by: list[str] | None = None) -> DataFrame:
        """matched, missing, spurious rows with precision, recall and F1; a wrong pair is one missing and one spurious."""
        good = F.col("correct")
        return scoring.with_scores(self.rows().groupBy(*(by or [])).agg(F.count_if(good).alias("matched"), F.count_if(F.col("left").isNotNull() & ~good).alias("missing"), F.count_if(F.col("right").isNotNull() & ~good).alias("spurious")))

    def flags(self, *keep: str) -> DataFrame:
        """`doc, left, right, fieldtype, norm, gold, guess` of every row of `rows`, met value by value."""
        has = lambda side, v: F.array_contains(side, v).cast("int")
        values = F.transform(F.array_union("gold", "guess"), lambda v: F.struct(v["fieldtype"].alias("fieldtype"), v["norm"].alias("norm"), has("gold", v).alias("_gold"), has("guess", v).alias("_guess")))
        met = self._each(*keep).select("doc", "left", "right", "correct", *keep, F.inline_outer(values)).where("norm is not null")
        return met.withColumnsRenamed({"_gold": "gold", "_guess": "guess"})

    def cell_accuracy(self) -> DataFrame:
        """`fieldtype, correct, labeled, spurious, accuracy`: of the labelled values how many the paired row got right."""
        one = scoring.counted(self.flags(), ["fieldtype"])
        labeled = F.col("matched") + F.col("missing")
        return one.select("fieldtype", F.col("matched").alias("correct"), labeled.alias("labeled"), "spurious", F.round(scoring.ratio(F.col("matched"), labeled), 6).alias("accuracy"))

    def row_classes(self) -> DataFrame:
        """`class, n, documents`: rows wrong, missing and spurious."""
        kind = F.when(F.col("right").isNull(), "missing row").when(F.col("left").isNull(), "spurious row").when(~F.col("correct"), "wrong row")
        return self.rows().withColumn("class", kind).where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("documents"))

    def _wrong(self) -> DataFrame:
        return self.flags().where(F.col("left").isNotNull() & F.col("right").isNotNull() & ~F.col("correct"))

    def cell_classes(self, known: list[str] | None = None) -> DataFrame:
        """`class, fieldtype, n, documents` of the cells of wrong rows."""
        return scoring.error_classes(self._wrong(), ["doc", "left", "right"], known)

    def one_cell_off(self) -> DataFrame:
        """One row: how many wrong rows have a single error."""
        per = scoring.value_errors(self._wrong(), ["doc", "left", "right"]).groupBy("doc", "left", "right").agg(F.sum("n").alias("n"))
        return per.agg(F.count_if(F.col("n") == 1).alias("one_cell_off"), F.count("*").alias("wrong_rows"))

    def judged_cells(self, confidence: DataFrame | None = None) -> DataFrame:
        """`doc, right, fieldtype, norm, confidence, correct` of each value read. `confidence` has doc,
        line, fieldtype, confidence; without it the documents hold theirs."""
        if confidence is None:
            own = F.filter("confidence", lambda c: (c["line"] == F.col("right")) & (c["fieldtype"] == F.col("fieldtype")))
            read = self.flags("confidence").where("guess = 1").withColumn("_c", own)
            return read.select("doc", "right", "fieldtype", "norm", F.explode_outer("_c.confidence").alias("confidence"), F.col("gold").alias("correct"))
        read = self.flags().where("guess = 1").select("doc", "right", "fieldtype", "norm", F.col("gold").alias("correct"))
        return read.join(confidence.withColumnRenamed("line", "right").select("doc", "right", "fieldtype", "confidence"), ["doc", "right", "fieldtype"], "left")
