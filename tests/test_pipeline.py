"""Gate, line tables, edits, export and noise on small fixtures: nulls, ties, repeated rows, empty tables."""

import itertools
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators import edits, export, gate, lines, loop, resolution, routing, scoring


def test_gate_on_listed_blank_and_missing_values(spark):
    rows = [
        (1, {"date_issue": ["01/02/2026", "2026-01-05"], "date_due": ["2026-01-05"], "amount_total_gross": ["10.00", "10.01"], "amount_due": ["10"]}), (2, {"date_issue": ["2026-02-01"], "date_due": ["2026-01-31", " "]}),
        (3, {"amount_total_gross": ["1"], "amount_due": ["1.02"], "amount_paid": ["0"]}), (4, None), (5, {}), (6, {"amount_total_gross": ["x"], "amount_due": ["1"]}),
    ]
    checked = gate.checks(spark.createDataFrame(rows, "doc bigint, fields map<string,array<string>>"))
    found = {(r.doc, r.rule): (r.outcome, len(r.used)) for r in checked.collect()}
    assert found[1, "dates sane"] == ("passed", 3) and found[1, "totals agree"] == ("passed", 3)
    assert found[2, "dates sane"] == ("failed", 2) and found[3, "totals agree"] == ("paid", 0) and found[6, "totals agree"] == ("unreadable", 0)
    assert {r.doc: r.verdict for r in gate.verdicts(checked).collect()} == {1: "passed", 2: "failed", 3: "not checked", 4: "not checked", 5: "not checked", 6: "not checked"}
    assert gate.checks(spark.createDataFrame([], "doc bigint, fields map<string,array<string>>")).count() == 0


def test_line_rows_against_every_assignment(spark):
    rng = random.Random(4)
    make = lambda: {"a": rng.choice("xy"), "b": rng.choice("123"), "c": rng.choice(["p", "q", ""])}
    cases = {d: ([make() for _ in range(rng.randint(0, 4))], [make() for _ in range(rng.randint(0, 4))]) for d in range(25)}
    long = lambda k: spark.createDataFrame([(d, i, f, t) for d, x in cases.items() for i, row in enumerate(x[k]) for f, t in row.items()], "doc bigint, line bigint, fieldtype string, text string")
    scored = lines.Scored(long(0), long(1))
    got = {d: 0 for d in cases}
    for r in scored.pairs.collect():
        got[r.doc] += r.n * 100 + r.exact
    for d, (a, b) in cases.items():
        clean = lambda row: {k: v for k, v in row.items() if v}
        worth = lambda x, y: sum(clean(x).get(k) == v for k, v in clean(y).items()) * 100 + (clean(x) == clean(y) and bool(clean(x)))
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        best = max((sum(worth(x, large[j]) for x, j in zip(small, p, strict=True)) for p in itertools.permutations(range(len(large)), len(small))), default=0)
        assert got[d] == best, d
    one = scored.score().first()
    assert one.matched + one.missing == sum(len(a) for a, _ in cases.values()) and one.matched + one.spurious == sum(len(b) for _, b in cases.values())


def test_errors_add_back_to_both_sides(spark):
    flags = [(1, "amount_total_gross", "5", 1, 0), (1, "amount_total_net", "5", 0, 1), (1, "amount_total_net", "4", 1, 0), (1, "date_due", "2026-01-01", 1, 0), (1, "date_due", "2026-01-02", 0, 1), (2, "vendor_name", "a", 0, 1), (2, "odd", "a", 1, 0), (2, "vendor_name", "b", 1, 1)]
    found = scoring.error_classes(spark.createDataFrame(flags, "doc bigint, fieldtype string, norm string, gold int, guess int"), ["doc"], ["amount_total_gross", "amount_total_net", "date_due", "vendor_name"])
    assert {(r["class"], r.fieldtype): r.n for r in found.collect()} == {("net for gross", "amount_total_gross"): 1, ("missing", "amount_total_net"): 1, ("misread date", "date_due"): 1, ("spurious", "vendor_name"): 1, ("missing", "other fieldtype"): 1}
    totals = scoring.error_totals(found).first()
    assert (totals.false_negatives, totals.false_positives) == (4, 3)


def test_edits_net_out(spark):
    log = [(1, 1, "cell", 0, "q", "5"), (1, 2, "cell", 0, "q", " 1 "), (1, 3, "line removed", 1, None, None), (1, 4, "line added", None, None, None), (1, 5, "cell", 2, "c", "new"), (1, 6, "header", None, "h", ""), (2, 1, "cell", 7, "q", "1"), (3, 1, "line restored", 0, None, None)]
    df = spark.createDataFrame(log, "doc bigint, seq bigint, kind string, line bigint, fieldtype string, value string")
    header = spark.createDataFrame([(1, "h", ["x", " "])], "doc bigint, fieldtype string, texts array<string>")
    cells = spark.createDataFrame([(1, 0, "q", ["1"]), (1, 1, "q", ["2"])], "doc bigint, line bigint, fieldtype string, texts array<string>")
    counts = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "doc bigint, lines bigint")
    assert sorted((r.kind, r.line, r.fieldtype, r.read, r.left) for r in edits.corrections(df, header, cells, counts).collect()) == [("header", None, "h", ["x"], []), ("line added", 2, "c", [], ["new"]), ("line removed", 1, "q", ["2"], [])]
    assert {(r.doc, r.error) for r in edits.illegal(df, counts).collect()} == {(2, "the reading has no line 7"), (3, "line 0 is not removed")}
    left = edits.edited(df, header, cells, counts)
    assert sorted((r.line, r.fieldtype, r.texts) for r in left.where("doc = 1").collect()) == [(0, "q", ["1"]), (2, "c", ["new"])]
    assert edits.corrections(df.where("false"), header, cells, counts).count() == 0


def test_retention_rates_by_day(spark):
    df = spark.createDataFrame([(1, "2026-06-30"), (1, "2026-07-01"), (3, "2026-07-01"), (None, "2026-07-01")], "k int, d string").select(export.rate(F.col("k"), F.to_date("d")).alias("r"))
    assert [r.r for r in df.collect()] == [Decimal("0.1000"), Decimal("0.1500"), None, None]


def test_printed_verdicts(spark):
    texts = [("a", "status: COMPLETED\nerrors: 2\nerror box:\n1. bad\n2. worse\n"), ("b", "status: COMPLETED\nerrors:\nerror box:\n"), ("c", "status: COMPLETED\nerrors: 1\nerror box:\n"), ("d", "status: STOPPED\nerrors: 0\nerror box:\n")]
    found = export.prevalidated(spark.createDataFrame(texts, "period string, text string"))
    assert {r.period: (r.errors, r.listed, r.sound) for r in found.collect()} == {"a": (2, 2, True), "b": (0, 0, True), "c": (1, 0, False), "d": (0, 0, False)}


def test_noise_is_of_its_kind(spark):
    df = spark.createDataFrame([("bolt m10 x 40 zinc", ), ("hinge", ), ("12", )], "t string")
    t = F.col("t")
    rows = df.select("t", resolution.letters_substituted(t, 1).alias("l"), resolution.digits_dropped(t, 1).alias("d"), resolution.punctuation(t, 1).alias("p"), resolution.extra_words(t, 1).alias("x")).collect()
    for r in rows:
        assert len(r.l) == len(r.t) and (sum(a != b for a, b in zip(r.l, r.t, strict=True)) in (1, 2) or r.t == "12")
        assert r.x.startswith(r.t + " ") and r.p != r.t
    assert rows[0].d in ("bolt x 40 zinc", "bolt x zinc") and rows[1].d == "hinge" and rows[2].d == "12"


def test_cycle_goes_round(spark):
    drawn = resolution.cycle(spark.createDataFrame([(i,) for i in range(4)], "key bigint"), 10, 3).collect()
    assert sorted(r.draw for r in drawn) == list(range(10))
    assert all(sum(r.key == k for r in drawn) in (2, 3) for k in range(4))
    assert resolution.cycle(spark.createDataFrame([], "key bigint"), 5, 3).count() == 0


def test_decisions_only_in_review(spark):
    docs = spark.createDataFrame([(1, "needs_review", None, None, None), (2, "matched", None, None, None)], "id bigint, status string, lease_until timestamp, taken_at timestamp, lapses map<string,int>")
    after, refused = loop.decide(docs, spark.createDataFrame([(1, "rejected"), (2, "approved")], "id bigint, to_status string"))
    assert {r.id: r.status for r in after.collect()} == {1: "rejected", 2: "matched"}


def test_routes_in_reading_order(spark):
    known = spark.createDataFrame([(1, "pipeline failed at matched", "failed", ["tax mismatch"], [0.05, None]), (2, None, None, None, None), (3, "extraction failed", None, [], [None])], "doc bigint, shortcut string, gate string, holds array<string>, confidence array<double>")
    found = {(r.doc, r.policy, r.edge): r.reasons for r in routing.routed(known, routing.policies(spark)).collect()}
    assert found[1, "P5", 0.1] == ["gate failed", "match held", "confidence below the edge", "pipeline failed at matched"]
    assert found[1, "P2", None] == ["gate failed", "pipeline failed at matched"] and found[1, "P0", None] == [] and found[3, "P1", None] == ["extraction failed"]
    assert all(not v for (d, *_), v in found.items() if d == 2)


def test_numbers_in_other_forms(spark):
    texts = ["１２３．５", "1,234", "1.234", "1.234.567", "1,234,5", "0.500", "00012", "- 5 %", "5-", ".5", "1 2", "", "n/a", None, "1.2 x 3.4", "US$ 7.", "a" * 60_000 + "1"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize.number(F.col("t"))).collect()]
    assert found == ["123.5", "1234", "1.234", "1234567", "1234.5", "0.5", "12", "-5", "-5", "0.5", "12", None, None, None, None, "7", "1"]


def test_line_scores_write_nothing_between(spark):
    """Line tables are scored without anything on disk but what is shuffled, whether rows come long or gathered."""
    from pathlib import Path

    from ledgerloom.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    make = lambda rows: spark.createDataFrame(rows, "doc bigint, line bigint, fieldtype string, text string")
    gold, read = make([(1, 0, "a", "x"), (1, 0, "b", "y"), (1, 1, "a", "z"), (2, 0, "a", None)]), make([(1, 5, "a", "X"), (1, 5, "b", "y"), (1, 6, "a", "w"), (3, 0, "a", "q")])
    scored = lines.Scored(gold, read)
    assert sorted((r.doc, r.left, r.right, r.correct) for r in scored.rows().collect() if r.left is not None) == [(1, 0, 5, True), (1, 1, None, False), (2, 0, None, False)]
    assert sorted((r.doc, r.right) for r in scored.rows().where("left is null").collect()) == [(1, 6), (3, 0)]
    assert size() == before
    told = make([(1, 5, "a", "0.5")]).selectExpr("doc", "line", "fieldtype", "cast(text as double) confidence")
    long = {(r.doc, r.right, r.fieldtype, r.norm, r.confidence, r.correct) for r in scored.judged_cells(told).collect()}
    nest = lambda df, name: df.groupBy("doc", "line").agg(F.collect_list(F.struct("fieldtype", "text")).alias("cells")).groupBy("doc").agg(F.collect_list(F.struct("line", "cells")).alias(name))
    held = nest(gold, "gold").join(nest(read, "guess"), "doc", "full").join(told.groupBy("doc").agg(F.collect_list(F.struct("line", "fieldtype", "confidence")).alias("confidence")), "doc", "left")
    assert {(r.doc, r.right, r.fieldtype, r.norm, r.confidence, r.correct) for r in lines.Scored.of(held).judged_cells().collect()} == long and (1, 5, "a", "x", 0.5, 1) in long and (1, 6, "a", "w", None, 0) in long
