import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

from ledgerloom.operators import assignment, matching

LINES = "case_id string, pos bigint, fields map<string,array<string>>, type string"
RECEIVED = "case_id string, po_line bigint, fields map<string,array<string>>"
HEADERS = "case_id string, invoice_fields map<string,array<string>>, order_fields map<string,array<string>>"


def line(**cells):
    names = {"code": "line_item_code", "description": "line_item_description", "quantity": "line_item_quantity", "price": "line_item_unit_price_gross", "net": "line_item_unit_price_net", "amount": "line_item_amount_gross", "unit": "line_item_units_of_measure"}
    return {names[k]: [v] if isinstance(v, str) or v is None else v for k, v in cells.items()}


def run(spark, cases):
    """cases: {id: (invoice lines, po lines, {po_line: receipt}, invoice header, po header)}."""
    inv = [(c, i, f, "x") for c, (a, *_ ) in cases.items() for i, f in enumerate(a)]
    po = [(c, i, f, "x") for c, (_, b, *_) in cases.items() for i, f in enumerate(b)]
    rec = [(c, i, f) for c, x in cases.items() for i, f in x[2].items()]
    heads = [(c, x[3], x[4]) for c, x in cases.items()]
    return matching.match(spark.createDataFrame(inv, LINES), spark.createDataFrame(po, LINES), spark.createDataFrame(rec, RECEIVED), spark.createDataFrame(heads, HEADERS))


def listed(result, case):
    found = result.findings.where(f"case_id = '{case}'").collect()
    return [(r.type, r.place_kind, r.place_line) for r in sorted(found, key=lambda r: r.ord)]


def test_rules(spark):
    one = line(code="AB-100", description="steel bolt", quantity="10", price="35.66", unit="EA")
    cases = {
        "price": ([one], [{**one, "line_item_unit_price_gross": ["35.30"]}], {}, {}, {}),
        "inside": ([{**one, "line_item_unit_price_gross": ["35.65"]}], [{**one, "line_item_unit_price_gross": ["35.30"]}], {}, {}, {}),
        "amount": ([line(code="A1", price="n/a", amount="12.00")], [line(code="A1", price="3", amount="10")], {}, {}, {}),
        "short": ([one], [one], {0: line(quantity="9")}, {}, {}),
        "over": ([one], [{**one, "line_item_quantity": ["8"]}], {0: line(quantity="10")}, {}, {}),
        "unit": ([one], [{**one, "line_item_units_of_measure": ["BOX"], "line_item_unit_price_gross": ["1"]}], {0: line(quantity="1")}, {}, {}),
        "tax": ([one], [one], {}, {"amount_total_tax": ["18.50", "18.00"]}, {"amount_total_tax": ["18.00"]}),
        "taxset": ([one], [one], {}, {"amount_total_tax": ["18.50", "18.00"]}, {"amount_total_tax": ["18.00", "18.5"]}),
        "lines": ([one, line(code="ZZZZ9", description="quite other")], [one, line(code="ZZZZ8888", description="never seen")], {}, {}, {}),
        "bare": ([one, {}, line(unit="EA")], [one, line(code=" ")], {}, {}, {}),
        "none": ([one], [], {}, None, None),
        "empty": ([], [], {}, {}, {}),
    }
    result = run(spark, cases)
    want = {
        "price": [("price variance", "po line", 0)], "inside": [], "amount": [("price variance", "po line", 0)], "short": [("short-ship", "po line", 0)], "over": [("over-ship", "po line", 0)], "unit": [("unit variant", "po line", 0)],
        "tax": [("tax mismatch", "header", None)], "taxset": [], "lines": [], "bare": [], "none": [("extra line", "invoice line", 0)], "empty": [],
    }
    verdicts = {r.case_id: r.verdict for r in result.verdicts.collect()}
    for case, types in want.items():
        if case != "lines":
            assert listed(result, case) == types, case
            assert verdicts[case] == ("held" if types else "approvable")
    missed = {c: [(r.place_kind, r.place_line, r.cell, r.reason) for r in sorted(result.not_compared.where(f"case_id = '{c}'").collect(), key=lambda r: r.ord)] for c in cases}
    assert missed["amount"] == [("po line", 0, "unit price", "unreadable")]
    assert missed["unit"] == [("po line", 0, "unit price", "unit variant"), ("po line", 0, "quantity", "unit variant")]
    assert missed["bare"] == [("invoice line", 1, None, "nothing to pair on"), ("invoice line", 2, None, "nothing to pair on"), ("po line", 1, None, "nothing to pair on")]
    told = {r.case_id: r.explanation for r in matching.explain(result.findings).collect() if r.case_id not in ("lines",)}
    assert told["price"] == 'price variance, PO line 0, unit price, invoice "35.66" vs PO "35.30", margin 0.353 (1 percent of 35.3, above 0.01)'
    assert told["short"] == 'short-ship, PO line 0, quantity, invoice "10" vs receipt "9", compared exactly'
    assert told["over"] == 'over-ship, PO line 0, quantity, invoice "10" and receipt "10" vs PO "8", compared exactly'
    assert told["none"] == "extra line, invoice line 0, the PO has no lines"


def alike(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return 1 - row[-1] / max(len(a), len(b))


def close(a, b):
    a, b = sorted((abs(Decimal(a)), abs(Decimal(b))))
    return 1000 if not b else int((a * 1000 / b).to_integral_value(ROUND_HALF_UP))


def test_pairing_is_the_best_of_all_assignments(spark):
    rng = random.Random(2)
    words = ["bolt m4", "bolt m6", "nut m4", "washer", "hinge large", "hinge small"]
    make = lambda: {k: v for k, v in (("code", rng.choice(["A100", "A101", "B7", None])), ("description", rng.choice([*words, None])), ("quantity", str(rng.randint(1, 5))), ("price", str(rng.randint(1, 9)))) if v}
    cases = {str(c): ([make() for _ in range(rng.randint(0, 5))], [make() for _ in range(rng.randint(1, 5))]) for c in range(40)}
    result = run(spark, {c: ([line(**x) for x in a], [line(**x) for x in b], {}, {}, {}) for c, (a, b) in cases.items()})
    got = {}
    for r in result.pairings.collect():
        got.setdefault(r.case_id, []).append((r.invoice_line, r.po_line))
    for c, (a, b) in cases.items():
        scale = 4000 * min(len(a), len(b)) + 1

        def worth(x, y):
            identity = 0
            for cell, floor in (("code", 0.5), ("description", 0.4)):
                if cell in x and cell in y and (s := alike(x[cell].lower(), y[cell].lower())) >= floor:
                    identity += round(s * 1000)
            nameless = not any(k in z for z in (x, y) for k in ("code", "description"))
            deciding = identity or (nameless and (x["quantity"] == y["quantity"]) + (x["price"] == y["price"]))
            return deciding * scale + close(x["quantity"], y["quantity"]) + close(x["price"], y["price"]) if deciding else 0

        table = [[worth(x, y) for y in b] for x in a]
        short, long = (range(len(a)), range(len(b))) if len(a) <= len(b) else (range(len(b)), range(len(a)))
        best = max(sum((table[i][j] if len(a) <= len(b) else table[j][i]) for i, j in zip(short, p, strict=True)) for p in itertools.permutations(long, len(short)))
        assert sum(table[i][j] for i, j in got.get(c, [])) == best, c
        assert all(table[i][j] > 0 for i, j in got.get(c, []))


def test_candidates(spark):
    a = [line(code="AAAA", quantity="1"), line(code="AAAA", quantity="9"), line(quantity="3")]
    b = [line(code="AAAB", quantity="9")]
    result = run(spark, {"c": (a, b, {}, {}, {})})
    found = {r.place_line: r.candidate for r in result.findings.collect()}
    assert {k: (v.line, v.reason) for k, v in found.items()} == {0: (0, "taken by another line"), 2: (0, "no agreement")}
    assert [(r.invoice_line, r.po_line, r.code) for r in result.pairings.collect()] == [(1, 0, 0.75)]
    ledger = matching.ledger(*[spark.createDataFrame([("c", i, f, "x") for i, f in enumerate(x)], LINES) for x in (b, a)], spark.createDataFrame([], RECEIVED), result)
    assert sorted((r.po_line is None, r.invoice_line, r.types) for r in ledger.collect()) == [(False, 1, []), (True, 0, ["extra line"]), (True, 2, ["extra line"])]


def test_bands(spark):
    df = spark.createDataFrame([("101.5", "100"), ("102.01", "100"), ("150", "100"), ("151", "100"), ("100.9", "100")], "v string, a string").selectExpr("cast(v as decimal(28,8)) v", "cast(a as decimal(28,8)) a")
    assert [r[0] for r in df.select(matching.band("v", "a")).collect()] == ["near", "far", "far", None, None]
    df = spark.createDataFrame([("3", "2"), ("4", "2"), ("5", "2"), ("2.5", "2")], "v string, a string").selectExpr("cast(v as decimal(28,8)) v", "cast(a as decimal(28,8)) a")
    assert [r[0] for r in df.select(matching.quantity_band(df.v, df.a)).collect()] == ["near", "far", None, None]


def test_connected_parts_are_solved_alike(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(1, i, j, rng.randint(1, 9)) for i in range(6) for j in range(6) if rng.random() < 0.6], "case_id bigint, left bigint, right bigint, worth bigint")
    rows = {(r.left, r.right): r.worth for r in edges.collect()}
    best = max(sum(rows.get((i, p[i]), 0) for i in range(6)) for p in itertools.permutations(range(6)))
    assert sum(r.worth for r in assignment.assign(edges).collect()) == best


def test_equals_are_paired_as_if_all_were_compared(spark):
    """Lines with an equal on the other side, near ones and strangers: the pairs are those of the greatest worth."""
    rng = random.Random(5)
    codes = ["AAAA", "AAAB", "AABB", "ABBB", "CCCCCCCC", "CCCCDDDD", "XYZ1", "Q7"]
    cases = {str(c): (rng.sample(codes, rng.randint(0, 5)), rng.sample(codes, rng.randint(0, 5))) for c in range(60)}
    result = run(spark, {c: ([line(code=x, quantity="1") for x in a], [line(code=y, quantity="1") for y in b], {}, {}, {}) for c, (a, b) in cases.items()})
    got = {}
    for r in result.pairings.collect():
        got.setdefault(r.case_id, []).append((r.invoice_line, r.po_line, r.code))
    for c, (a, b) in cases.items():
        worth = [[(lambda s: (round(s * 1000) * (4000 * min(len(a), len(b)) + 1) + 1000) * (s >= 0.5))(alike(x.lower(), y.lower())) for y in b] for x in a]
        small, large = (worth, len(b)) if len(a) <= len(b) else ([list(x) for x in zip(*worth, strict=True)], len(a))
        best = max((sum(row[j] for row, j in zip(small, p, strict=True)) for p in itertools.permutations(range(large), len(small))), default=0)
        assert sum(worth[i][j] for i, j, _ in got.get(c, [])) == best, c
        assert all(s == alike(a[i].lower(), b[j].lower()) for i, j, s in got.get(c, []))


def test_nothing_is_written_between(spark):
    """A match leaves nothing on disk but what it shuffles."""
    from pathlib import Path

    from ledgerloom.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    result = run(spark, {"c": ([line(code="A1")], [line(code="A1")], {}, {}, {})})
    assert result.pairings.count() == 1 and sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()) == before


def test_no_row_of_a_case_is_sorted(spark):
    """Rows that hold a case's lines or headers are not sorted: what a sort can't hold goes to disk. What waits for Python carries the lines once."""
    lines = "array<struct<pos:bigint,fields:map<string,array<string>>>>"
    cases = spark.createDataFrame([("c", [(0, line(code="A1"))], [(0, line(code="A1"))], [])], f"case_id string, invoice {lines}, ordered {lines}, received array<struct<po_line:bigint,fields:map<string,array<string>>>>")
    heads = spark.createDataFrame([("c", {}, {})], HEADERS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        result = matching.match_cases(cases, heads)
        for df in (result.lines, result.findings, result.not_compared):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
            python = next(x for x in plan.split("\n") if "ArrowEvalPython" in x)
            assert not any(f"{c}#" in python for c in ("_na", "_nb", "_pa", "_pb", "_ka", "_kb", "_ca", "_cb"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_assignment_in_sql_is_that_of_python(spark):
    """Ties included: few worths, parts that share no line, sides of any length."""
    rng = random.Random(3)
    cases = []
    for c in range(200):
        left, right, share, top = rng.sample(range(9), rng.randint(0, 6)), rng.sample(range(9), rng.randint(0, 6)), rng.choice([0.2, 0.5, 1]), rng.choice([2, 5, 10**9])
        cases.append((c, [(i, j, rng.randint(1, top)) for i in left for j in right if rng.random() < share]))
    df = spark.createDataFrame(cases, "c int, edges array<struct<left:bigint,right:bigint,worth:bigint>>")
    got = {r.c: sorted((e.left, e.right, e.worth) for e in r.best) for r in df.selectExpr("c", f"{matching.assigned('edges')} as best").collect()}
    assert all(got[c] == sorted(assignment._solve(*([e[k] for e in edges] for k in range(3)))) for c, edges in cases)


def test_cases_of_few_lines_do_not_wait_for_python(spark, monkeypatch):
    """The match does not depend on who solves a case, and only cases of many lines go through Python."""
    rng = random.Random(4)
    make = lambda: line(code=rng.choice(["A100", "A101", "B7"]), quantity=str(rng.randint(1, 5)))
    cases = {str(c): ([make() for _ in range(rng.randint(0, 4))], [make() for _ in range(rng.randint(0, 4))], {}, {}, {}) for c in range(20)}
    got = []
    for many in (0, 2, 64):
        monkeypatch.setattr(matching, "MANY", many)
        result = run(spark, cases)
        got.append(sorted(tuple(r) for r in result.pairings.collect()))
    assert got[0] == got[1] == got[2]
    plan = result.findings._jdf.queryExecution().executedPlan().toString()
    waits = [x for x in plan.split("\n") if "Filter" in x and f"> {matching.MANY}" in x]
    assert plan.count("ArrowEvalPython") == 1 and len(waits) >= 2
