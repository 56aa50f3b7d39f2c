import json

from ledgerloom.operators import nested

READ = "id bigint, reading string, match string, id2 string"


def rows(spark, data, columns=("reading",)):
    df = spark.createDataFrame([(*d, None, "x")[:4] if len(d) == 2 else (*d, "x") for d in data], READ)
    found = nested.shred(df, "id", {c: c for c in columns})
    return sorted((r.origin, r.record_id, r.child, r.item_pos, r.item_name, r.value_pos) for r in found.collect())


def test_values_alone_listed_and_blank(spark):
    text = json.dumps({"fields": {"a": "x", "b": ["", None, "y", 3, True], "c": None, "d": []}, "line_items": [{}, {"q": "  "}, {"q": ["1"]}], "trace": {"fields": {"a": "no"}}})
    assert rows(spark, [(1, text)]) == [
        ("reading", 1, "field", -1, "a", 0), ("reading", 1, "field", -1, "b", 2), ("reading", 1, "field", -1, "b", 3), ("reading", 1, "field", -1, "b", 4), ("reading", 1, "line_item", 2, "q", 0),
    ]


def test_damaged_and_doubly_written(spark):
    twice = json.dumps(json.dumps({"fields": {"a": "x"}}))
    found = rows(spark, [(1, None), (2, ""), (3, "{"), (4, "[1]"), (5, twice), (6, "null"), (7, "[" * 100_000)])
    assert found == [("reading", i, "unreadable", -1, "", -1) for i in (2, 3, 4)] + [("reading", 5, "field", -1, "a", 0)] + [("reading", i, "unreadable", -1, "", -1) for i in (6, 7)]


def test_match_children(spark):
    text = json.dumps({"pairings": [{"invoice_line": 0, "po_line": 2}], "findings": [{"type": "t", "candidate": {"line": 1, "reason": "r"}, "invoice": ["a"], "receipt": "b"}, {"type": "u", "candidate": None}], "not_compared": [{"texts": ["x"], "reason": "absent"}]})
    assert [r[2:] for r in rows(spark, [(1, None, text)], ("match",))] == [
        ("candidate", 0, "", -1), ("finding", 0, "t", -1), ("finding", 1, "u", -1), ("finding_text", 0, "invoice", 0), ("finding_text", 0, "receipt", 0),
        ("not_compared", 0, "absent", -1), ("not_compared_text", 0, "absent", 0), ("pairing", 0, "", -1),
    ]


def test_corrections_and_subtypes(spark):
    text = json.dumps([{"kind": "cell", "line": 1, "fieldtype": "q", "left": ["1", ""]}, {"kind": "line added", "left": {"a": "1", "b": None}}, {"nothing": 1}])
    df = spark.createDataFrame([(7, text)], "id bigint, corrections string")
    found = nested.shred(df, "id", {"corrections": "corrections"})
    assert sorted((r.child, r.item_pos, r.item_name, r.value_pos, r.value) for r in found.collect()) == [("cell", 0, "q", 0, "1"), ("line added", 1, "a", 0, "1"), ("unknown", 2, "corrections: nothing", -1, None)]
    match = spark.createDataFrame([(1, json.dumps({"pairings": [{"invoice_line": 4, "po_line": 2, "code": 0.5}]}))], "id bigint, match string")
    one = nested.subtype(nested.shred(match, "id", {"match": "match"}), "pairing").collect()
    assert [(r.record_id, r.invoice_line, r.po_line, r.code) for r in one] == [(1, 4, 2, 0.5)]


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_states():
    assert "value correction" in nested.states_of({"kind": "cell"})
    assert "line correction" in nested.states_of({"kind": "line added", "left": {"a": "1"}})
    assert "value correction" not in nested.states_of({"kind": "line added", "left": {"a": "1"}})
    assert "values" in nested.states_of(["a", None, ""])
    assert "values" not in nested.states_of([{"a": 1}])
    assert "match" in nested.states_of({"findings": [{"type": "t"}]})


def test_rows_come_only_from_routes():
    value = {"pairings": [{"foo": 1}, {"invoice_line": 1}], "findings": [{"type": "t", "invoice": "a", "candidate": {"line": 1, "code": None}}], "not_compared": [{"reason": "absent", "texts": ["x"]}]}
    every = list(nested.rows("match", value))
    assert ("unknown", 0, "pairings: foo") in [r[:3] for r in every]
    assert [r[:2] for r in every if r[0] == "pairing"] == [("pairing", 1)]
    for route in [r for r in nested.ROUTES if r.parent in ("match", "finding", "not_compared")]:
        left = {r[0] for r in nested.rows("match", value, nested._routes(r for r in nested.ROUTES if r is not route))}
        if route.child != "finding_text":
            assert route.child not in left, route


def test_leaf_subtypes_and_variants(spark):
    text = json.dumps({"fields": {"a": ["x", "1.5"]}, "line_items": {"q": 2}})
    df = spark.createDataFrame([(1, text)], "id bigint, reading string")
    found = nested.shred(df, "id", {"reading": "reading"})
    assert sorted((r.item_name, r.value_pos, r.value, r.number) for r in nested.subtype(found, "field").collect()) == [("a", 0, "x", None), ("a", 1, "1.5", 1.5)]
    assert [(r.item_pos, r.number) for r in nested.subtype(found, "line_item").collect()] == [(0, 2.0)]
    match = spark.createDataFrame([(1, json.dumps({"pairings": [{"po_line": 4, "invoice_line": 1}, {"po_line": 2}]}))], "id bigint, match string")
    assert sorted((r.child, r["shape"], r.n) for r in nested.variants(nested.shred(match, "id", {"match": "match"})).collect()) == [("pairing", "invoice_line po_line", 1), ("pairing", "po_line", 1)]
