import hashlib
import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators import assignment, logs, retrieval, scoring
from ledgerloom.plans import reference
from ledgerloom.sources import readers


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(3)
    for _ in range(200):
        worth = rng.integers(0, 6, rng.integers(1, 6, 2))
        n, m = worth.shape
        wide = worth if n <= m else worth.T
        most = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        pairs = assignment.best(worth)
        assert sum(worth[i, j] for i, j in pairs) == most
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_assign_cases(spark):
    edges = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 3), (2, 0, 1, 2), (2, 1, 0, 2), (3, 0, 0, 0)], "case_id bigint, left bigint, right bigint, worth bigint")
    assert sorted(map(tuple, assignment.assign(edges).collect())) == [(1, 0, 0, 5), (2, 0, 1, 2), (2, 1, 0, 2)]
    assert assignment.assign(edges.where("false")).count() == 0


def test_every_line_is_scored_against_all_permutations(spark, tmp_path):
    rng = random.Random(5)
    lines = [(doc, code, rng.randint(1, 3)) for doc in range(40) for code in rng.choices([10, 11, 21, 32, 32, 43], k=rng.randint(1, 5))]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    rows = [(doc, code, 1, rng.randint(1, 2), float(q), 1.0, 0.0, 0.0, None) for doc, code, q in lines]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    worth = lambda a, b: 200 * (a[0] == b[0]) + 100 * (a[1] == b[1]) + (a == b)
    matched = read = 0
    for doc in range(40):
        gold = [(code, q) for d, code, q in lines if d == doc]
        guess = [(code, q + 100 * (code % 10 == 1)) for code, q in gold if code % 10]
        read += len(guess)
        matched += max((sum(worth(a, b) for a, b in zip(p, guess, strict=True)), sum(a == b for a, b in zip(p, guess, strict=True))) for p in itertools.permutations(gold, len(guess)))[1]
    assert any(n > 1 for n in Counter((doc, code) for doc, code, _ in lines).values())
    assert [tuple(r) for r in reference.line_item_score_all(spark, str(tmp_path)).collect()] == [(matched, len(lines) - matched, read - matched)]


@pytest.mark.parametrize(
    ("printed", "number"),
    [("2,460.00", "2460"), ("2.460,00", "2460"), ("$2,500", "2500"), ("1.234.567", "1234567"), ("7.250%", "7.25"), ("340.00-", "-340"), ("$-1,234.50", "-1234.5"), ("$204,806,35", "204806.35"), ("0.00", "0"), ("EOM", None), (".5", "0.5"), (None, None)],
)
def test_number(spark, printed, number):
    assert spark.createDataFrame([(printed,)], "x string").select(normalize.number(F.col("x"))).first()[0] == number


@pytest.mark.parametrize(("printed", "day"), [("01/20/2025", "2025-01-20"), ("2025-01-20", "2025-01-20"), ("20 SEPT 99", "1999-09-20"), ("March 3rd, 2024", "2024-03-03"), ("JU 3 2024", None), ("13/13/2024", None), ("3/2024", None), ("", None)])
def test_date(spark, printed, day):
    assert spark.createDataFrame([(printed,)], "x string").select(normalize.date(F.col("x"))).first()[0] == day


def test_error_classes_add_back(spark):
    rng = random.Random(2)
    side = lambda: spark.createDataFrame([(d, f, str(rng.randint(0, 4))) for d in range(20) for f in ("amount_total_gross", "amount_total_net", "customer_id") if rng.random() < 0.8], "doc bigint, fieldtype string, text string")
    flags = scoring.field_flags(side(), side(), ["doc"]).cache()
    total = scoring.counted(flags.withColumn("all", F.lit(1)), ["all"]).first()
    n = {r["class"]: r.n for r in scoring.error_classes(flags, ["doc"]).groupBy("class").agg(F.sum("n").alias("n")).collect()}
    beside = n.get("net for gross", 0) + n.get("gross for net", 0)
    assert beside + n.get("wrong", 0) + n.get("misread date", 0) + n.get("missing", 0) == total.missing
    assert beside + n.get("wrong", 0) + n.get("misread date", 0) + n.get("spurious", 0) == total.spurious


def test_unlike_against_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd ") for _ in range(rng.randint(15, 60))) for _ in range(40)]
    texts = [w[:3] + rng.choice(["", "x"]) + w[4:] + rng.choice(["", "", "yy"]) for w in words]
    t = spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")
    e = spark.createDataFrame([(w,) for w in words], "description string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    clear = {i for i, x in enumerate(texts) if not any(1 - lev(x, w) / max(len(x), len(w)) >= 0.95 - 1e-9 for w in words)}
    assert {r.qid for r in retrieval.unlike(t, e).collect()} == clear


def test_logs(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, at int")
    rates = spark.createDataFrame([("a", 2, 0.1), ("a", 5, 0.2)], "k string, since int, rate double")
    assert sorted(map(tuple, logs.as_of(rows, rates, "k", "at", "since", "rate").collect()), key=str) == [("a", 1, None), ("a", 5, 0.2), ("b", 2, None)]
    edits = spark.createDataFrame([(1, "a", "x", "r"), (2, "a", "r", "r"), (3, "b", "y", "r")], "seq int, place string, value string, read string")
    assert [(r.place, r.value) for r in logs.fold(edits, ["place"], "seq").collect()] == [("b", "y")]


def test_calibration_keeps_one_in_the_last_bucket(spark):
    judged = spark.createDataFrame([(1.0, 1), (0.9, 0), (0.05, 1), (None, 1)], "confidence double, correct int")
    found = {r.bucket: (r.n, r.correct) for r in scoring.calibration(judged).collect()}
    assert found[9] == (2, 1) and found[0] == (1, 1) and found[-1] == (1, 1) and found[4] == (0, 0)


def test_sources(spark, tmp_path):
    note = {"field_extractions": [{"fieldtype": "id", "text": "1"}, {"fieldtype": "id", "text": "2"}], "line_item_extractions": [{"fieldtype": "q", "text": "9", "line_item_id": 7}, {"fieldtype": "q", "text": "8", "line_item_id": 3}], "metadata": {"page_count": 1}, "more": 1}
    (tmp_path / "d1.json").write_text(json.dumps(note))
    found = readers.annotations(spark, str(tmp_path / "d1.json"))
    assert readers.by_fieldtype(readers.header_values(found), ["doc"]).first().fields == {"id": ["1", "2"]}
    assert sorted((r.line, r.text) for r in readers.line_cells(found).collect()) == [(0, "8"), (1, "9")]
    (tmp_path / "p.json").write_text(json.dumps({"d1": {"fields": {"a": ["x", "", "y"], "b": "z", "c": None}}, "d2": {"fields": {}}}))
    assert sorted((r.doc, r.fieldtype, r.ord, r.text) for r in readers.predictions(spark, str(tmp_path / "p.json")).collect()) == [("d1", "a", 0, "x"), ("d1", "a", 2, "y"), ("d1", "b", 0, "z")]
    (tmp_path / "s.json").write_text('["d1", "d2"]')
    assert [r.doc for r in readers.split_ids(spark, str(tmp_path / "s.json")).collect()] == ["d1", "d2"]
    text = "k,v\n1,a\n2,b\n"
    (tmp_path / "l.csv").write_text(text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    assert readers.pinned_csv(spark, str(tmp_path / "l.csv"), digest, "k").count() == 2
    with pytest.raises(ValueError, match="digest"):
        readers.pinned_csv(spark, str(tmp_path / "l.csv"), "0", "k")
    lines = spark.createDataFrame([("202501", 2, "b"), ("202501", 1, "a")], "period string, ord int, line string")
    readers.write_periods(lines, str(tmp_path / "out"))
    assert next((tmp_path / "out" / "period=202501").glob("*.txt")).read_bytes() == b"a\r\nb\r\n"
