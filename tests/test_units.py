import itertools
import json
import random
from fractions import Fraction

import pytest

from ledgerloom.operators import units


@pytest.mark.parametrize(
    ("text", "value"),
    [("1,234.5", "1234.5"), ("1.234,5", "1234.5"), ("1,234", "1234"), ("1,5", "1.5"), ("1.234", "1.234"), ("2 3/4", "2.75"), ("1½", "1.5"), ("(12)", "-12"), ("7-", "-7"), ("13'199", "13199"), ("1 234,5", "1234.5"), ("1.234.567", "1234567"), ("2E2", "200")],
)
def test_number(text, value):
    assert units.number(text) == Fraction(value)


@pytest.mark.parametrize("text", ["lz", "n/a", "-", "", "1,2,3", "1/0"])
def test_unreadable_number(text):
    assert units.number(text) is None


@pytest.mark.parametrize(
    ("quantity", "unit", "description", "base"),
    [
        ("3", "dozen", None, 36), ("2", "ctn (10)", None, 20), ("5", "BAG/10KG", None, 50_000), ("6 lb 4 oz", None, None, 2835), ("5' 6\"", None, None, 1676), ("2:30 h", None, None, 150),
        ("13", None, "drive belt (by the pair)", 26), ("4", None, "oil - sold per gallon", 15142), ("-2 kg", "-", None, -2000), ("3", "50 lb sack", None, 68039), ("1", "GJ", None, 277778), ("2", "x 250 g", None, 500),
    ],
)
def test_base_amount(quantity, unit, description, base):
    amount, found = units.stated(quantity, unit, description)
    name, many, _ = found[0]
    assert units.rounded(amount * many * units.SIZES[name]) == base


@pytest.mark.parametrize(("quantity", "unit", "description"), [("3", "box", None), ("3", None, "wall paint 5 l"), (None, "kg", None), ("see note", "kg", None), ("4", "roll", "hose (by the foot)"), ("5", None, None)])
def test_not_convertible(quantity, unit, description):
    assert units.stated(quantity, unit, description) is None


def random_steps(rng, n):
    states = [("oz", "mass"), ("fl_oz", "volume"), ("gross", "count"), ("g", "mass")]
    return [[(u, d, units.whole(-rng.random() * 4)) for u, d in rng.sample(states, rng.choice([1, 2, 2, 3]))] for _ in range(n)]


def worth(steps, path):
    return sum(s[k][2] for s, k in zip(steps, path, strict=True)) + sum(units.moved(a[x], b[y]) for (a, b), (x, y) in zip(itertools.pairwise(steps), itertools.pairwise(path), strict=True))


def test_viterbi_is_the_best_of_all_paths():
    rng = random.Random(3)
    for _ in range(60):
        steps = random_steps(rng, 6)
        every = list(itertools.product(*(range(len(s)) for s in steps)))
        assert worth(steps, units.viterbi(steps)) == max(worth(steps, p) for p in every)
        first, last = 0, len(steps[-1]) - 1
        bound = max(worth(steps, p) for p in every if p[0] == first and p[-1] == last)
        assert worth(steps, units.viterbi(steps, first, last)) == bound == units.through(steps)[first][last]


def test_blocks_join_to_the_whole_chain():
    rng = random.Random(4)
    for _ in range(30):
        steps = random_steps(rng, 40)
        whole = units.viterbi(steps)
        for size in (1, 3, 7, 25):
            parts = [steps[i : i + size] for i in range(0, len(steps), size)]
            known = units.joined([{"block": b, "place": 0, "device": "d", "first": json.dumps(p[0]), "last": json.dumps(p[-1]), "scores": json.dumps(units.through(p))} for b, p in enumerate(parts)])
            path = [k for b, p in enumerate(parts) for k in units.viterbi(p, *known.get((b, "d"), (None, None)))]
            assert worth(steps, path) == worth(steps, whole)
            assert path == whole


def test_result_does_not_depend_on_blocks(spark):
    """A frequent device whose unit changes, cut in any number of blocks, and devices inside blocks."""
    rng = random.Random(5)
    bases = spark.createDataFrame([("mass", "g"), ("count", "ea"), ("volume", "ml")], "dimension string, base_unit string")
    data = []
    for i in range(4000):
        volume = (i // 400) % 2 == 0
        unit = rng.choice(["oz", "oz", "oz", "l" if volume else "kg"])
        data.append((i, str(rng.choice([1, 2, 9000])), unit, "olive syrup extra" if i % 7 else f"paper number{i % 5} other", float(i * 3600)))
    lines = spark.createDataFrame(data, "line_id bigint, quantity string, unit string, description string, at double")
    found = [sorted(map(tuple, units.base_amounts(lines, bases, blocks=n).collect())) for n in (1, 2, 8)]
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == 4000 and len({r[1] for r in found[0]}) == 2


def test_device_survives_misspelling():
    assert units.device_of("Graphite gasket set, no 4") == units.device_of("grphite  GASKET, No. 4")
    assert units.device_of(None) == []


def test_lines(spark):
    bases = spark.createDataFrame([("mass", "g"), ("count", "ea"), ("volume", "ml")], "dimension string, base_unit string")
    data = [(i, "2", "l", "olive syrup extra", float(i), "x") for i in range(60)] + [(100, "3", "oz", "olive syrup extra", 99.0, "x"), (101, "3", "oz", "iron filings heavy", 99.0, "x"), (102, None, None, None, None, "x"), (103, "3 km", None, "rope", 1.0, "x")]
    lines = spark.createDataFrame(data, "line_id bigint, quantity string, unit string, description string, at double, base_amount string")
    found = {r.line_id: (r.base_unit, r.base_amount) for r in units.base_amounts(lines, bases).collect()}
    assert found[0] == ("ml", 2000)
    assert found[100] == ("ml", 89)  # the article's other lines are volumes
    assert found[101] == ("g", 85)
    assert set(found) == {*range(60), 100, 101}
    assert units.base_amounts(lines.where("false"), bases).count() == 0
