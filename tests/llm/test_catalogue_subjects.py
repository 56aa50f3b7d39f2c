import random

import pytest

from ledgerloom.llm import catalogue, subjects

ENTRIES = [("S1", "annealed copper pipe 12 mm"), ("S2", "half hard copper pipe 32 mm"), ("S3", "two ply paper towel pack of 12"), ("S4", "blue paper towel pack of 6"), ("S5", "galvanised carriage bolt m10 x 40"), ("S6", "freight and delivery charge"), ("S7", "white tile grout 10 kg"), ("S8", "satin ivory wall paint 2.5 l"), (None, "x"), ("S9", None)]


def test_bk_tree_loses_no_word():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
    words = sorted({word() for _ in range(300)})
    tree = catalogue.BKTree(words)
    for _ in range(60):
        w, most = word(), rng.randint(0, 3)
        at = catalogue.masks(w)
        assert tree.within(w, most) == sorted((d, x) for x in words if (d := catalogue.levenshtein(at, len(w), x)) <= most)
    assert catalogue.BKTree([]).within("a", 2) == []


@pytest.mark.parametrize(
    ("text", "sku"),
    [
        ("copper pipe, annealed, 1.2 cm", "S1"), ("PO 77223 CU TUBE 12MM ANNEALED lot 12", "S1"), ("coper pipe 32-mm (half hard)", "S2"), ("annealed copper pipe 13 mm", "unmatched"), ("half hard copper pipe 12 mm", "unmatched"), ("copper pipe 32 mm", "S2"),
        ("Küchenrolle two ply x12", "S3"), ("ppr towel - 6 pk - blu (by the pair)", "S4"), ("M10*40 crrg blt galv.", "S5"), ("Frachtkosten Lieferung", "S6"), ("frght & dlvry chg", "S6"), ("10 kilo tile grout", "S7"), ("wall paint 2,5 L satin ivory", "S8"), ("vintage sundial no 9", "unmatched"), ("misc items", "unmatched"),
    ],
)
def test_search(text, sku):
    index = catalogue.Shard([(s, d) for s, d in ENTRIES if s and d])
    assert index.search(text)[1] == sku


@pytest.mark.parametrize(("text", "sku"), [("Braided nilon rope 8 mm", "S1"), ("Recycled copy papel a3 75 gsm", "S2"), ("HEX BELT - M10 X 60MM - BLACK", "S3"), ("ribbed drive belt no 4", "S4"), ("soga nilon 8 mm", "S1"), ("papel bond a3 75 gsm", "S2")])
def test_a_word_of_the_list_may_stand_for_another(text, sku):
    entries = [("S1", "braided nylon rope 8 mm"), ("S2", "recycled copy paper a3 75 gsm"), ("S3", "black hex bolt m10 x 60"), ("S4", "ribbed drive belt no 4")]
    assert catalogue.Shard(entries).search(text)[1] == sku


def test_lookup_keeps_every_word_within_the_threshold():
    index = catalogue.Shard([("S1", "braided nylon rope 8 mm"), ("S2", "black hex bolt m10 x 60"), ("S4", "ribbed drive belt no 4")])
    assert index.means("belt") == {"belt": 0.0, "bolt": 0.55}
    assert index.means("nilon") == {"nilon": 0.0, "nylon": 0.55}


def test_every_word_of_a_long_text_counts():
    index = catalogue.Shard([(s, d) for s, d in ENTRIES if s and d])
    codes = " ".join(f"zq{i}" for i in range(10, 50))  # words with digits cost nothing
    assert index.search(f"{codes} annealed copper pipe 12 mm")[1] == "S1"
    assert index.search("annealed copper pipe 12 mm")[1] == index.search(f"annealed copper pipe 12 mm {codes}")[1] == "S1"
    assert index.search(f"annealed copper pipe 12 mm {codes} vintage sundial harp saddle")[1] == "unmatched"


def test_match(spark, monkeypatch):
    entries = spark.createDataFrame(ENTRIES, "sku string, description string")
    lines = spark.createDataFrame([(1, "annealed copper pipe 12 mm", 0.5), (1, "annealed copper pipe 12 mm", 0.5), (2, None, 1.0), (3, "  --", 1.0), (4, "", 1.0), (5, "?9", 1.0), (6, "copper " * 20_000, 1.0)], "line_id bigint, text string, cost double")
    want = [(1, "S1"), (1, "S1"), (5, "unmatched"), (6, "unmatched")]
    assert sorted(map(tuple, catalogue.match(lines, entries).collect())) == want
    assert {r.sku for r in catalogue.match(lines, entries.where("false")).collect()} == {"unmatched"}
    monkeypatch.setattr(catalogue, "SHARD", 3)
    assert sorted(map(tuple, catalogue.match(lines, entries).distinct().collect())) == sorted(set(want))


def test_result_does_not_depend_on_shards(spark):
    """Also where another shard knows a word, or a finish of the same article."""
    listed = [("B1", "white wall paint 10 l"), ("B2", "blue wall paint 5 l"), ("B3", "brown rope 4 mm"), ("B4", "blue rope 4 mm"), ("B5", "garden hose 10 m"), ("B6", "wood panel 4 mm"), *[(s, d) for s, d in ENTRIES if s and d]]
    texts = ["blue wall paint 10 l", "white wall paint 10 l", "wall paint 10 l", "blu rope 4 mm", "rope 4 mm", "brown panel 4 mm", "wod panel 4mm", "hose 10 m", "copper pipe 32 mm", "annealed copper pipe 32 mm", "freight", "blue garden hose 10 m"]
    entries = spark.createDataFrame(listed, "sku string, description string")
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, text string")
    found = [sorted(map(tuple, catalogue.match(lines, entries, shards=n).collect())) for n in (1, 2, 8)]
    assert found[0] == found[1] == found[2]
    assert dict(found[0])[0] == "unmatched"


def test_unseen_catalogue():
    """Articles the code has no names for, given a table of their other names, keyed with typos, short forms and other orders."""
    rng = random.Random(11)
    nouns = ["brass kettle", "canvas tent", "quartz clock", "ceramic vase", "rubber mallet", "velvet curtain", "walnut shelf", "chrome faucet", "linen apron", "pewter tankard"]
    finishes = ["polished", "matte", "striped", "hammered", "folding", "insulated"]
    marks = ["12 mm", "30 mm", "2 kg", "5 kg", "no 3", "no 8"]
    other = {"brass kettle": "messingkessel", "canvas tent": "segeltuchzelt", "quartz clock": "reloj cuarzo"}
    entries = [(f"N{i}", f"{f} {n} {m}") for i, (n, f, m) in enumerate((n, f, m) for n in nouns for f in finishes for m in marks) if i % 3]
    index = catalogue.Shard(entries, names=other)

    def keyed(text):
        noun = next(n for n in nouns if n in text)
        if noun in other and rng.random() < 0.2:
            text = text.replace(noun, other[noun])
        words = text.split()
        at = rng.randrange(len(words) - 2)
        w = words[at]
        if rng.random() < 0.5 and len(w) > 5:
            i = rng.randrange(1, len(w) - 1)
            words[at] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("xzqk") + w[i + 1 :]])
        elif len(w) > 6:
            words[at] = w[0] + "".join(c for c in w[1:] if c not in "aeiou")
        size = words[-2:]
        head = words[:-2]
        return " ".join(rng.choice([head + size, size + head, [*head[1:], *size, ",", head[0]]])).upper()

    cases = [(keyed(d), sku) for sku, d in entries for _ in range(2)]
    right = sum(index.search(text)[1] == sku for text, sku in cases)
    assert right / len(cases) >= 0.9, right / len(cases)
    absent = [f"{f} {n} {m}" for i, (n, f, m) in enumerate((n, f, m) for n in nouns for f in finishes for m in marks) if not i % 3]
    assert sum(index.search(text)[1] == "unmatched" for text in absent) / len(absent) >= 0.9


def test_subjects(spark):
    rng = random.Random(7)
    goods = {"food": ["rye loaves", "olive jars", "lunch trays", "red wine"], "law": ["court days", "will drafting", "deed copies", "notary acts"]}
    idle = ["Payment is due within 8 days.", "The ball is in your court now.", "Please find the details below.", "Our reference is 4."]

    def text(own):
        lines = [rng.choice(idle) for _ in range(6)] + [f"We order {rng.randint(2, 90)} {rng.choice(goods[s])} at 3.10" for s in own]
        rng.shuffle(lines)
        return "\n".join(lines)

    cases = [[["food"], ["law"], ["food", "law"], []][i % 4] for i in range(600)]
    docs = [(i, text(own), 0, "x") for i, own in enumerate(cases)] + [(9000, None, 0, "x"), (9001, "", 0, "x"), (9002, "zz " * 100_000, 0, "x")]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars int, subject string")
    examples = spark.createDataFrame([(i, s) for i, own in enumerate(cases[:300]) for s in own or ["none"]], "doc_id bigint, subject string")
    listed = spark.createDataFrame([("food", "meals"), ("law", "courts")], "subject string, meaning string")
    found = {tuple(r) for r in subjects.assign(documents, examples, listed).collect()}
    want = {(i, s) for i, own in enumerate(cases) if i >= 300 for s in own}
    assert len(found & want) / len(found | want) > 0.95
    assert subjects.assign(documents, examples.where("false"), listed).count() == 0
    assert subjects.assign(documents.where("false"), examples, listed).count() == 0


def test_threshold():
    import numpy as np

    assert 0.3 < subjects.calibrated(np.array([0.9, 0.8, 0.1, 0.2]), np.array([1.0, 1, 0, 0])) < 0.8
    assert subjects.calibrated(np.array([0.9]), np.array([0.0])) == 0.0
