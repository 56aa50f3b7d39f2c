import random

from ledgerloom.llm import addresses, names, spelling


def test_meant_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9)))
    strong = {word(): 50 for _ in range(60)}
    weak = {}
    for w in list(strong):
        i = rng.randrange(len(w))
        weak[w[:i] + rng.choice("abcdef") + w[i + 1 :]] = 1
        weak[w[:i] + w[i + 1 :]] = 1
    weak = {w: 1 for w in weak if w not in strong}
    rows = [(w, n, "x") for w, n in {**strong, **weak, "": 3}.items()]
    found = {(r.word, r.meant) for r in spelling.meant(spark.createDataFrame(rows, "word string, n bigint, meant string")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    most = lambda w: 0 if len(w) < 4 else 1 if len(w) < 6 else 2
    assert found == {(w, s) for w in weak for s in strong if lev(w, s) <= most(w)}


NAMES = [
    ("Robert Lukidin Kerenin", "r"), ("Kerenin", None), ("LUKIDIN KERENIN, BOB", "r"), ("Mr. Robret Lukidn de Kerenin", "r"), ("R. Lukidin Kerenin", "r"), ("Susanna Lukidin Kerenin", "s"),
    ("Firtazel & Privigan Tool Supply Inc", "t"), ("FIRTAZEL PRIVIGAN TOOLS", "t"), ("Tool Supply Privigan-Firtazel Incorporated", "t"), ("Firtazel and Privigan Bakery SRL", "b"), ("Firtazel/Privigan S.R.L.", "b"),
]


def test_parties(spark):
    fill = [("Robert Lukidin Kerenin", "r"), ("Firtazel & Privigan Tool Supply Inc", "t")] * 3
    listed = [*NAMES, *fill]
    rows = [(f"{i}/vendor_name", text, "x") for i, (text, _) in enumerate(listed)] + [("90/v", None, "x"), ("91/v", "", "x"), ("92/v", "N/A", "x"), ("93/v", "see letterhead", "x"), ("94/v", "x" * 50_000, "x")]
    df = spark.createDataFrame(rows, "name_id string, text string, party string")
    found = {(r.name_a, r.name_b) for r in names.same_party(df).collect()}
    same = lambda i, j: tuple(sorted((f"{i}/vendor_name", f"{j}/vendor_name")))
    want = {same(i, j) for i, (_, a) in enumerate(listed) for j, (_, b) in enumerate(listed) if i < j and a == b and a}
    assert found == want
    assert names.same_party(df.where("false")).count() == 0


ADDRESSES = [
    ("12 Nulodus Parkway\nFort Gogikik, GX 45355\nOstrelia", "p"), ("FT GOGIKIK, KRITUVAN 45355\nTWELVE NLODUS PARKWAY", "p"), ("12 Nulodus Pkwy; Fort Gogikik, GX 45355", "p"), ("10 Nulodus Parkway, Fort Gogikik, GX 45355", "q"),
    ("Kelmoderstraße 694, Top 30\n22468 Surtesik", "k"), ("Kelmoder Nr. 694, Einheit 30, 22468 Surtesik, SF", "k"), ("Kelmoderstrasse 694, Tür 30\n22468", "k"), ("Kelmoderstraße 694, Top 31\n22468 Surtesik", "l"), ("c/o Mailroom\nKelmoderstr. 694 Top 30 22468 Surtesik", "k"),
    ("see letterhead", None), ("wie oben", None),
]


def test_locations(spark):
    listed = [*ADDRESSES, ("12 Nulodus Parkway\nFort Gogikik, GX 45355", "p"), ("Kelmoderstraße 694, Top 30\n22468 Surtesik", "k")]
    rows = [(f"{i}/v", text, "x") for i, (text, _) in enumerate(listed)] + [("90/v", None, "x"), ("91/v", "", "x"), ("92/v", "1 " + "x" * 50_000, "x")]
    df = spark.createDataFrame(rows, "address_id string, text string, entry string")
    found = {(r.address_a, r.address_b) for r in addresses.same_location(df).collect()}
    want = {tuple(sorted((f"{i}/v", f"{j}/v"))) for i, (_, a) in enumerate(listed) for j, (_, b) in enumerate(listed) if i < j and a == b and a}
    assert found == want
    assert addresses.same_location(df.where("false")).count() == 0


def test_names_after_the_eighth_and_a_ninth_postcode_count(spark):
    long = "Tallin Verbo Quandar Hesmil Dorvan Peltor Wixom Granel\n12 Merolin Street\nBorkabel, TX 99999"
    listed = [f"{20 + i} Merolin Street\nBorkabel, TX {str(i % 8 + 1) * 5}" for i in range(16)] + ["12 Merolin Street\nBorkabel, TX 99999", "12 Merolin Street\n99999", long]
    assert addresses.read(long)["words"][-2:] == ["merolin", "borkabel"]
    df = spark.createDataFrame([(f"{100 + i}/v", text) for i, text in enumerate(listed)], "address_id string, text string")
    assert {tuple(r) for r in addresses.same_location(df).collect()} == {("116/v", "117/v"), ("116/v", "118/v"), ("117/v", "118/v")}


def test_read_address():
    r = addresses.read("U31, PEGURER CL 96\nGREAT BORKABEL, LR28 6EQ")
    assert (r["number"], r["unit"], r["postcode"], r["street"], r["locality"]) == ("96", "31", "lr286eq", "pegurer", "borkabel")
    r = addresses.read("AV. BRERTADIK, NO. 3O4, OF. 21 864LL PUERTO BINDENIN")
    assert (r["number"], r["unit"], r["postcode"]) == ("304", "21", "86411")
