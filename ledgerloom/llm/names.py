"""Variant spellings of the names of persons and organisations.

A name is read into its rare part (the family names of a person or of a firm's founders) and its
common part (given name, trade, legal form, with their nicknames and abbreviations). Rare tokens
are compared by a prefix-filtered set-similarity join on their q-grams; the pairs of tokens that
pass are verified by edit similarity, and a whole name by a soft weighted similarity over its
tokens, in which rare tokens weigh by how seldom they come. Common tokens only decide between
parties of one family: a given name between relatives, a trade between firms of the same founders.

Every step works on distinct texts, then distinct tokens, then distinct sets of tokens, so a
spelling that a third of all records share is handled once. Records come back only for the last
join, on the party they were given.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import spelling
from ledgerloom.llm.spelling import distance
from ledgerloom.session import cut

# Legal forms, and the ways they are written.
LEGAL = {
    "llc": r"l\.? ?l\.? ?c\b",
    "srl": r"s\.? ?r\.? ?l\b",
    "gmbh": r"ges\.? ?m\.? ?b\.? ?h\b|g\.?m\.?b\.?h\b",
    "sa": r"sociedad anonima|s\.? ?a\b",
    "inc": r"incorporated|inc\b",
    "ltd": r"limited|ltd\b",
    "co": r"company|compania|co\b|cia\b",
    "group": r"group|grupo|gruppe|grp\b",
}
# Trades and their short or translated forms.
TRADES = {
    "tool supply": "tool supply tools sup supp supplies",
    "office supplies": "office off",
    "agricultural trading": "agricultural trading agri agric trdg trad",
    "maschinenbau": "maschinenbau masch bau maschinen",
    "bakery": "bakery bkry bak",
    "timber": "timber tmbr tim",
    "foods": "foods food fds",
    "printing": "printing print prtg",
    "engineering": "engineering eng engg engr",
    "packaging": "packaging pack pkg",
    "manufacturing": "manufacturing mfg manuf",
    "laboratories": "laboratories lab labs laboratory",
    "plumbing": "plumbing plbg plumb",
    "electrical": "electrical elec elect",
    "refrigeration": "refrigeration refrig refr",
    "distribuidora": "distribuidora distrib dist distr",
    "hardware": "hardware hardw hdwe hdw",
    "transport": "transport transp trspt",
    "chemicals": "chemicals chem chemical",
    "marine": "marine mar",
    "logistics": "logistics logist log",
    "textiles": "textiles text textile",
    "ferreteria": "ferreteria ferret ferr",
    "services": "services serv svcs svc",
}
# Given names and their short forms.
GIVEN = {
    "abigail": "abby gail", "alexander": "alex sandy alec xander", "beatriz": "bea betty", "charles": "charlie chuck chas", "concepcion": "concha conchita",
    "dolores": "lola dolly", "dorothy": "dot dolly dottie", "edward": "ed eddie ned ted teddy", "elizabeth": "betty liz beth lizzie", "enrique": "kike quique",
    "francisco": "paco pancho fco", "frederick": "fred freddy fritz", "gerald": "gerry jerry", "guadalupe": "lupe lupita", "heinrich": "heini heinz",
    "ignacio": "nacho", "isabel": "isa chabela", "johannes": "hans hannes", "jose": "pepe chepe", "katherine": "kate kathy kit",
    "leonard": "len lenny leo", "ludwig": "lutz", "margaret": "maggie meg peggy", "michael": "mick mike", "nicolas": "nico colas",
    "oliver": "ollie", "patricia": "pat patty trish", "quentin": "quin", "rafael": "rafa fallo", "robert": "rob bob bobby", "rosario": "charo",
    "susanna": "sue susie", "theodore": "ted teddy theo", "timothy": "tim timmy", "ulrike": "uli ulla", "vincent": "vince vinny",
    "william": "bill will wm billy", "yolanda": "yoli", "zacharias": "zach",
}
# Words that name nobody, and titles and notes beside a name.
FILLER = "n/a|-|na|none|unknown|various|cash sale|cash customer|consumidor final|walk-in|walk in|kunde bar|see letterhead|idem|same|tbd|customer|diverse|varios"
BESIDE = r"\((?:[^)]*)\)|\b(?:accounts|dept|branch|hq|buyer|remit to|attn|att|acct|e\.u|holder|mr|mrs|ms|miss|dr|herr|frau|sr|sra|srta|lic|ing|don|dona|esq|prof|the)\b\.?(?: ?\d+\b)?"
_FILLER = re.compile(rf"(?:{FILLER})[.\s]*")
_BESIDE = re.compile(BESIDE)
_LEGAL = {k: re.compile(rf"(?:(?<=[\s,])|^)(?:{v})\.?(?=[\s,.*]|$)") for k, v in LEGAL.items()}
_TRADE = {w: t for t, words in TRADES.items() for w in words.split()}
_GIVEN: dict[str, tuple[str, ...]] = {}
for _n, _short in GIVEN.items():
    for _w in (_n, *_short.split()):
        _GIVEN[_w] = (*_GIVEN.get(_w, ()), _n)
_JOINS = {"and", "y", "u", "und", "de", "e", "et"}
_DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "7": "t", "4": "a", "3": "e"})


def plain(text: str) -> str:
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", unicodedata.normalize("NFKC", text))
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def _exact(word: str) -> tuple[str, object] | None:
    if word in _GIVEN:
        return "given", _GIVEN[word]
    if word in _TRADE:
        return "trade", _TRADE[word]
    return None


@lru_cache(maxsize=200_000)
def _close(word: str) -> tuple[int, str, object] | None:
    """(edits, kind, meaning) of the common word a misspelt one is nearest to."""
    best: tuple[int, str, object] | None = None
    for kind, table in (("trade", _TRADE), ("given", _GIVEN)):
        for known, value in table.items():
            most = 0 if len(known) < 4 else 1 if len(known) < 6 else 2
            if most and (known[0] == word[0] or known[1:3] == word[1:3] or known[-3:] == word[-3:]):
                d = distance(word, known, most)
                if d <= most and (best is None or d < best[0]):
                    best = d, kind, value
    if best is None and len(word) >= 3:  # cut off at the end of the field
        cut_off = {v for w, v in _TRADE.items() if len(w) > 5 and w.startswith(word)}
        if len(cut_off) == 1:
            return 3, "trade", cut_off.pop()
        if any(w.startswith(word) for w in ("incorporated", "limited", "company", "sociedad", "group")):
            return 3, "legal", ""
    return best


def read(text: str | None) -> dict | None:
    """A name's parts: kind, rare tokens in order, the given names it may mean, its initials, trade
    and legal form. None for a null, an empty text or a filler, which name nobody."""
    if not text:
        return None
    s = re.sub(r"\s+", " ", plain(text)).strip(" *.,;:")
    if not s or _FILLER.fullmatch(s) or not re.search(r"[^\W\d_]{2}", s):
        return None
    s = _BESIDE.sub(" ", s)
    legal = ""
    for name, pattern in _LEGAL.items():
        if m := pattern.search(s):
            legal, s = name, s[: m.start()] + " " + s[m.end() :]
            break
    joined = bool(re.search(r"[&+/]|\b(?:and|und)\b", s))
    words: list[tuple[str, tuple | None]] = []
    for word in re.findall(r"[^\W_]+", s):
        if not word.isdigit() and (word not in _JOINS or len(word) == 1):
            words.append((word, _exact(word)))
    unknown = [w for w, k in words if k is None and len(w) > 2]
    if len(unknown) > 2:  # of more than two rare words, those nearest to common ones are these, misspelt
        near = sorted((c[0], i, w) for i, w in enumerate(unknown) if (c := _close(w)))
        for _, _, word in near[: len(unknown) - 2]:
            words = [(w, _close(w)[1:] if w == word else k) for w, k in words]
    given: tuple[str, ...] = ()
    trades, rare, initials = [], [], []
    for at, (word, known) in enumerate(words):
        if len(word) == 1:
            between = 0 < at < len(words) - 1 and all(k is None and len(w) > 2 for w, k in (words[at - 1], words[at + 1]))
            if word in "yue" and between:
                joined |= word == "u"
            else:
                initials.append(word)
        elif known and known[0] == "trade":
            if known[1] not in trades:
                trades.append(known[1])
        elif known and not given:
            given = known[1]
        elif known is None and len(word) > 2:
            rare.append(word.translate(_DIGITS))
    if "office supplies" in trades and "tool supply" in trades:
        trades.remove("tool supply")
    person = not trades and not legal and not joined and bool(given or initials) and not (initials and not given and words[-1][0] == initials[-1] and "," not in s and "." not in s and len(words) == 3 and re.search(r"\by\b|-", s) is not None)
    return {
        "kind": "person" if person else "firm",
        "rare": rare,
        "given": "|".join(given) if person else "",
        "initial": initials[0] if person and initials and not given else "",
        "trade": "" if person or not trades else trades[0],
        "legal": "" if person else legal,
    }


READ = "name_id string, kind string, a string, b string, given string, initial string, trade string, legal string"


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        out = []
        for name_id, text in zip(batch["name_id"], batch["text"], strict=True):
            if (r := read(text)) and r["rare"]:
                rare = r["rare"] if len(r["rare"]) <= 2 else [r["rare"][0], " ".join(r["rare"][1:])]
                a, b = (*rare, "")[:2]
                out.append((name_id, r["kind"], a, b, r["given"], r["initial"], r["trade"], r["legal"]))
        yield pd.DataFrame(out, columns=names)


PAIRS = "low string, high string, to_low string, to_high string"
MIN_SIMILARITY = 0.7


def _families(records: DataFrame) -> DataFrame:
    """For each pair of rare tokens (low <= high), the pair it most likely spells.

    A pair may stand for any pair of the words its tokens may stand for. Each pair of records
    votes for those, less for every edit; a pair goes to the candidate with the most votes whose
    soft weighted similarity - the tokens' edit similarities, weighted by how seldom the words
    meant come - is high enough.
    """
    tokens = records.select(F.explode(F.array("a", "b")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    tokens = cut(tokens)
    near = spelling.meant(tokens)
    options = cut(
        tokens.select("word", F.col("word").alias("meant"), F.lit(0).alias("edits"), F.col("n").alias("m")).unionByName(near.select("word", "meant", "edits", "m"))
    )
    pairs = records.groupBy("low", "high").agg(F.count("*").alias("n"))
    size = F.length("word")
    side = lambda name: options.select(
        F.col("word").alias(name), F.col("meant").alias(f"to_{name}"), F.col("edits").alias(f"edits_{name}"),
        (1 - F.col("edits") / F.greatest(size, F.length("meant"))).alias(f"like_{name}"), (1 / F.log2(F.col("m") + 2)).alias(f"weight_{name}"),
    )
    both = pairs.join(side("low"), "low").join(side("high"), "high", "left").withColumns(
        {"to_high": F.coalesce("to_high", F.lit("")), "edits_high": F.coalesce("edits_high", F.lit(0))}
    )
    soft = (F.col("like_low") * F.col("weight_low") + F.coalesce(F.col("like_high") * F.col("weight_high"), F.lit(0.0))) / (F.col("weight_low") + F.coalesce("weight_high", F.lit(0.0)))
    ways = both.withColumns({"edits": F.col("edits_low") + F.col("edits_high"), "soft": soft}).where(F.col("soft") >= MIN_SIMILARITY)
    ways = ways.select("low", "high", "n", F.least("to_low", "to_high").alias("x"), F.greatest("to_low", "to_high").alias("to_high"), "edits", "soft").withColumnRenamed("x", "to_low")
    # Two words written as one: each way to split it into words that records carry.
    known = tokens.where("n >= 2").select("word")
    at = F.explode(F.sequence(F.lit(4), F.length("low") - 4)).alias("at")
    split = pairs.where("high = '' and length(low) >= 9").select("low", "high", "n", at).select(
        "low", "high", "n", F.expr("substr(low, 1, at)").alias("x"), F.expr("substr(low, at + 1)").alias("y")
    )
    split = split.join(known.withColumnRenamed("word", "x"), "x").join(known.withColumnRenamed("word", "y"), "y")
    split = split.select("low", "high", "n", F.least("x", "y").alias("to_low"), F.greatest("x", "y").alias("to_high"), F.lit(1).alias("edits"), F.lit(0.95).alias("soft"))
    ways = cut(ways.unionByName(split))
    votes = ways.groupBy("to_low", "to_high").agg(F.sum(F.col("n") * F.pow(F.lit(0.5), F.col("edits"))).alias("votes"))
    value = F.log(F.col("votes") + 1e-9) + F.log("soft") * 4
    best = ways.join(votes, ["to_low", "to_high"]).groupBy("low", "high").agg(F.max_by(F.struct("to_low", "to_high"), F.struct(value.alias("v"), F.col("to_low"), F.col("to_high"))).alias("_b"))
    return best.select("low", "high", "_b.*")


def _parties(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The party of each form of a family's names; forms are (kind, given, initial, trade, legal, n)."""
    for batch in batches:
        out = []
        for low, high, forms in zip(batch["to_low"], batch["to_high"], batch["forms"], strict=True):
            out.extend((low, high, f["kind"], f["given"], f["initial"], f["trade"], f["legal"], p) for f, p in zip(forms, parties(list(forms)), strict=True))
        yield pd.DataFrame(out, columns=["to_low", "to_high", "kind", "given", "initial", "trade", "legal", "party"])


def parties(forms: list[dict]) -> list[str | None]:
    """Relatives differ by given name, firms of the same founders by trade. A form that leaves out
    what tells them apart goes to the one party it fits; where it fits several, to the most
    frequent of those whose legal form agrees, if it is a firm, else to none."""
    given: dict[str, int] = {}
    trades: dict[tuple[str, str], int] = {}
    for f in forms:
        if f["kind"] == "person" and f["given"] and "|" not in f["given"]:
            given[f["given"]] = given.get(f["given"], 0) + f["n"]
        elif f["kind"] == "firm" and f["trade"]:
            key = f["trade"], f["legal"]
            trades[key] = trades.get(key, 0) + f["n"]
    by_trade: dict[str, int] = {}
    legal_of: dict[str, dict[str, int]] = {}
    for (trade, legal), n in trades.items():
        by_trade[trade] = by_trade.get(trade, 0) + n
        legal_of.setdefault(trade, {})[legal] = legal_of.get(trade, {}).get(legal, 0) + n
    out: list[str | None] = []
    for f in forms:
        if f["kind"] == "person":
            named = f["given"].split("|") if f["given"] else []
            fits = [g for g in given if g in named] if named else [g for g in given if g[0] == f["initial"]]
            if len(fits) == 1:
                out.append(f"person/{fits[0]}")
            elif len(named) == 1:
                out.append(f"person/{named[0]}")
            elif fits:
                out.append(None)
            else:
                out.append(f"person/{f['given'] or f['initial']}")
        elif f["trade"]:
            out.append(f"firm/{f['trade']}")
        else:
            fits = list(by_trade)
            if f["legal"] and len(fits) > 1:
                same = [t for t in fits if f["legal"] in legal_of[t]]
                fits = same or fits
            if len(fits) == 1:
                out.append(f"firm/{fits[0]}")
            elif fits:
                out.append(None)
            else:
                out.append("firm/")
    return out


def resolve(names: DataFrame) -> DataFrame:
    """`name_id, party` of every name that names somebody.

    `names` has name_id (unique) and text. Null and empty texts and fillers have no row. A name
    that fits several parties and says nothing to choose by has a party of its own. Equal texts
    get the same party.
    """
    records = names.select("name_id", "text").mapInPandas(_read, READ)
    records = cut(records.withColumns({"low": F.when(F.col("b") == "", F.col("a")).otherwise(F.least("a", "b")), "high": F.when(F.col("b") == "", F.col("b")).otherwise(F.greatest("a", "b"))}))
    family = records.join(_families(records), ["low", "high"])
    family = cut(family.select("name_id", "to_low", "to_high", "kind", "given", "initial", "trade", "legal"))
    form = ["kind", "given", "initial", "trade", "legal"]
    forms = family.groupBy("to_low", "to_high", *form).agg(F.count("*").alias("n")).groupBy("to_low", "to_high").agg(F.collect_list(F.struct(*form, "n")).alias("forms"))
    found = forms.mapInPandas(_parties, "to_low string, to_high string, kind string, given string, initial string, trade string, legal string, party string")
    party = F.concat_ws("/", "to_low", "to_high", F.coalesce("party", F.concat(F.lit("alone/"), F.col("name_id"))))
    return family.join(found, ["to_low", "to_high", *form]).select("name_id", party.alias("party"))


def same_party(names: DataFrame) -> DataFrame:
    """`name_a, name_b`: each pair of name records of one party, the smaller id first."""
    found = cut(resolve(names))
    left = found.select("party", F.col("name_id").alias("name_a"))
    right = found.select("party", F.col("name_id").alias("name_b"))
    return left.join(right, "party").where("name_a < name_b").select("name_a", "name_b")
