"""Postal addresses of one location, however they are written.

A gazetteer is built from the addresses themselves: texts that are laid out plainly (a street
with its number in one part, a locality in another) give streets within localities, misspelt
ones are clustered with the spelling that comes more often, and each street gets an identifier
with the postcodes and regions seen with it. Every address is then resolved by a beam search over
the gazetteer: its words, in any order and spelling, propose streets; each proposal is scored by
how well the street, the locality, the postcode and the region fit and by what is left unused.
Addresses of one street identifier, house number and unit denote the same location.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import spelling
from ledgerloom.llm.spelling import distance
from ledgerloom.session import cut

# Words of addresses that are no names.
STREET_BEFORE = "calle c avenida avda ave av carretera carr ctra paseo pso po camino plaza"
STREET_AFTER = "street st road rd avenue ave lane ln la drive dr boulevard blvd boul parkway pkwy pky close cl crescent cres cresc terrace ter terr gardens gdns gds court way square sq place strasse str weg allee platz pl gasse"
STREET_ENDINGS = "strasse straße str weg allee platz pl gasse".split()
LOCALITY_WORDS = "puerto pto villa v san s santa bad b neu nova alta falls fls fl fort ft mount mt port pt saint ste great gt grt upon tarn tam am see a ober o u on the de new upper lower"
UNIT_WORDS = "unit ut flat apt apartment suite ste local loc oficina of top tur einheit office"
NUMBER_MARKS = "no nr n num numero nro"
NOISE = (
    r"attn:?\s*accounts payable|c/o\s*mailroom|\d+(?:st|nd|rd|th) floor(?: reception)?|buchhaltung|goods in,?\s*rear gate|warehouse \d+|[a-z0-9]+ house\b|almacen\b(?:\s*\d+\b(?=\s*[\n,;]))?"
)
COUNTRIES = r"(?:rep\.?\s*(?:of|de)\s*)?(?:valdoria|ostrelia|norrmark(?:\s*\(?nm\)?)?|brenwick\s*is(?:les)?\b\.?)|(?<![a-z])(?:b\.\s?i\.|bi|val|ost|nmk)(?![a-z.])"
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}

_NOISE, _COUNTRIES = re.compile(NOISE), re.compile(COUNTRIES)
_BEFORE, _AFTER, _LOCAL = set(STREET_BEFORE.split()), set(STREET_AFTER.split()), set(LOCALITY_WORDS.split())
_UNITS = "|".join(sorted(UNIT_WORDS.split(), key=len, reverse=True))
_DIGIT = "[0-9oilzsb]"
_UNIT = re.compile(rf"(?<![a-z])(?:{_UNITS})\s*[.:]?\s*[#º°]?\s*((?=[oilzsb]*\d)[0-9oilzsb]+[a-z]?)(?![a-z0-9])|(?<![a-z])u\s?(\d+)(?![a-z0-9])")
_SLASH_UNIT = re.compile(r"(?<=[\s,])/\s*(\d+)(?![a-z0-9])|(?<=,)\s*#\s*(\d+)(?![a-z0-9])")
_UK = re.compile(r"(?<![a-z0-9])(?=[a-z]{2}\s?[oilzsb]?\d)([a-z]{2})\s?([0-9oilzsb]{1,2})\s*([0-9oilzsb])([a-z]{2})(?![a-z0-9])")
_ZIP = re.compile(r"(?<![a-z0-9])(?:n\s?-\s?)?((?=(?:[oilzsb]*\d){3}|[0-9oil]{5}(?![a-z0-9]))(?=[oilzsb]*\d)[0-9oilzsb]{5})(?:\s?-\s?[0-9oilzsb]{4})?(?![a-z0-9])")
_NUMBER = re.compile(rf"(?<![a-z0-9])(?:(?:{'|'.join(NUMBER_MARKS.split())})\s?[.º°]*\s?|#\s*|[º°]\s*)?((?=[oilzsb]?[oilzsb]?\d)[0-9oilzsb]{{1,5}})(?![a-z0-9])")
_AS_DIGIT = str.maketrans("oilzsb", "011258")
_AS_LETTER = str.maketrans("0135689472", "oiesbbgatz")


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("№", "no").casefold()
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def read(text: str | None) -> dict | None:
    """An address's parts; None where it spells out no place (no number, or no name).

    Gives number, unit, postcode, region (two letters), `words` - the names in it, each with the
    part of the text it stands in and the signs of its role - and `plain_street`, `plain_locality`
    where the layout says which is which.
    """
    if not text:
        return None
    s = plain(text).replace("nº", "no ").replace("n°", "no ").replace("p.º", "paseo ").replace("p.o ", "paseo ")
    s = _COUNTRIES.sub(" ", _NOISE.sub(" ", s))
    s = re.sub(r"(?<=[a-z]{4})al\.", "allee", s)
    s = re.sub(r"(?<=[a-z])-(?=[a-z])", " ", s).replace("c/", "calle ")
    unit = postcode = region = ""
    if m := _UNIT.search(s):
        unit = (m[1] or m[2]).translate(_AS_DIGIT).lstrip("0")
        s = s[: m.start()] + " \x00 " + s[m.end() :]
    if m := _UK.search(s):
        postcode, region = m[1] + (m[2] + m[3]).translate(_AS_DIGIT) + m[4], m[1]
        s = s[: m.start()] + " \x01 " + s[m.end() :]
    elif found := list(_ZIP.finditer(s)):
        m = found[-1] if len(found) == 1 or not _NUMBER.search(s) else found[0]
        for x in found:  # of several, the one that follows or precedes a locality is told by its length alone
            if x[1].isdigit():
                m = x
                break
        postcode = m[1].translate(_AS_DIGIT)
        s = s[: m.start()] + " \x01 " + s[m.end() :]
    if not unit:
        numbers = len(_NUMBER.findall(s))
        if numbers > 1 and (m := _SLASH_UNIT.search(s)):
            unit = (m[1] or m[2]).lstrip("0")
            s = s[: m.start()] + " \x00 " + s[m.end() :]
    number = ""
    if m := _NUMBER.search(s):
        number = m[1].translate(_AS_DIGIT).lstrip("0")
        s = s[: m.start()] + " \x02 " + s[m.end() :]
        if not unit and (m := _NUMBER.search(s)):
            unit = m[1].translate(_AS_DIGIT).lstrip("0")
            s = s[: m.start()] + " \x00 " + s[m.end() :]
    else:
        for w, value in NUMBER_WORDS.items():
            if m := re.search(rf"(?<![a-z]){w}(?![a-z])", s):
                number, s = str(value), s[: m.start()] + " \x02 " + s[m.end() :]
                break
    words: list[dict] = []
    parts = re.split(r"[\n,;/]|\s[-–]\s", s)
    marks = []
    for at, part in enumerate(parts):
        tokens = re.findall(r"[a-z][a-z0-9]*|\d[a-z0-9]*[a-z][a-z0-9]*|[\x00\x01\x02]", part)
        sign = {"number": "\x02" in tokens, "type": False, "code": "\x01" in tokens, "local": False}
        names = []
        for i, token in enumerate(tokens):
            if token in "\x00\x01\x02":
                continue
            last = tokens[i - 1] if i else ""
            if token in _BEFORE and token not in _AFTER and not names or token in _AFTER and (token not in _LOCAL or names) and token not in ("la", "pl"):
                sign["type"] = True
                if names:
                    names[-1]["typed"] = True
                continue
            if token in _LOCAL or token in ("la", "pl") or len(token) == 1 or token in NUMBER_MARKS.split():
                sign["local"] |= token in _LOCAL and len(token) > 1
                sign["type"] |= token in ("la", "pl") and bool(names)
                continue
            if len(token) == 2:
                region = region or token
                continue
            word = token.translate(_AS_LETTER)
            ending = next((e for e in STREET_ENDINGS if word.endswith(e) and len(word) > len(e) + 3), None)
            if ending:
                sign["type"] = True
                word = word[: -len(ending)]
            if word.startswith("ober") and len(word) > 8:
                sign["local"], word = True, word[4:]
            if len(word) > 2:
                names.append({"word": word, "typed": bool(ending) or last in _BEFORE, "part": at})
        marks.append(sign)
        words.extend(names)
    if not number or not words:
        return None
    street = locality = ""
    here = [i for i, m in enumerate(marks) if m["number"] or m["type"]]
    streets = {p: [w["word"] for w in words if w["part"] == p] for p in here}
    named = [p for p in here if streets[p]]
    if len(named) == 1 and not marks[named[0]]["code"] and not marks[named[0]]["local"] and len(streets[named[0]]) <= 2:
        street = " ".join(streets[named[0]])
        rest = [w for w in words if w["part"] != named[0]]
        first = next((i for i in (w["part"] for w in rest) if marks[i]["code"] or marks[i]["local"]), rest[0]["part"] if rest else -1)
        locality = next((w["word"] for w in rest if w["part"] == first), "")
    return {"number": number, "unit": unit, "postcode": postcode, "region": region, "words": [w["word"] for w in words], "street": street, "locality": locality}


READ = "address_id string, number string, unit string, postcode string, region string, words array<string>, street string, locality string"


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["number", "unit", "postcode", "region", "words", "street", "locality"]
    for batch in batches:
        out = []
        for address_id, text in zip(batch["address_id"], batch["text"], strict=True):
            if r := read(text):
                out.append((address_id, *(r[n] for n in names)))
        yield pd.DataFrame(out, columns=["address_id", *names])


def _spelt(words: DataFrame) -> DataFrame:
    """`word, meant, edits`: what each word may stand for, itself first."""
    near = spelling.meant(words)
    return words.select("word", F.col("word").alias("meant"), F.lit(0).alias("edits"), F.col("n").alias("m")).unionByName(near.select("word", "meant", "edits", "m"))


def _best_spelling(options: DataFrame) -> DataFrame:
    return options.groupBy("word").agg(F.max_by("meant", F.struct(F.log(F.col("m") + 1) - 1.2 * F.col("edits"), F.col("meant"))).alias("best"))


def gazetteer(records: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Streets within localities - `entry, street, locality, n, postcodes, regions` - and the ways each is spelt.

    From the addresses whose layout tells street from locality. Words are put right by the
    spelling that comes more often, then the streets of one locality are clustered again.
    """
    best = cut(_best_spelling(options))
    plain = records.where("street <> '' and locality <> ''").select("postcode", "region", "locality", F.col("street").alias("raw"), F.split("street", " ").alias("_s"))
    put = lambda df, column: df.join(best.select(F.col("word").alias(column), F.col("best").alias(f"_{column}")), column, "left").withColumn(column, F.coalesce(f"_{column}", column)).drop(f"_{column}")
    plain = plain.select("postcode", "region", "locality", "raw", F.col("_s")[0].alias("first"), F.coalesce(F.get("_s", F.lit(1)), F.lit("")).alias("second"))
    plain = put(put(put(plain, "locality"), "first"), "second")
    plain = cut(plain.select("postcode", "region", "locality", "raw", F.trim(F.concat_ws(" ", "first", "second")).alias("street")))
    # A locality left out makes the next name look like one. Of the localities one street has with
    # one postcode the one named most often is meant; where that holds of most uses of a name as
    # a locality, it holds of all.
    here = plain.groupBy("street", "postcode", "locality").agg(F.count("*").alias("n"))
    votes = here.where("postcode <> ''").withColumn("to", F.max_by("locality", F.struct("n", "locality")).over(W.partitionBy("street", "postcode")))
    votes = votes.groupBy("locality", "to").agg(F.sum("n").alias("k"), F.count("*").alias("streets"))
    votes = votes.withColumn("all", F.sum("k").over(W.partitionBy("locality")))
    total = plain.groupBy("locality").agg(F.count("*").alias("t"))
    votes = votes.join(total, "locality").join(total.select(F.col("locality").alias("to"), F.col("t").alias("to_t")), "to")
    sent = votes.where("locality <> to and t < to_t and (k = all or streets > 1 and k * 10 >= all)").groupBy("locality").agg(F.max_by("to", F.struct("k", "to")).alias("to"))
    plain = plain.join(sent, "locality", "left").withColumn("locality", F.coalesce("to", "locality")).drop("to")
    streets = plain.groupBy("locality", F.col("street").alias("word")).agg(F.count("*").alias("n"))
    near = spelling.meant(streets, ["locality"], ties=True).groupBy("locality", "word").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))
    near = cut(near)
    further = near.select("locality", F.col("word").alias("meant"), F.col("meant").alias("_next"))
    near = near.join(further, ["locality", "meant"], "left").select("locality", "word", F.coalesce("_next", "meant").alias("meant"))
    put_right = plain.withColumnRenamed("street", "word").join(near, ["locality", "word"], "left").withColumn("street", F.coalesce("meant", "word"))
    put_right = cut(put_right)
    counted = lambda column: put_right.where(f"{column} <> ''").groupBy("locality", "street", column).agg(F.count("*").alias("k"))
    listed = lambda column: counted(column).groupBy("locality", "street").agg(F.reverse(F.array_sort(F.collect_list(F.struct("k", column)))).alias(f"{column}s"))
    entry = F.concat_ws("|", "street", "locality").alias("entry")
    spellings = put_right.select(entry, F.explode(F.array("street", "raw", "word")).alias("spelling")).distinct()
    entries = (
        put_right.groupBy("locality", "street").agg(F.count("*").alias("n"))
        .join(listed("postcode"), ["locality", "street"], "left").join(listed("region"), ["locality", "street"], "left")
        .select(entry, "street", "locality", "n", "postcodes", "regions")
    )
    return entries, spellings


BEAM = 6


def near(a: str, b: str) -> int:
    """Edits between two words, 3 where they are no spellings of one."""
    if a == b:
        return 0
    most = 1 if min(len(a), len(b)) < 6 else 2
    d = distance(a, b, most)
    return d if d <= most else 3


def search(record: dict, entries: list[dict]) -> str | None:
    """The entry a record's words spell best: a beam search that places the street, then the
    locality, then weighs postcode, region and the words left over. None where no entry fits."""
    words = list(record["words"])
    beam: list[tuple[float, int, tuple[int, ...]]] = []
    for k, e in enumerate(entries):
        street = e["street"].split()
        for at in range(len(words) - len(street) + 1):
            edits = [near(words[at + i], w) for i, w in enumerate(street)]
            if max(edits) < 3:
                used = tuple(range(at, at + len(street)))
                bonus = 1.0 if " ".join(words[i] for i in used) == record["street"] else 0.0
                beam.append((2.0 * len(street) - sum(edits) + bonus, k, used))
    beam = sorted(beam, key=lambda x: (-x[0], x[1]))[: BEAM * 8]
    placed = []
    for score, k, used in beam:
        e = entries[k]
        rest = [(near(w, e["locality"]), i) for i, w in enumerate(words) if i not in used]
        hit = min(rest, default=(3, -1))
        found = hit[0] < 3
        left = len(rest) - found
        score += (3.0 - hit[0] if found else 0.0) - 0.6 * left
        posts = {p["postcode"]: p["k"] for p in (e["postcodes"] if e["postcodes"] is not None else [])}
        post = record["postcode"]
        same = False
        if post and posts:
            if post in posts:
                same = posts[post] * 5 >= max(posts.values())
                score += 3.0 if same else 0.5
            elif any(len(p) == len(post) and sum(x != y for x, y in zip(p, post, strict=True)) == 1 for p in posts):
                score += 0.5
            else:
                score -= 2.5
        regions = {r["region"]: r["k"] for r in (e["regions"] if e["regions"] is not None else [])}
        agrees = bool(record["region"]) and regions.get(record["region"], 0) * 5 >= max(regions.values(), default=1)
        if record["region"] and regions:
            score += 0.7 if agrees else -0.7
        if found or same or agrees and not rest and not post:
            placed.append((score + 0.25 * min(e["n"], 20) ** 0.5, k))
    if not placed:
        return None
    placed.sort(key=lambda x: (-x[0], entries[x[1]]["entry"]))
    return entries[placed[0][1]]["entry"] if placed[0][0] >= 3.0 else None


def _search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            record = {"words": row.words, "street": row.street, "postcode": row.postcode, "region": row.region}
            found = search(record, list(row.entries)) if row.entries is not None else None
            if found is None:  # a street the gazetteer lacks: only the same words make the same place
                found = "?" + "|".join([row.street or " ".join(row.words), row.locality, row.postcode if not row.locality else ""])
            out.append((row.address_id, found, row.number, row.unit))
        yield pd.DataFrame(out, columns=["address_id", "entry", "number", "unit"])


def resolve(addresses: DataFrame) -> DataFrame:
    """`address_id, entry, number, unit` of every address that spells out a place.

    `addresses` has address_id (unique) and text. A null, an empty text, a filler or a text
    without a house number or a name has no row. Of equally good entries the first by name is taken.
    """
    records = cut(addresses.select("address_id", "text").mapInPandas(_read, READ))
    words = cut(records.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    options = cut(_spelt(words))
    streets, spellings = map(cut, gazetteer(records, options))
    # Keys by which an address and an entry meet: a spelling of the street with a spelling of the
    # locality, a postcode, or, where it has neither, a region.
    spans = records.select(
        "address_id", "postcode", "region", F.size("words").alias("names"),
        F.explode(F.concat(
            F.transform("words", lambda w, i: F.struct(w.alias("first"), F.lit("").alias("second"), i.alias("at"), F.lit(1).alias("len"))),
            F.when(F.size("words") > 1, F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.struct(w.alias("first"), F.get("words", i + 1).alias("second"), i.alias("at"), F.lit(2).alias("len"))))
            .otherwise(F.array().cast("array<struct<first:string,second:string,at:int,len:int>>")),
        )).alias("_s"),
    ).select("address_id", "postcode", "region", "names", "_s.*")
    spelt = lambda name: options.select(F.col("word").alias(name), F.col("meant").alias(f"to_{name}"))
    spans = spans.join(spelt("first"), "first").join(spelt("second"), "second", "left").withColumn("street", F.trim(F.concat_ws(" ", "to_first", "to_second")))
    spans = spans.join(spellings.select(F.col("spelling").alias("street")).distinct(), "street", "left_semi")
    # A span meets its address's other names by a join: each carrying all of them would square a long text.
    others = records.select("address_id", F.posexplode("words").alias("i", "word")).join(options.select("word", "meant"), "word").join(streets.select(F.col("locality").alias("meant")).distinct(), "meant", "left_semi")
    by_word = spans.select("address_id", "postcode", "region", "street", "at", "len").join(others, "address_id").where("i < at or i >= at + len").select("address_id", "postcode", "region", "street", F.concat(F.lit("l:"), "meant").alias("sign"))
    by_post = spans.where("postcode <> ''").select("address_id", "postcode", "region", "street", F.concat(F.lit("p:"), "postcode").alias("sign"))
    by_region = spans.where("region <> '' and postcode = '' and names = len").select("address_id", "postcode", "region", "street", F.concat(F.lit("r:"), "region").alias("sign"))
    signs = F.concat(
        F.array(F.concat(F.lit("l:"), "locality")),
        F.coalesce(F.transform("postcodes", lambda x: F.concat(F.lit("p:"), x["postcode"])), F.array().cast("array<string>")),
        F.coalesce(F.transform("regions", lambda x: F.concat(F.lit("r:"), x["region"])), F.array().cast("array<string>")),
    )
    keyed = streets.select("entry", F.explode(signs).alias("sign")).join(spellings.select("entry", F.col("spelling").alias("street")), "entry")
    proposed = by_word.unionByName(by_post).unionByName(by_region).join(keyed, ["street", "sign"]).select("address_id", "postcode", "region", "entry").distinct()
    # Of a street's postcodes the search weighs the record's own, those near it and the most frequent; of its regions the own and the most frequent.
    weighed = lambda column, near: F.filter(f"{column}s", lambda x: near(x[column]) | (x[column] == F.get(f"{column}s", F.lit(0))[column])).alias(f"{column}s")
    proposed = proposed.join(streets, "entry").select("address_id", "entry", "street", "locality", "n", weighed("postcode", lambda x: F.levenshtein(x, F.col("postcode")) <= 1), weighed("region", lambda x: x == F.col("region")))
    entries = proposed.groupBy("address_id").agg(F.collect_list(F.struct("entry", "street", "locality", "n", "postcodes", "regions")).alias("entries"))
    return records.join(entries, "address_id", "left").mapInPandas(_search, "address_id string, entry string, number string, unit string")


def same_location(addresses: DataFrame) -> DataFrame:
    """`address_a, address_b`: each pair of address records of one street, number and unit, the smaller id first."""
    found = cut(resolve(addresses))
    keys = ["entry", "number", "unit"]
    left = found.select(*keys, F.col("address_id").alias("address_a"))
    right = found.select(*keys, F.col("address_id").alias("address_b"))
    return left.join(right, keys).where("address_a < address_b").select("address_a", "address_b")
