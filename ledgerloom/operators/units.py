"""Quantities in their dimension's base unit.

Each line is read into a quantity and the units its text allows. Most texts allow one unit; a
few (`oz`, `mt`, `m`, `gr`, a quote mark) allow several. The unit is the hidden state of a Markov
chain per device - here the article, told by the letters of its description - over all of its
lines in time. Emissions are the prior of each meaning of the text, how often the device is counted
in its dimension, and a normal law of the log of the base amount around the device's level in that
dimension, which moves with time; transitions favour staying with a unit and its dimension. The
Viterbi path gives each line's unit, so a switch of unit shows as a jump of the log value against
the level and is anchored by the lines around it.

Scale: a chain none of whose lines has several meanings is decoded as it stands. The others are
range-partitioned by device and time, so that a device with a third of all lines is consecutive
blocks in many tasks. A block that cuts a device is summed up by the best score from each of its
first line's states to each of its last's; the summaries (two a block) are joined by the same
recursion and each block is decoded between the states so found. Scores are whole numbers, so the
path is the one of the whole chain however it is cut.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

# Size of a unit in its dimension's base unit (g, ml, mm, ea, min, wh) and its names.
UNITS: dict[str, tuple[str, str, str]] = {
    "mg": ("mass", "0.001", "mg milligram milligrams milligramm miligramo miligramos"),
    "g": ("mass", "1", "g gr grm grms gm gms gram grams gramm gramme gramo gramos"),
    "kg": ("mass", "1000", "kg kgs kilo kilos kilogram kilograms kilogramm kilogramme kilogramo kilogramos"),
    "t": ("mass", "1000000", "t mt ton tons tonne tonnes tonelada toneladas metric_ton metric_tons metric_tonne to"),
    "oz": ("mass", "28.349523125", "oz ozs ounce ounces onza onzas unze unzen"),
    "lb": ("mass", "453.59237", "lb lbs pound pounds libra libras pfd"),
    "short_ton": ("mass", "907184.74", "short_ton short_tons sh_tn sh_ton ton_(us) us_ton tons_(us)"),
    "long_ton": ("mass", "1016046.9088", "long_ton long_tons ton_(uk) uk_ton"),
    "ml": ("volume", "1", "ml mls millilitre milliliter millilitres milliliters mililitro mililitros cc ccm cm3"),
    "cl": ("volume", "10", "cl centilitre centiliter centilitro"),
    "dl": ("volume", "100", "dl decilitre deciliter"),
    "l": ("volume", "1000", "l lt ltr ltrs litre liter litres liters litro litros"),
    "hl": ("volume", "100000", "hl hectolitre hectoliter hektoliter hectolitro"),
    "m3": ("volume", "1000000", "m3 m³ cbm cu_m cubic_metre cubic_meter metro_cubico"),
    "fl_oz": ("volume", "29.5735295625", "fl_oz floz fluid_ounce fluid_ounces us_fl_oz"),
    "pt": ("volume", "473.176473", "pt pts pint pints pinta pintas"),
    "qt": ("volume", "946.352946", "qt qts quart quarts"),
    "gal": ("volume", "3785.411784", "gal gals gallon gallons galon galones galón us_gal us_gallon"),
    "mm": ("length", "1", "mm millimetre millimeter millimetres millimeters milimetro milimetros"),
    "cm": ("length", "10", "cm cms centimetre centimeter centimetres centimeters zentimeter centimetro centimetros"),
    "m": ("length", "1000", "m mtr mtrs metre meter metres meters metro metros lfm lin_m linear_m rm"),
    "km": ("length", "1000000", "km kms kilometre kilometer kilometres kilometers kilometro kilometros"),
    "in": ("length", "25.4", "in ins inch inches pulg pulgada pulgadas zoll \""),
    "ft": ("length", "304.8", "ft feet foot pie pies lf lin_ft linear_ft fuss fuß '"),
    "yd": ("length", "914.4", "yd yds yard yards yarda yardas"),
    "ea": ("count", "1", "ea each pc pcs pce piece pieces nos stk stck st stück stueck und unid unids uds ud unidad unidades pza pzas"),
    "pair": ("count", "2", "pr prs pair pairs par pares paar"),
    "dozen": ("count", "12", "dozen dozens doz dz dzn dtzd dutzend docena docenas"),
    "hundred": ("count", "100", "hundred hundert cen ciento"),
    "gross": ("count", "144", "gro gross gruesa"),
    "thousand": ("count", "1000", "thousand tsd mil tausend mille millar"),
    "s": ("time", "1/60", "s sec secs second seconds sek sekunde sekunden seg segundo segundos"),
    "min": ("time", "1", "min mins minute minutes minuten minuto minutos"),
    "h": ("time", "60", "h hr hrs hour hours std stunde stunden hora horas"),
    "wh": ("energy", "1", "wh w_h w-h watt_hour watt_hours wattstunden"),
    "kwh": ("energy", "1000", "kwh kw_h kw-h kilowatt_hour kilowatt_hours"),
    "mwh": ("energy", "1000000", "mwh mw_h mw-h megawatt_hour megawatt_hours"),
    "mj": ("energy", "2500/9", "mj megajoule megajoules"),
    "gj": ("energy", "2500000/9", "gj gigajoule gigajoules"),
}
# Texts with more than one meaning, and how often each is meant.
SEVERAL = {
    "oz": (("oz", 0.9), ("fl_oz", 0.1)),
    "mt": (("t", 0.9), ("m", 0.1)),
    "gr": (("g", 0.98), ("gross", 0.02)),
    "m": (("m", 0.98), ("thousand", 0.02)),
    "'": (("ft", 0.98), ("min", 0.02)),
    '"': (("in", 0.98), ("s", 0.02)),
}
DIMENSIONS = {name: dim for name, (dim, _, _) in UNITS.items()}
SIZES = {name: Fraction(size) for name, (_, size, _) in UNITS.items()}
NAMES = {alias.replace("_", " "): name for name, (_, _, aliases) in UNITS.items() for alias in aliases.split()}
VULGAR = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

_NUMBER = r"[-+−]?\s*\d[\d.,'   ’]*"
_SPLIT = re.compile(r"\s*(\(?\s*[-+−]?\s*[$€£]?\s*\d(?:[\d.,'’   ]*\d)?(?:\s*/\s*\d+)?(?:e[+]?\d{1,2}(?![a-z0-9]))?\s*[-−]?\s*\)?)\s*(.*?)\s*", re.I | re.S)
_CLOCK = re.compile(r"(\d+)\s*(?::|h|hrs?\.?|hours?|std\.?|horas?)\s*(\d{1,2})\s*(?:h|m|mins?\.?|minutes?|minuten|minutos)?", re.I)
_FEET = re.compile(r"(\d+)\s*(?:'|′|ft\.?|feet|foot|pies)\s*(\d+(?:[.,]\d+)?)\s*(?:\"|″|''|in\.?|inch|inches|pulg\.?)", re.I)
_POUNDS = re.compile(r"(\d+)\s*(?:lbs?\.?|pounds?|libras?)\s*,?\s*(\d+(?:[.,]\d+)?)\s*(?:ozs?\.?|ounces?|onzas?)", re.I)
# What a container holds, stated by the unit itself.
_HOLDS = [
    re.compile(r"(?:per|/|x|à|a|pk|pack of|pack à|pack|cs|bx|box of|case of|caja de|ctn|bag|can|drum|ibc|coil|roll|btl|sack|bottle|tin)?\s*/?\s*\(?\s*(\d+(?:[.,]\d+)?)\s*([^\d\s()/][^\d()/]*?)?\s*\)?\s*(?:/\s*)?(?:case|sack|bag|btl|bottle|can|drum|pcs?|pieces?|box|ctn|pack|pk|roll|coil)?", re.I),
    re.compile(r"(?:[a-zäöüß]+\.?)\s*(?:of|de|à|a|x|/)?\s*/?\s*\(?\s*(\d+(?:[.,]\d+)?)\s*([^\d\s()/][^\d()/]*?)?\s*\)?", re.I),
]
_PHRASE = re.compile(r"(?:\b(?:sold|billed|priced|charged|price)?\s*(?:by|per)\s+(?:the\s+)?|\bprice\s*/\s*)([a-z³3'\"() ._-]+?)\s*(?:[),;]|$|\s[-*/+(]|\s(?:see|net|lot|item)\b)", re.I)


def number(text: str) -> Fraction | None:
    """A printed amount. Of two kinds of separator the last is decimal; a lone comma before
    exactly three digits groups thousands; a lone dot is decimal; a repeated one groups."""
    s = text.strip().replace("−", "-").replace(" ", " ").replace(" ", " ").replace("’", "'")
    for mark, plain in VULGAR.items():
        s = s.replace(mark, f" {plain}")
    s = s.strip()
    sign = 1
    if s.startswith("(") and s.endswith(")"):
        sign, s = -1, s[1:-1].strip()
    if s.startswith("-") or s.endswith("-"):
        sign, s = -sign, s.strip("-").strip()
    s = s.lstrip("+$€£ ").strip()
    if m := re.fullmatch(r"(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)", s):
        if int(m[3]) == 0:
            return None
        return sign * (int(m[1] or 0) + Fraction(int(m[2]), int(m[3])))
    if re.fullmatch(r"\d+(?:\.\d+)?e\+?\d{1,2}", s, re.I):
        return sign * Fraction(s)
    if not re.fullmatch(r"\d[\d.,' ]*", s) or not s[-1].isdigit():
        return None
    if " " in s or "'" in s:
        if not re.fullmatch(r"\d{1,3}(?:[ ']\d{3})+(?:[.,]\d+)?", s):
            return None
        s = re.sub(r"[ ']", "", s)
        return sign * Fraction(s.replace(",", "."))
    dots, commas = s.count("."), s.count(",")
    if dots and commas:
        last = "." if s.rfind(".") > s.rfind(",") else ","
        other = "," if last == "." else "."
        s = s.replace(other, "")
        if s.count(last) > 1:
            return None
        s = s.replace(last, ".")
    elif commas > 1 or dots > 1:
        if not re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", s):
            return None
        s = re.sub(r"[.,]", "", s)
    elif commas:
        s = s.replace(",", "") if re.fullmatch(r"\d+,\d{3}", s) else s.replace(",", ".")
    try:
        return sign * Fraction(s)
    except ValueError:
        return None


@lru_cache(maxsize=20_000)
def meanings(text: str) -> tuple[tuple[str, Fraction, float], ...]:
    """(unit, how many of it, prior) for each meaning of a unit's text; none if it is no convertible unit."""
    s = re.sub(r"\s+", " ", text.strip().lower())
    for form in (s, s.rstrip("."), s.replace(".", ""), s.replace(".", " ").replace("  ", " ").strip()):
        if form in SEVERAL:
            return tuple((u, Fraction(1), p) for u, p in SEVERAL[form])
        if form in NAMES:
            return ((NAMES[form], Fraction(1), 1.0),)
    for pattern in () if s.isdigit() else _HOLDS:
        if m := pattern.fullmatch(s):
            many = number(m[1])
            held = (m[2] or "ea").strip()
            inner = meanings(held) if not re.search(r"\d", held) else ()
            if many and inner:
                unit, k, _ = inner[0]
                return ((unit, many * k, 1.0),)
    return ()


def stated(quantity: str | None, unit: str | None, description: str | None) -> tuple[Fraction, tuple] | None:
    """The line's amount and the meanings of its unit, looked for in the quantity, the unit, then the description."""
    if not quantity or not (q := quantity.strip()):
        return None
    if m := _POUNDS.fullmatch(q):
        return Fraction(m[1]) * 16 + Fraction(m[2].replace(",", ".")), (("oz", Fraction(1), 1.0),)
    if m := _FEET.fullmatch(q):
        return Fraction(m[1]) * 12 + Fraction(m[2].replace(",", ".")), (("in", Fraction(1), 1.0),)
    if (m := _CLOCK.fullmatch(q)) and int(m[2]) < 60:
        return Fraction(int(m[1]) * 60 + int(m[2])), (("min", Fraction(1), 1.0),)
    amount, rest = number(q), ""
    if amount is None:
        for mark, plain in VULGAR.items():
            q = q.replace(mark, f" {plain}")
        if not (m := _SPLIT.fullmatch(q.strip())):
            return None
        amount, rest = number(m[1]), m[2]
        if amount is None:
            return None
    if rest:
        found = meanings(rest)
        return (amount, found) if found else None
    if unit and (found := meanings(unit)):
        return amount, found
    if unit and re.search(r"\w", unit):  # a unit is given; it holds something not stated
        return None
    for m in _PHRASE.finditer(description or ""):
        if found := meanings(m[1]):
            return amount, found
    return None


def rounded(value: Fraction) -> int:
    return int(math.floor(value + Fraction(1, 2)))


READ = "line_id bigint, device string, words array<string>, at double, options array<struct<unit:string,dimension:string,base:bigint,prior:double>>"


@lru_cache(maxsize=100_000)
def skeleton(word: str) -> str:
    """A word's first letter and the consonants after it, none twice in a row: vowels are what typing and shortening lose first."""
    kept = word[0] + "".join(c for c in word[1:] if c not in "aeiouyäöüáéíóúàèìòùñ")
    return "".join(c for i, c in enumerate(kept) if not i or c != kept[i - 1])


def device_of(description: str | None) -> list[str]:
    """What tells a device: the skeletons of all its description's words of four letters or more, in order."""
    return sorted({skeleton(w) for w in re.findall(r"[^\W\d_]{4,}", (description or "").lower())})


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for line, q, u, d, at in zip(batch["line_id"], batch["quantity"], batch["unit"], batch["description"], batch["at"], strict=True):
            d = d or ""
            if not (found := stated(q, u, d)):
                continue
            amount, units = found
            options = [{"unit": n, "dimension": DIMENSIONS[n], "base": rounded(amount * k * SIZES[n]), "prior": p} for n, k, p in units]
            options = [o for o in options if abs(o["base"]) < 2**63]
            if options:
                words = device_of(d)
                out.append((line, " ".join(words) if words else f"#{line}", words, at, options))
        yield pd.DataFrame(out, columns=["line_id", "device", "words", "at", "options"])


#: Scores are logarithms in whole billionths: sums do not depend on the order they are made in.
UNIT_SCORE = 10**9


def whole(x: float) -> int:
    return round(x * UNIT_SCORE)


STAY, SAME_DIMENSION, SWITCH = whole(math.log(0.7)), whole(math.log(0.25)), whole(math.log(0.05))
#: Lines in one block of chains, about.
BLOCK = 200_000
# How far the log of a base amount strays from its level at least, and where no level is known.
LEAST_SPREAD, NO_SPREAD = 3.0, 4.0
#: Lines that what is known of a description's words counts for, beside the device's own.
WORD_LINES = 3.0
#: The level is taken from months around a line, each further one counting half.
MONTH, MONTHS = 30 * 86_400, 3

#: A state: unit, dimension, score of its emission.
Step = list[tuple[str, str, int]]


def moved(before: tuple[str, str, int], now: tuple[str, str, int]) -> int:
    return STAY if before[0] == now[0] else SAME_DIMENSION if before[1] == now[1] else SWITCH


def forward(steps: list[Step], entering: list[int | None]) -> tuple[list[int | None], list[list[int]]]:
    """Best scores of the last step's states and each step's pointers back, from scores of the first's (None: shut)."""
    scores, back = entering, []
    for before, now in zip(steps, steps[1:], strict=False):
        pointers, totals = [], []
        for state in now:
            best, at = None, 0
            for k, s in enumerate(scores):
                if s is not None and (best is None or s + moved(before[k], state) > best):
                    best, at = s + moved(before[k], state), k
            pointers.append(at)
            totals.append(None if best is None else best + state[2])
        scores = totals
        back.append(pointers)
    return scores, back


def _trace(back: list[list[int]], last: int) -> list[int]:
    path = [last]
    for pointers in reversed(back):
        path.append(pointers[path[-1]])
    return path[::-1]


def _best(scores: list[int | None]) -> int:
    return max((k for k, s in enumerate(scores) if s is not None), key=lambda k: (scores[k], -k))


def viterbi(steps: list[Step], first: int | None = None, last: int | None = None) -> list[int]:
    """The likeliest state of each step, with the first's and the last's given or free. A line of
    one meaning parts the chain: what comes before it and after it are decoded apart."""
    path: list[int] = []
    start = 0
    while start < len(steps):
        end = start + 1
        while end < len(steps) and len(steps[end]) > 1:
            end += 1
        # steps[start .. end - 1] and, if there is one, the single state that ends them
        part = steps[start : end + 1]
        entering = [s[2] if first is None or start or k == first else None for k, s in enumerate(part[0])]
        scores, back = forward(part, entering)
        if end < len(steps):
            found = _trace(back, 0)[:-1]
        else:
            found = _trace(back, last if last is not None else _best(scores))
        path += found
        start = end
    return path


def through(steps: list[Step]) -> list[list[int | None]]:
    """The best score from each state of the first step to each of the last."""
    cut_at = next((i for i, s in enumerate(steps) if i and len(s) == 1), None)
    own = lambda k: [s[2] if i == k else None for i, s in enumerate(steps[0])]
    if cut_at is None:
        return [forward(steps, own(k))[0] for k in range(len(steps[0]))]
    heads = [forward(steps[: cut_at + 1], own(k))[0][0] for k in range(len(steps[0]))]
    tail = forward(steps[cut_at:], [0])[0]
    return [[None if h is None or t is None else h + t for t in tail] for h in heads]


def emissions(line_id: int, options: list[dict], known: list[dict] | None, near: list[dict] | None, said: list[dict] | None) -> Step:
    """The states of a line of several meanings. `known`: how often the device is counted in each
    dimension; `near`: its level and spread there about that time; `said`: the share of each
    dimension among the lines with its description's words."""
    seen = {x["dimension"]: x["n"] for x in (known if known is not None else ())}
    level = {x["dimension"]: x for x in (near if near is not None else ())}
    words = {x["dimension"]: x["share"] for x in (said if said is not None else ())}
    total = sum(seen.values()) + (WORD_LINES if words else 0.0)
    step = []
    for k, o in enumerate(options):
        d = o["dimension"]
        own = seen.get(d, 0) + WORD_LINES * words.get(d, 0.0)
        e = math.log(o["prior"]) + math.log(own + 0.05 * total + 0.5)  # a dimension not seen yet is never ruled out
        x = level.get(d)
        if seen.get(d, 0) >= 3 and x is not None and o["base"]:
            spread = max(LEAST_SPREAD, math.sqrt(max(x["variance"], 0.0)))
            e -= ((math.log(abs(o["base"])) - x["level"]) / spread) ** 2 / 2 + math.log(spread)
        else:
            e -= 0.5 + math.log(NO_SPREAD)
        # Of meanings alike in all else the first listed is taken: later ones lose a trifle, by line, so that paths never tie.
        step.append((o["unit"], d, whole(e) - (k * (1 + zlib.crc32(str(line_id).encode()) % 100_003))))
    return step


def _chains(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, list[int], list[list[dict]], list[Step]]]:
    """A block's devices in order, each with its lines, their options and their states."""
    device, ids, options, steps = None, [], [], []
    for batch in batches:
        for d, line, o, known, near, said in zip(batch["device"], batch["line_id"], batch["options"], batch["known"], batch["near"], batch["said"], strict=True):
            if d != device:
                if ids:
                    yield device, ids, options, steps
                device, ids, options, steps = d, [], [], []
            ids.append(line)
            options.append(o)
            steps.append([(o[0]["unit"], o[0]["dimension"], 0)] if len(o) == 1 else emissions(line, o, known, near, said))
    if ids:
        yield device, ids, options, steps


SUMMARY = "block int, place int, device string, first string, last string, scores string"


def _summaries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the first and the last device of a block add to their chains."""
    block, ends = TaskContext.get().partitionId(), []
    for place, (device, _, _, steps) in enumerate(_chains(batches)):
        one = (block, place, device, steps)
        ends = [*ends[:1], one]
    rows = [(b, p, d, json.dumps(s[0]), json.dumps(s[-1]), json.dumps(through(s))) for b, p, d, s in ends]
    yield pd.DataFrame(rows, columns=["block", "place", "device", "first", "last", "scores"])


def joined(summaries: list[dict]) -> dict[tuple[int, str], tuple[int, int]]:
    """For each device cut by blocks, the states of its first and its last line in each block."""
    by_device: dict[str, list[dict]] = {}
    for s in sorted(summaries, key=lambda s: (s["block"], s["place"])):
        by_device.setdefault(s["device"], []).append(s)
    out: dict[tuple[int, str], tuple[int, int]] = {}
    for device, parts in by_device.items():
        if len(parts) < 2:
            continue
        firsts, lasts, scores = ([json.loads(p[c]) for p in parts] for c in ("first", "last", "scores"))
        # entering[k]: the best score before the block, its first line's state being k
        entering: list[int | None] = [0] * len(firsts[0])
        pointers = []
        for i in range(len(parts)):
            leaving, ways = [], []
            for j in range(len(lasts[i])):
                own = [None if e is None or scores[i][k][j] is None else e + scores[i][k][j] for k, e in enumerate(entering)]
                ways.append(_best(own))
                leaving.append(own[ways[-1]])
            pointers.append((ways, []))
            if i + 1 < len(parts):
                entering = []
                for state in firsts[i + 1]:
                    own = [None if s is None else s + moved(lasts[i][j], state) for j, s in enumerate(leaving)]
                    pointers[i][1].append(_best(own))
                    entering.append(own[pointers[i][1][-1]])
        last = _best(leaving)
        for i in reversed(range(len(parts))):
            first = pointers[i][0][last]
            out[parts[i]["block"], device] = first, last
            if i:
                last = pointers[i - 1][1][first]
    return out


def _decoding(between: object):  # noqa: ANN202
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, known = TaskContext.get().partitionId(), between.value
        rows = []
        for device, ids, options, steps in _chains(batches):
            first, last = known.get((block, device), (None, None))
            rows += [(i, o[k]["dimension"], o[k]["base"]) for i, o, k in zip(ids, options, viterbi(steps, first, last), strict=True)]
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["line_id", "dimension", "base_amount"])
                rows = []
        yield pd.DataFrame(rows, columns=["line_id", "dimension", "base_amount"])

    return run


def decode(chains: DataFrame, blocks: int | None = None) -> DataFrame:
    """`line_id, dimension, base_amount` of every line of `chains` (device, at, line_id, options,
    known, near, said), by the path of each device's whole chain, in as many blocks as needed."""
    spark = chains.sparkSession
    blocks = blocks or max(1, -(-chains.count() // BLOCK))
    placed = cut(chains.repartitionByRange(blocks, "device", "at", "line_id").sortWithinPartitions("device", "at", "line_id"))
    summaries = [r.asDict() for r in placed.mapInPandas(_summaries, SUMMARY).collect()] if blocks > 1 else []  # two rows a block
    return placed.mapInPandas(_decoding(spark.sparkContext.broadcast(joined(summaries))), "line_id bigint, dimension string, base_amount bigint")


def base_amounts(lines: DataFrame, base_units: DataFrame, blocks: int | None = None) -> DataFrame:
    """`line_id, base_unit, base_amount` of every line with a readable quantity of a convertible unit.

    `lines` has line_id, quantity, unit, description and `at` (seconds, the order of a device's
    lines; null comes first); other columns are not read. A line gives no row where its quantity is
    null, empty or unreadable, its unit is missing, unknown or a container of unstated content, or
    its dimension is not in `base_units`. Ties between meanings go to the one listed first; a line
    without words in its description is a device of its own. `blocks` only says how the chains are
    cut; the result is the same for any number.
    """
    read = lines.select("line_id", "quantity", "unit", "description", F.coalesce(F.col("at").cast("double"), F.lit(0.0)).alias("at")).mapInPandas(_read, READ)
    read = cut(read)  # read several times below
    one = read.where(F.size("options") == 1)
    several = read.where(F.size("options") > 1)
    devices = cut(several.select("device").distinct())
    anchors = one.join(devices, "device", "left_semi")
    first = F.col("options")[0]
    month = F.floor(F.col("at") / MONTH)
    # Counts, and sums of the log base amount, by device, dimension and month: as many rows as months, however many lines.
    x = F.log(F.abs(F.nullif(first["base"], F.lit(0))))
    monthly = cut(
        anchors.select("device", first["dimension"].alias("dimension"), month.alias("month"), x.alias("x"))
        .groupBy("device", "dimension", "month").agg(F.count("*").alias("n"), F.count("x").alias("k"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("q"))
    )
    known = monthly.groupBy("device", "dimension").agg(F.sum("n").alias("n")).groupBy("device").agg(F.array_sort(F.collect_list(F.struct("dimension", "n"))).alias("known"))
    # The level about a month: the months around it, each further one counting half, and all of them a little.
    shift = F.explode(F.sequence(F.lit(-MONTHS), F.lit(MONTHS))).alias("shift")
    weight = F.pow(F.lit(0.5), F.abs("shift"))
    wanted = several.select("device", month.alias("month")).distinct()
    around = monthly.select("device", "dimension", "k", "s", "q", "month", shift).select("device", "dimension", (F.col("month") + F.col("shift")).alias("month"), *[(F.col(c) * weight).alias(c) for c in "ksq"])
    always = monthly.groupBy("device", "dimension").agg(*[(F.sum(c) * 0.01).alias(c) for c in "ksq"]).join(wanted, "device").select("device", "dimension", "month", "k", "s", "q")
    levels = (
        around.join(wanted, ["device", "month"], "left_semi").select("device", "dimension", "month", "k", "s", "q").unionByName(always)
        .groupBy("device", "dimension", "month").agg(*[F.sum(c).alias(c) for c in "ksq"]).where("k > 0")
        .select("device", "month", F.struct("dimension", (F.col("s") / F.col("k")).alias("level"), (F.col("q") / F.col("k") - F.pow(F.col("s") / F.col("k"), F.lit(2))).alias("variance")).alias("_l"))
        .groupBy("device", "month").agg(F.array_sort(F.collect_list("_l")).alias("near"))
    )
    # Shares of the dimensions among all lines with a word, averaged over a line's words: for devices seldom seen.
    words = several.select("line_id", F.explode("words").alias("word"))
    shares = one.select(F.explode("words").alias("word"), first["dimension"].alias("dimension")).groupBy("word", "dimension").agg(F.count("*").alias("n"))
    shares = cut(shares.join(words.select("word").distinct(), "word", "left_semi"))
    totals = shares.groupBy("word").agg(F.sum("n").alias("t"))
    counted = words.join(totals, "word").groupBy("line_id").agg(F.count("*").alias("words"))
    said = (
        words.join(shares.join(totals, "word"), "word").groupBy("line_id", "dimension").agg(F.sum(F.col("n") / F.col("t")).alias("p")).join(counted, "line_id")
        .groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("dimension", (F.col("p") / F.col("words")).alias("share")))).alias("said"))
    )
    asked = (
        several.withColumn("month", month).join(known, "device", "left").join(levels, ["device", "month"], "left").join(said, "line_id", "left")
        .select("device", "at", "line_id", "options", "known", "near", "said")
    )
    none = lambda column: F.lit(None).cast(asked.schema[column].dataType).alias(column)
    chains = asked.unionByName(anchors.select("device", "at", "line_id", "options", none("known"), none("near"), none("said")))
    decoded = decode(chains, blocks)
    alone = one.join(devices, "device", "left_anti").select("line_id", first["dimension"].alias("dimension"), first["base"].alias("base_amount"))
    return alone.unionByName(decoded).join(base_units.select("dimension", "base_unit"), "dimension").select("line_id", "base_unit", "base_amount")
