"""Freely keyed descriptions mapped to the entries of a reference list.

The words of the reference entries, and the other names their articles go by, hang in BK-trees
under the Levenshtein distance, which is a true metric, so the triangle inequality prunes a search
without losing a word within its threshold; a swap of two letters then counts as one edit. A
description's words are looked up there; the entries whose words they stand for are weighed by the edits spent, the words
left over and the size, which must be equal once it is in the entry's own unit. The best entry of
each shard of the reference list meets those of the others; a description that no entry fits is
`unmatched`.

What an entry costs does not depend on its shard: which words the whole list knows and which
finishes an article has anywhere in it are worked out once, over the whole list.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

UNMATCHED = "unmatched"
#: Entries in one shard: what a worker holds of the reference list at a time.
SHARD = 50_000
#: A description costs this much at most: see `weigh`.
MOST_COST = 2.6

# Other names and translations of articles; `match` takes others in their place.
NAMES = {
    "garden hose": "gartenschlauch|manguera jardin|manguera|water hose|hose pipe",
    "washing soda": "waschsoda|sosa para lavar|sodium carbonate",
    "gasket set": "dichtungssatz|juego juntas|gasket kit|seal kit|joint kit",
    "aa battery": "aa batterie|batterie aa|batterie mignon|mignon batterie|mignon cell|aa cell|pila aa|pila",
    "orange juice": "orangensaft|jugo naranja|oj",
    "paint brush": "malerpinsel|pinsel|brocha",
    "air filter": "luftfilter|filtro aire|intake filter|air element|intake element",
    "tile grout": "fugenmortel|lechada|joint filler tiles|joint filler",
    "copper pipe": "kupferrohr|tubo cobre|cu tube|copper tube|cu pipe",
    "ballpoint pen": "kugelschreiber|boligrafo|biro",
    "saw blade": "sageblatt|hoja sierra|circular blade|circular cutting disc|cutting blade",
    "bin liner": "mullbeutel|bolsa basura|refuse sack|refuse bag",
    "glass cleaner": "glasreiniger|limpiacristales|window spray|window cleaner",
    "portland cement": "portlandzement|zement|cemento|cement powder|portland cemento",
    "flood light": "strahler|spotlight|reflector",
    "drinking cup": "trinkbecher|vaso desechable|vaso|disposable beaker|beaker",
    "conduit": "leerrohr|tubo corrugado|corrugado|cable duct|duct",
    "hand soap": "handseife|jabon manos|hand wash",
    "angle bracket": "winkelverbinder|escuadra|corner brace",
    "nylon rope": "nylonseil|soga nilon|soga|polyamide rope",
    "paper towel": "kuchenrolle|toalla papel|kitchen roll",
    "long grain rice": "langkornreis|arroz grano largo|arroz largo|long kernel rice|rice long kernel|rice",
    "hinge": "scharnier|bisagra|butt hinge|butt",
    "sunflower oil": "sonnenblumenol|aceite girasol|cooking oil",
    "led lamp": "led leuchte|ledlampe|bombillo led|light emitting diode bulb|light emitting diode|led bulb",
    "coffee beans": "kaffeebohnen|cafe en grano|cafe grano|whole bean coffee",
    "wood glue": "holzleim|cola madera|carpenter adhesive|wood adhesive",
    "nitrile glove": "nitrilhandschuh|guante nitrilo|disposable glove",
    "cane sugar": "rohrzucker|azucar cana|sucrose cane|sucrose",
    "lawn fertiliser": "rasendunger|abono cesped|abono para cesped|grass feed|lawn fertilizer|lawn feed",
    "ball valve": "kugelhahn|llave bola|quarter turn valve",
    "drive belt": "antriebsriemen|correa transmision|transmission belt",
    "plywood sheet": "sperrholzplatte|plancha plywood|plywood board|ply board|plancha",
    "construction timber": "bauholz|madera obra|building lumber|construction lumber",
    "sanding disc": "schleifscheibe|disco lija|abrasive pad|abrasive disc",
    "bread flour": "brotmehl|harina pan|baker flour",
    "structural steel beam": "stahltrager|viga acero|steel girder|steel section|girder section|girder",
    "power cable": "stromkabel|cable electrico|cable corriente|mains cable|mains lead",
    "metered electricity": "stromverbrauch|consumo electrico|consumo corriente|consumo electricidad|power consumption|electric consumption|mains consumption|consumo",
    "forklift hire": "staplermiete|alquiler montacargas|lift truck rental|fork lift rental",
    "carriage bolt": "schlossschraube|perno carruaje|perno coche|coach bolt|cup square bolt|perno cabeza|perno",
    "hex bolt": "sechskantschraube|perno hexagonal|hexagon bolt|hexagon head bolt",
    "copy paper": "kopierpapier|papel bond|printer paper",
    "wall paint": "wandfarbe|pintura pared|interior emulsion|emulsion",
    "on site labour": "arbeitszeit vor ort|mano obra|man hours on site|man hours|on site labor",
    "data entry work": "datenerfassung|digitacion|keying service",
    "engine oil": "motorol|aceite motor|motor lubricant|engine lubricant",
    "envelope": "briefumschlag|sobre|mailing envelope|mailing pouch|mailing",
    "freight and delivery charge": "frachtkosten lieferung|cargo por flete y entrega|cargo flete entrega|freight delivery|freight|flete|shipping freight charge|transport delivery freight|delivery fee freight|carriage delivery charge|delivery charge",
}
# Short forms that are no part of their word in order, and other words for a finish.
SHORT = {
    "stainless steel": "ss st|ss stl|s s stl|s s st|s s|ss|inox|stnls stl",
    "white": "wt|blanco|weiss", "waterproof": "w proof", "rechargeable": "nimh|nimh rechargeable", "with operator": "w operator",
    "outdoor": "od", "labour": "labor", "aluminium": "aluminum|alu", "fertiliser": "fertilizer", "galvanised": "galvanized",
}
# What stands beside an article's name.
NOISE = [
    r"^\s*(?:item|pos|art)\.? ?\d+ ?:", r"^\s*po ?\d+", r"^\s*[a-z]\d{2,4}-\d{2}\b", r"\blot ?\d+", r"\(?\b(?:sold )?(?:by|per) the (?:dozen|pair|pound|litre|liter|foot|kg|metre|minute|hour|gallon)\b\)?",
    r"\b(?:sold|price|billed|priced)? ?per (?:thousand|gallon|litre|liter|kg|gram|metre|meter|cm|mwh|kwh|hour|quote|attached|our agreement|delivery note|minute|pound)\b", r"\bprice ?/ ?[a-z]+", r"\(sold by the \w+\)", r"\bcut to cm\b",
    r"\((?:backorder|see below)\)", r"\bref\.? (?:as )?above\b", r"\bas above\b", r"\*+ ?promo\b", r"\bo\.n\.o\.?", r"\*\*?",
]
NOISE_WORDS = set("net new promo the de del por y and of en la el para a an for ref item sold per by price x pcs pc".split())
_NOISE = re.compile("|".join(NOISE))
_SHORT = {re.sub(r"[ ./]+", "", short): full for full, shorts in SHORT.items() for short in shorts.split("|")}
_SHORTS = re.compile("(?<![a-z0-9])(?:" + "|".join("[ ./]*".join(map(re.escape, short.split())) for short in sorted((x for v in SHORT.values() for x in v.split("|")), key=len, reverse=True)) + r")\.?(?![a-z0-9])")
_N = r"(\d+(?:[.,]\d+)?)"
# The ways a size of each kind is written.
SIZES = {
    "bolt": [r"\bm ?(\d+)\s*(?:x|by|\*|-|/| )\s*(\d+)(?: ?mm)?\b"],
    "oil": [r"\b(\d+) ?w ?[-/ ]? ?(\d+)\b"],
    "paper": [r"\ba ?(\d) ?-?(\d{2,3}) ?-?(?:gsm|g)\b", r"\ba ?(\d)[ -]+(\d{2,3})\b"],
    "ipe": [r"\bipe ?-? ?(\d+)\b"],
    "mm2": [rf"\b{_N} ?-?(?:mm2|mm²|sqmm|qmm)(?![a-z0-9])"],
    "pack": [r"\b(?:pack|packs|pk|paq|pkt|packung|paquete)\.? ?(?:of|/|de|à|a)? ?(\d+)\b", r"\b(\d+) ?-?(?:er)? ?/? ?(?:pcs|pc|stk)? ?-?/?(?:pack|pk|paq|packung)\b", r"\b(\d+) ?er[ -]pack", r"(?<![a-z0-9])x ?(\d+)\b", r"\b(\d+) ?(?:pcs|pc)\b"],
    "mm": [rf"\b{_N} ?-? ?(mm|cm)(?![a-z0-9])", rf"\b{_N} ?-? ?(m)\b"],
    "kg": [rf"\b{_N} ?-? ?(kgs?|kilos?|kilogramm?s?|gramos|grams?|gr|g)(?![a-z0-9])"],
    "ml": [rf"\b{_N} ?-? ?(ml|cl|dl|lt|ltrs?|litres?|liters?|litros?|l)(?![a-z0-9])"],
    "w": [rf"\b{_N} ?-? ?(?:w|watts?)\b"],
    "no": [r"(?:\b(?:no|nr|n|nº|n°|size|num|nbr|gr(?:o|ö)sse|talla)\b[.:º° ]*|#) ?(\d+)\b", r"\bn[º°.] ?(\d+)\b"],
    "grade": [r"\b(?:grade|grd|gr|qual|quality|gute|calidad|kl)\b[. ]*([a-z])\b"],
    "class": [r"\b(?:class|cls|cl|klasse|clase)\b[. ]*(\d+)\b"],
    "tariff": [r"\b(?:tariff|tarif|tariffa|trf|tar|tarifa)\b[. ]*([a-z])\b"],
    "rate": [r"\b(?:rate|rt|r|tarif|satz)\b[. ]*(\d+)\b", r"\br(\d+)\b"],
    "tier": [r"\b(?:tier|lvl|level|stufe|nivel|t)\b[. ]*(\d+)\b", r"\bt(\d+)\b"],
    "grit": [r"\b(?:grit|gr|grano|kornung|p|k)\b[. ]*(\d+)\b", r"\b[pk](\d+)\b", r"\bgrit(\d+)\b"],
    "sheet": [r"\b([abc])[ -]?(\d)\b"],
}
_SIZES = {k: [re.compile(p) for p in v] for k, v in SIZES.items()}
# Sizes whose marks are also words of articles are not taken out of a text before its words are read.
_MARKED = {"no", "pack", "grit", "grade", "rate", "class", "tariff", "tier"}
_BARE = re.compile("|".join(re.sub(r"(?<!\\)\((?!\?)", "(?:", p) for k, v in SIZES.items() if k not in _MARKED for p in v))
_MARKS = set("pack packs pk paq no nr n num nbr size grade grd gr qual quality gute class cls cl tariff tarif trf tar rate rt r tier lvl level t grit p k mm cm kg kgs kilo g l ml ltr litre w watt watts er ipe gsm x from with on off up high low".split())
_SCALE = {"mm": ("mm", 1), "cm": ("mm", 10), "m": ("mm", 1000), "ml": ("ml", 1), "cl": ("ml", 10), "dl": ("ml", 100), "l": ("ml", 1000), "lt": ("ml", 1000), "ltr": ("ml", 1000), "g": ("kg", Fraction(1, 1000)), "gr": ("kg", Fraction(1, 1000)), "kg": ("kg", 1)}


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: a metric."""
    seen: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            same = a[i - 1] == b[j - 1]
            if same:
                last = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def masks(word: str) -> dict[str, int]:
    """Where each letter stands in a word, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << i
    return out


def levenshtein(at: dict[str, int], n: int, other: str) -> int:
    """Levenshtein distance of a word, given by its masks and length, from another: a column of
    the table at a time, as bits that tell where it rises and falls."""
    if not n:
        return len(other)
    full, top = (1 << n) - 1, 1 << n - 1
    rises, falls, d = full, 0, n
    for c in other:
        same = at.get(c, 0)
        x = same | falls
        down = ((same & rises) + rises ^ rises) | same
        up, flat = falls | ~(down | rises) & full, down & rises
        d += bool(up & top) - bool(flat & top)
        up, flat = (up << 1 | 1) & full, flat << 1 & full
        rises, falls = flat | ~(x | up) & full, up & x
    return d


class BKTree:
    """Words by their distance from a parent; a search visits only children the triangle inequality leaves open."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root: tuple[str, dict] | None = None
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = word, {}
            return
        at = self.root
        known = masks(word)
        while d := levenshtein(known, len(word), at[0]):
            if d not in at[1]:
                at[1][d] = word, {}
                return
            at = at[1][d]

    def within(self, word: str, most: int) -> list[tuple[int, str]]:
        """Every word at most so far away, with its distance."""
        found, open_ = [], [self.root] if self.root else []
        at = masks(word)
        while open_:
            known, children = open_.pop()
            d = levenshtein(at, len(word), known)
            if d <= most:
                found.append((d, known))
            open_ += [child for k, child in children.items() if d - most <= k <= d + most]
        return sorted(found)


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("²", "2").casefold().replace("ß", "ss")
    return re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))).strip()


def _number(text: str) -> Fraction:
    return Fraction(text.replace(",", "."))


def sizes(text: str, kind: str) -> list[tuple]:
    """Each size of a kind in a text, in the kind's own unit."""
    found = []
    for pattern in _SIZES[kind]:
        for m in pattern.finditer(text):
            if kind in ("bolt", "oil", "paper", "sheet"):
                found.append(m.groups())
            elif kind in ("mm", "kg", "ml"):
                unit = m[2]
                unit = "kg" if unit.startswith("k") else "g" if unit.startswith("g") else "ltr" if unit.startswith("li") or unit.startswith("ltr") else unit
                found.append((_number(m[1]) * _SCALE[unit][1],))
            elif kind in ("mm2", "w"):
                found.append((_number(m[1]),))
            elif kind in ("grade", "tariff"):
                found.append((m[1],))
            else:
                found.append((str(int(m[1])),))
    return found


def _abbreviates(short: str, word: str) -> bool:
    """Whether a text is the word with letters left out: its start, or its consonants and more."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    if word.startswith(short):
        return True
    shared = next(i for i, (a, b) in enumerate(zip(short, word + " ", strict=False)) if a != b)
    rest = iter(word[shared:])
    return not set(short[shared:]) & set("aeiou") and all(c in rest for c in short[shared:]) and len(short) <= 0.75 * len(word) + 0.5


_LETTERS = str.maketrans("0135689", "olessbg")


_STOP = {"and", "of", "y", "por", "en", "de", "para"}
_KINDS = ("bolt", "oil", "paper", "ipe", "mm2", "pack", "ml", "kg", "mm", "w", "no", "grade", "class", "tariff", "rate", "tier", "grit", "sheet")


def entry(sku: str, description: str, names: dict[str, str]) -> dict:
    """An entry's article (a name known, else its last two words), finish and size."""
    text = plain(description)
    kind, size, stem = "", (), text
    for k in _KINDS:
        hits = [m for p in _SIZES[k] for m in p.finditer(text) if m.end() == len(text)]
        if hits:
            kind, size, stem = k, sizes(text, k)[-1], text[: hits[0].start()].strip()
            break
    words = stem.split()
    noun = next((n for i in range(len(words)) if (n := " ".join(words[i:])) in names), "") or " ".join(words[-2:])
    return {"sku": sku, "kind": kind, "size": size, "noun": noun, "finish": stem[: len(stem) - len(noun)].split()}


def phrases_of(noun: str, names: dict[str, str]) -> list[list[str]]:
    return [p.split() for p in [noun, *filter(None, names.get(noun, "").split("|"))]]


def words_of(e: dict, names: dict[str, str]) -> set[str]:
    """The words of the list that an entry brings: its article's, under all names, and its finish's."""
    return ({w for p in phrases_of(e["noun"], names) for w in p} | set(e["finish"])) - _STOP


class Shard:
    """Part of the reference list, ready to be searched.

    `known` are the words of the whole list and `finishes` those of each article anywhere in it;
    without them the part is the whole.
    """

    def __init__(self, entries: list[tuple[str, str]], names: dict[str, str] | None = None, known: set[str] | None = None, finishes: dict[str, set[str]] | None = None) -> None:
        names = NAMES if names is None else names
        self.entries = [entry(sku, description, names) for sku, description in sorted(entries)]
        self.by_noun: dict[str, list[dict]] = {}
        for e in self.entries:
            self.by_noun.setdefault(e["noun"], []).append(e)
        self.phrases = phrases = {noun: phrases_of(noun, names) for noun in self.by_noun}
        self.words = sorted({w for e in self.entries for w in words_of(e, names)})
        self.own = sorted({w for noun in phrases for w in noun.split()} | {w for e in self.entries for w in e["finish"]} - {"and", "of"})
        self.tree = BKTree(self.words)
        if finishes is None:
            finishes = {}
            for e in self.entries:
                finishes.setdefault(e["noun"], set()).update(e["finish"])
        self.finishes = finishes
        self.known = set(self.words) if known is None else known
        self.using: dict[str, set[str]] = {}
        for noun, ps in phrases.items():
            for p in ps:
                for w in p:
                    self.using.setdefault(w, set()).add(noun)
        self.read = lru_cache(maxsize=100_000)(self._read)
        self.means = lru_cache(maxsize=200_000)(self._means)

    def _means(self, token: str) -> dict[str, float]:
        """Words of the list a token may stand for, with what that costs."""
        out: dict[str, float] = {}
        word = token.rstrip(".")
        if any(c.isdigit() for c in word):
            word = word.translate(_LETTERS)
        for form, cost in ((word, 0.0), (word.replace("cl", "d").replace("rn", "m").replace("vv", "w"), 0.3), (word[:-1] if word.endswith("s") and len(word) > 3 else word, 0.0), (word[:-2] if word.endswith("es") and len(word) > 4 else word, 0.1)):
            if form in self.known:
                out[form] = min(out.get(form, 9), cost)
        most = 0 if len(word) < 3 else 1 if len(word) < 6 else 2
        if most:
            for d, known in self.tree.within(word, 2):
                d = d if d < 2 else distance(word, known)  # a swap is one edit
                if 0 < d <= most and (len(known) > 3 or d == 1 and len(known) == 3 and len(word) > 3):
                    out[known] = min(out.get(known, 9), 0.55 * d + (0.3 if known[0] != word[0] else 0))
        if word not in out:
            for known in self.own:
                if known not in out and _abbreviates(word, known):
                    out[known] = 0.45
        return out

    def _place(self, phrase: list[str], tokens: list[str], free: set[int]) -> tuple[float, list[int]] | None:
        """The cheapest way to find a phrase's words among the free tokens."""
        cost, used = 0.0, []
        for w in phrase:
            if w in _STOP:
                continue
            best = min(((self.means(tokens[i])[w], i) for i in free if i not in used and w in self.means(tokens[i])), default=None)
            if best is None:
                # One token may hold two words written as one.
                return None
            cost += best[0]
            used.append(best[1])
        return cost, used

    def search(self, text: str) -> tuple[float, str]:
        """(cost, sku) of the entry that fits a text best; infinite where none does."""
        return self.read(re.sub(r"\s+", " ", _NOISE.sub(" ", plain(text))).strip())

    def _read(self, s: str) -> tuple[float, str]:
        bare = _SHORTS.sub(lambda m: f" {_SHORT[re.sub(r'[ ./]+', '', m[0])]} ", _BARE.sub(" ", s))
        tokens = [t for t in re.findall(r"[a-z][a-z0-9]*\.?", bare) if t.rstrip(".") not in NOISE_WORDS]
        nouns = {n for t in tokens for w in self.means(t) for n in self.using.get(w, ())}
        best = (float("inf"), UNMATCHED)
        for noun in sorted(nouns):
            for phrase in self.phrases[noun]:
                placed = self._place(phrase, tokens, set(range(len(tokens))))
                if placed is None:
                    continue
                cost, used = placed
                free = set(range(len(tokens))) - set(used)
                if cost <= best[0]:
                    fitting = self._fitting(noun, s)
                    best = min([best, *(self._weigh(e, cost, free, tokens, noun) for e in fitting)])
        return best if best[0] <= MOST_COST else (float("inf"), UNMATCHED)

    def _fitting(self, noun: str, s: str) -> list[dict]:
        """The noun's entries whose size is in the text."""
        read: dict[str, list[tuple]] = {}
        out = []
        for e in self.by_noun[noun]:
            if e["kind"]:
                if e["kind"] not in read:
                    read[e["kind"]] = sizes(s, e["kind"])
                if e["size"] not in read[e["kind"]]:
                    continue
            out.append(e)
        return out

    def _weigh(self, e: dict, cost: float, free: set[int], tokens: list[str], noun: str) -> tuple[float, str]:
        free = set(free)
        hit = 0
        wanted = [w for w in e["finish"] if w not in ("and", "of", "from", "with")]
        for w in wanted:
            best = min(((self.means(tokens[i])[w], i) for i in free if w in self.means(tokens[i])), default=None)
            if best:
                cost, hit = cost + best[0], hit + 1
                free.discard(best[1])
        if wanted and hit < len(wanted):
            cost += 0.9 if hit == 0 else 0.7 * (len(wanted) - hit)
        other = self.finishes[noun].difference(e["finish"])
        for i in free:
            token = tokens[i].rstrip(".")
            if token not in _MARKS and len(token) > 1 and not any(c.isdigit() for c in token):
                cost += 3 if any(w in other for w in self.means(tokens[i])) else 0.9
        return round(cost, 4), e["sku"]


_built: dict[int, Shard] = {}


def _search(shared: object):  # noqa: ANN202
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A shard and what it has looked up are kept by a worker from one task to the next.
        key, part, names, known, finishes = shared.value
        if key not in _built:
            while len(_built) > 1:
                _built.pop(next(iter(_built)))
            _built[key] = Shard(part, names, known, finishes)
        index = _built[key]
        for batch in batches:
            found = [index.search(t) for t in batch["text"]]
            yield pd.DataFrame({"line_id": batch["line_id"], "cost": [c for c, _ in found], "sku": [sku for _, sku in found]})

    return run


def _lexicon(listed: DataFrame, names: dict[str, str]) -> DataFrame:
    """Each entry with its article, finish and words: `sku, description, shard, noun, finish, words`."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [entry(sku, d, names) for sku, d in zip(batch["sku"], batch["description"], strict=True)]
            yield batch.assign(noun=[e["noun"] for e in read], finish=[e["finish"] for e in read], words=[sorted(words_of(e, names)) for e in read])

    return listed.mapInPandas(run, "sku string, description string, shard bigint, noun string, finish array<string>, words array<string>")


_keys = itertools.count(1)


def match(lines: DataFrame, entries: DataFrame, names: dict[str, str] | None = None, shards: int | None = None) -> DataFrame:
    """`line_id, sku` of each described line: the sku of the entry meant, or `unmatched`.

    `lines` has line_id and text; a line whose text is null or holds no letter or digit has no
    row. `entries` has sku and description; rows with a null in either are no entries, and with no
    entries every line is unmatched. Of entries that fit equally well the first sku is taken.
    `names` gives the other names of articles, parted by bars (NAMES unless given); every worker
    holds them. An article without any is known by its own words.

    Lines are searched where they are read, without a shuffle; a worker keeps what it has looked
    up, so texts that a third of all lines share are searched once a worker. The reference list is
    read in shards of bounded size, each sent to the workers on its own, with the words of the
    whole list (its vocabulary) and the finishes of the shard's articles anywhere in it; with more
    than one, a line's best of each shard are compared. `shards` only says how the list is cut;
    the result is the same for any number.
    """
    spark = lines.sparkSession
    names = NAMES if names is None else names
    listed = entries.where("sku is not null and description is not null").select("sku", "description").distinct()
    lines = lines.select("line_id", "text").where(F.col("line_id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    shards = shards or max(1, -(-listed.count() // SHARD))
    if shards == 1:
        part = [tuple(r) for r in listed.orderBy("sku", "description").collect()]
        shared = spark.sparkContext.broadcast((f"{os.getpid()}/{next(_keys)}", part, names, None, None))
        return lines.mapInPandas(_search(shared), "line_id bigint, cost double, sku string").select("line_id", "sku")
    lines = cut(lines)
    lexicon = cut(_lexicon(listed.withColumn("shard", F.pmod(F.xxhash64("sku"), F.lit(shards))), names))
    known = {r["word"] for r in lexicon.select(F.explode("words").alias("word")).distinct().collect()}
    whole = None
    for k in range(shards):
        own = lexicon.where(F.col("shard") == k)
        part = [tuple(r) for r in own.select("sku", "description").orderBy("sku", "description").collect()]
        finishes = lexicon.join(own.select("noun").distinct(), "noun", "left_semi").select("noun", F.explode_outer("finish").alias("word")).groupBy("noun").agg(F.collect_set("word").alias("words"))
        shared = spark.sparkContext.broadcast((f"{os.getpid()}/{next(_keys)}", part, names, known, {r["noun"]: set(r["words"]) for r in finishes.collect()}))
        found = lines.mapInPandas(_search(shared), "line_id bigint, cost double, sku string")
        whole = found if whole is None else whole.unionByName(found)
    return whole.groupBy("line_id").agg(F.min_by("sku", F.struct("cost", "sku")).alias("sku"))
