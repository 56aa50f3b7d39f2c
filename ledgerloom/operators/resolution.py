"""Query sets with noise, arms scored kind by kind, floors and thresholds.

Everything drawn is drawn by hashes of a seed and a key, so any number of workers draw the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import normalize
from ledgerloom.operators.retrieval import FUSED_K, TOP

# Kinds of noise and their shares, bands of likeness with theirs, marks, units, the guard, and how many more rows an arm fetches than it answers.
KIND_SHARES = {"extra words": 0.350, "letters substituted": 0.245, "digits dropped": 0.212, "punctuation": 0.192}
KINDS = ("exact", *KIND_SHARES)
BANDS = (("[0.9, 1.0)", 0.9, 1.0, 0.362), ("[0.8, 0.9)", 0.8, 0.9, 0.095), ("[0.7, 0.8)", 0.7, 0.8, 0.126), ("[0.5, 0.7)", 0.5, 0.7, 0.095), ("below 0.5", 0.0, 0.5, 0.322))
MARKS, UNITS = "-.:/,", "pcs ea box kg m mm ml l pk ct set roll".split()
OUT_SHARE, FETCH, VARIANTS, DEVELOPMENT_ONE_IN = 0.150, 25, 2, 5
OPERATING_THRESHOLD = 1 / (FUSED_K + 1) + 1 / (FUSED_K + 2)


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the seed and the parts."""
    h = F.xxhash64(F.lit(seed), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pick(n: Column, x: Column) -> Column:
    return F.least(F.floor(x * n), n - 1).cast("int")


def letters_substituted(text: Column, seed: int) -> Column:
    """One letter of a text (two in a tenth of cases) replaced by another; unchanged without a letter."""

    def one(s: Column, part: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.lower(s.substr(i, F.lit(1))).rlike("[a-z]"))
        at = F.get(places, _pick(F.size(places), draw(seed, part, s)))
        old = F.lower(s.substr(at, F.lit(1)))
        new = F.substring(F.regexp_replace(F.lit("abcdefghijklmnopqrstuvwxyz"), old, F.lit("")), 1, 25)
        return F.when(F.size(places) > 0, F.overlay(s, new.substr(_pick(F.lit(25), draw(seed, part + "!", s)) + 1, F.lit(1)), at, F.lit(1))).otherwise(s)

    once = one(text, "a")
    return F.when(draw(seed, "two", text) < 0.1, one(once, "b")).otherwise(once)


def digit_drops(text: Column) -> Column:
    """The texts with one of the longest digit-bearing words left out, then with all of them; empty where no plain word would stay."""
    words = F.split(text, " ")
    bearing = F.filter(words, lambda w: w.rlike("[0-9]"))
    longest = F.array_max(F.transform(bearing, lambda w: F.length(w)))
    ones = F.array_distinct(F.transform(F.filter(bearing, lambda w: F.length(w) == longest), lambda d: F.array_join(F.filter(words, lambda w: w != d), " ")))
    every = F.array_join(F.filter(words, lambda w: ~w.rlike("[0-9]")), " ")
    return F.when((F.size(bearing) > 0) & (every != ""), F.concat(ones, F.array(every))).otherwise(F.array().cast("array<string>"))


def digits_dropped(text: Column, seed: int) -> Column:
    """A drop drawn from `digit_drops`: in half the cases all digit-bearing words; unchanged where none can be."""
    drops = digit_drops(text)
    one = F.get(drops, _pick(F.size(drops) - 1, draw(seed, "drop", text)))
    return F.when(F.size(drops) == 0, text).when(draw(seed, "all", text) < 0.5, F.element_at(drops, -1)).otherwise(one)


def punctuation(text: Column, seed: int) -> Column:
    """A mark added after a word, or one of the text's marks dropped or swapped."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: text.substr(i, F.lit(1)).rlike(r"[!-/:-@\[-`{-~]"))
    way = F.when(F.size(places) == 0, F.lit(0.0)).otherwise(draw(seed, "way", text))
    mark = F.lit(MARKS).substr(_pick(F.lit(len(MARKS)), draw(seed, "mark", text)) + 1, F.lit(1))
    words = F.split(text, " ")
    at = _pick(F.size(words), draw(seed, "word", text))
    added = F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.concat(w, mark)).otherwise(w)), " ")
    spot = F.get(places, _pick(F.size(places), draw(seed, "spot", text)))
    moved = lambda by: F.concat(text.substr(F.lit(1), spot - 1), by, text.substr(spot + 1, F.length(text)))
    return F.when(way < 1 / 3, added).when(way < 2 / 3, moved(F.lit(""))).otherwise(moved(mark))


def extra_words(text: Column, seed: int, fragment: Column | None = None) -> Column:
    """Four to seven numbers, prices and units behind a text, or, half the time where there is one, a fragment of another before or behind it."""
    count = F.lit(4) + _pick(F.lit(4), draw(seed, "count", text))

    def piece(i: Column) -> Column:
        kind, x = draw(seed, "kind", text, i), draw(seed, "piece", text, i)
        unit = F.get(F.array(*map(F.lit, UNITS)), _pick(F.lit(len(UNITS)), x))
        return F.when(kind < 1 / 3, F.floor(1 + x * 999).cast("string")).when(kind < 2 / 3, F.format_number(0.5 + x * 4999.5, 2)).otherwise(unit)

    numeric = F.concat_ws(" ", text, F.array_join(F.transform(F.sequence(F.lit(1), count), piece), " "))
    if fragment is None:
        return numeric
    before = draw(seed, "before", text) < 0.5
    return F.when(fragment.isNull() | (draw(seed, "bleed", text) < 0.5), numeric).when(before, F.concat_ws(" ", fragment, text)).otherwise(F.concat_ws(" ", text, fragment))


def kind_of(text: Column, key: Column, seed: int) -> Column:
    """The kind of noise a variant draws, by the shares; without digits to drop or letters to replace another kind."""
    takes_digits, takes_letters = F.size(digit_drops(text)) > 0, F.lower(text).rlike("[a-z]")
    rest = {k: s for k, s in KIND_SHARES.items() if k != "digits dropped"}
    whole = sum(rest.values())
    x, upto = draw(seed, "rest", key), 0.0
    out = F.lit("punctuation")
    for k, s in reversed([(k, s) for k, s in rest.items() if k != "punctuation"]):
        upto = sum(v for n, v in list(rest.items())[: list(rest).index(k) + 1]) / whole
        out = F.when((x < upto) & (takes_letters if k == "letters substituted" else F.lit(True)), F.lit(k)).otherwise(out)
    return F.when(takes_digits & (draw(seed, "digits", key) < KIND_SHARES["digits dropped"]), F.lit("digits dropped")).otherwise(out)


def query_set(entries: DataFrame, seed: int) -> DataFrame:
    """`qid, text, sku, kind, slice`: each entry's description as it is and two noisy variants, an
    entry in five in the development slice. A variant that is an entry's own description is left
    out, as no right answer would be its alone. `entries` has sku and description."""
    dev = F.when(draw(seed, "slice", F.col("sku")) < 1 / DEVELOPMENT_ONE_IN, "development").otherwise("scored").alias("slice")
    base = entries.select("sku", F.col("description").alias("own"), dev)
    exact = base.select(F.concat("sku", F.lit("/0")).alias("qid"), F.col("own").alias("text"), "sku", F.lit("exact").alias("kind"), "slice")
    drawn = base.withColumn("_v", F.explode(F.sequence(F.lit(1), F.lit(VARIANTS)))).withColumn("qid", F.concat_ws("/", "sku", F.col("_v").cast("string")))
    kinded = drawn.withColumn("kind", kind_of(F.col("own"), F.col("qid"), seed))
    keyed = F.col("own")
    made = F.when(F.col("kind") == "letters substituted", letters_substituted(keyed, seed)).when(F.col("kind") == "digits dropped", digits_dropped(keyed, seed)).when(F.col("kind") == "punctuation", punctuation(keyed, seed)).otherwise(extra_words(keyed, seed))
    noisy = kinded.select("qid", normalize.text(made).alias("text"), "sku", "kind", "slice").join(entries.select(normalize.text(F.col("description")).alias("text")), "text", "left_anti")
    return exact.unionByName(noisy.select("qid", "text", "sku", "kind", "slice"))


def kind_shares(queries: DataFrame) -> DataFrame:
    """`kind, n, share, target` of the noisy queries; every kind has a row."""
    noisy = queries.where("kind <> 'exact'")
    every = queries.sparkSession.createDataFrame(list(KIND_SHARES.items()), "kind string, target double")
    per = every.join(noisy.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), "target")
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # four rows
    return per.select("kind", "n", F.round(F.col("n") / F.nullif(total, F.lit(0)), 6).alias("share"), "target")


def band_shares(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """`band, n, target`: noisy queries by how alike they are to their entry's description."""
    alike = queries.where("kind <> 'exact'").join(entries.select("sku", "description"), "sku").select(normalize.similarity(F.col("text"), normalize.text(F.col("description"))).alias("s"))
    band = F.coalesce(*[F.when((F.col("s") >= low) & (F.col("s") < high), F.lit(name)) for name, low, high, _ in BANDS])
    every = queries.sparkSession.createDataFrame([(b[0], b[3]) for b in BANDS], "band string, target double")
    return every.join(alike.groupBy(band.alias("band")).agg(F.count("*").alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), "target")


def by_kind(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """`kind, n, top1, top5`: queries whose right entry came first, or among five. Kinds without
    queries keep a row of zeros. `queries` has qid, sku, kind; `answers` qid, sku, rank."""
    hit = answers.where(F.col("rank") <= TOP).select("qid", "sku", "rank")
    met = queries.where("sku is not null").join(hit, ["qid", "sku"], "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.count("rank").alias("top5"))
    every = queries.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return every.join(met, "kind", "left").select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "top1", "top5")])


def over_fetch(ranked: DataFrame, cut: int = TOP, fetch: int = FETCH) -> DataFrame:
    """`qid, outcome, tied`: whether the score at the fetched boundary equals the one at the cut (so a
    tie may go on unseen), differs, or fewer rows came than were asked; and whether the first two tie.
    `ranked` has qid, rank, score, fetched to `fetch` ranks."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    per = ranked.where(F.col("rank") <= fetch).groupBy("qid").agg(F.count("*").alias("n"), at(cut).alias("c"), at(fetch).alias("f"), at(1).alias("a"), at(2).alias("b"))
    return per.select("qid", F.when(F.col("n") < fetch, "short").when(F.col("c") == F.col("f"), "equal").otherwise("distinct").alias("outcome"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("tied"))


def worst_fetch(outcomes: DataFrame) -> DataFrame:
    """`qid, outcome` of a query over several halves: short before equal before distinct."""
    rank = F.when(F.col("outcome") == "short", 0).when(F.col("outcome") == "equal", 1).otherwise(2)
    return outcomes.groupBy("qid").agg(F.min_by("outcome", rank).alias("outcome"))


def at_threshold(answers: DataFrame) -> DataFrame:
    """`qid, sku, score` of each query's first answer, its sku only at the operating threshold or above."""
    return answers.where("rank = 1").select("qid", F.when(F.col("score") >= OPERATING_THRESHOLD - 1e-9, F.col("sku")).alias("sku"), "score")


def floor(lines: DataFrame, pairs: int, seed: int, most: float = 0.01) -> DataFrame:
    """`pairs, floor`: the lowest step of a tenth that at most `most` of a drawn number of pairs of
    unrelated descriptions reach. `lines` has doc and text: line i of an order drawn by hash meets
    line i of another, and pairs of one document are left out; null without pairs."""
    ranked = lambda salt, doc, text: lines.where("text is not null").select(F.col("doc").alias(doc), normalize.text(F.col("text")).alias(text), F.xxhash64(F.lit(seed), F.lit(salt), "doc", "text").alias("_h")).orderBy("_h", doc, text).limit(pairs).withColumn("_i", F.row_number().over(W.orderBy("_h", doc, text)))
    met = ranked("a", "a", "x").drop("_h").join(ranked("b", "b", "y").drop("_h"), "_i").where("a <> b").select(normalize.similarity(F.col("x"), F.col("y")).alias("s"))
    steps = [F.count_if(F.col("s") >= k / 10).alias(f"_{k}") for k in range(1, 11)]
    one = met.agg(F.count("*").alias("pairs"), *steps)
    lowest = F.coalesce(*[F.when(F.col(f"_{k}") <= most * F.col("pairs"), F.lit(k / 10)) for k in range(1, 11)])
    return one.select("pairs", F.when(F.col("pairs") > 0, lowest).alias("floor"))


def cycle(pool: DataFrame, count: int, seed: int) -> DataFrame:
    """`draw` (from 0) and the key drawn: the pool in an order drawn by hash, round and round, a fresh order each round. `pool` has key."""
    n = pool.count()
    rounds = -(-count // n) if n else 0
    if not rounds:
        return pool.select(F.lit(0).cast("long").alias("draw"), "key").where("false")
    every = pool.select("key", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    place = F.row_number().over(W.partitionBy("round").orderBy(F.xxhash64(F.lit(seed), "round", "key"), "key")) - 1
    return every.withColumn("draw", (F.col("round") * n + place).cast("long")).where(F.col("draw") < count).select("draw", "key")
