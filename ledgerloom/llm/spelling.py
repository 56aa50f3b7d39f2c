"""Misspelt words and the words they stand for: a prefix-filtered set-similarity join on q-grams.

Two words within d edits share at least g - 2 d of their g distinct padded bigrams. With all bigrams
ordered from rare to frequent they therefore share SHARED of them among the first 2 d + SHARED of
each, wherever g - 2 d is that much (it is in any word without repeated bigrams); words are joined on
those threes, which are so many that a key stays short however many words there are. The few words
with too many repeated bigrams are joined on one shared bigram among the first 2 d + 1.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

MOST_EDITS = 2
SHARED = 3
_PREFIX = 2 * MOST_EDITS + SHARED


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between two words, or most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, now = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > most:
            return most + 1
        before, row = last, now
    return min(row[-1], most + 1)


def edits_allowed(word: Column) -> Column:
    n = F.length(word)
    return F.when(n < 4, 0).when(n < 6, 1).otherwise(2)


def _grams(word: Column) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: padded.substr(i, F.lit(2))))


def _threes(prefix: Column, many: int) -> Column:
    """Keys for each three of the first `many` bigrams of a prefix."""
    ways = [F.when(F.size(prefix) > k, F.xxhash64(F.get(prefix, F.lit(i)), F.get(prefix, F.lit(j)), F.get(prefix, F.lit(k)))) for i, j, k in itertools.combinations(range(many), SHARED)]
    return F.array_compact(F.array(*ways))


def _ones(prefix: Column, many: int) -> Column:
    return F.transform(F.slice(prefix, 1, many), lambda g: F.xxhash64(g))


def meant(words: DataFrame, keys: list[str] | None = None, most_share: float = 0.1, weak: int = 2, ties: bool = False) -> DataFrame:
    """`word, meant, edits`: for seldom words, the more frequent words within the edits allowed.

    `words` has word and n (how many records carry it), one row a word, and the keys within which
    words are compared, if any. A word is taken for a misspelling only of one that comes more
    often: at least 1 / most_share times, or any more where it comes at most `weak` times itself.
    With `ties`, of two that come equally seldom the first by name is taken to be meant.
    Null and empty words have no row.
    """
    keys = keys or []
    words = words.where("length(word) > 0").select(*keys, "word", "n")
    listed = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    frequency = listed.groupBy("gram").agg(F.count("*").alias("df"))
    # One row a word: how many bigrams it has, and the rarest of them in order.
    prefixes = listed.join(frequency, "gram").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("_g"))
    prefixed = cut(words.join(prefixes.select("word", F.size("_g").alias("g"), F.transform(F.slice("_g", 1, _PREFIX), lambda x: x["gram"]).alias("prefix")), "word"))
    # Words that come more than this can't be a misspelling of any.
    top = words.agg(F.max("n")).first()[0] or 0
    most = edits_allowed(F.col("word"))
    seldom = prefixed.where((F.col("n") <= max(weak, int(most_share * top))) & (most > 0)).withColumn("most", most)
    thin = F.col("g") - 2 * F.col("most") < SHARED
    seldom = seldom.select(
        *keys, "word", "n", "most",
        F.explode(
            F.when(thin, _ones(F.col("prefix"), 2 * MOST_EDITS + 1)).when(F.col("most") == 1, _threes(F.col("prefix"), 2 + SHARED)).otherwise(_threes(F.col("prefix"), _PREFIX))
        ).alias("sign"),
    )
    strong = prefixed.where(f"n >= {1 if ties else 2}").select(
        *keys, F.col("word").alias("meant"), F.col("n").alias("m"), F.explode(F.concat(_threes(F.col("prefix"), _PREFIX), _ones(F.col("prefix"), 2 * MOST_EDITS + 1))).alias("sign")
    )
    more = F.col("m") > F.col("n")
    if ties:
        more |= (F.col("m") == F.col("n")) & (F.col("meant") < F.col("word"))
    near = seldom.join(strong, [*keys, "sign"]).where(
        more & ((F.col("n") <= weak) | (F.col("n") <= most_share * F.col("m"))) & (F.abs(F.length("word") - F.length("meant")) <= F.col("most"))
    )
    edits = F.levenshtein("word", "meant", 2)
    return (
        near.withColumn("edits", edits)
        .where((F.col("edits") >= 0) & (F.col("edits") <= F.col("most")))
        .groupBy(*keys, "word", "meant")
        .agg(F.min("edits").alias("edits"), F.max("m").alias("m"))
    )
