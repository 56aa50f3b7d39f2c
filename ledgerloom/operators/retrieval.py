"""Retrieval of catalogue entries: trigrams, vectors, and both fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP, FUSED_K = 5, 60


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))))
    return F.array_distinct(grams)


def catalogue(lines: DataFrame) -> DataFrame:
    """Descriptions carried by at least two documents, with the sku minted from the text.
    `lines` has doc and description."""
    return (
        lines.where("description is not null").groupBy("description").agg(F.countDistinct("doc").alias("documents")).where("documents >= 2")
        .select(F.concat(F.lit("SKU-"), F.substring(F.sha2("description", 256), 1, 8)).alias("sku"), "description", "documents")
    )


def trigram_arm(queries: DataFrame, entries: DataFrame, depth: int = TOP) -> DataFrame:
    """qid, sku, score, rank of the entries most similar to a query's text, by (score, sku).

    Only entries that share a trigram meet a query, on the trigram; the score of the others is 0
    and they are not listed.
    """
    grams = trigrams(F.col("text"))
    q = queries.select("qid", F.explode(grams).alias("gram"), F.size(grams).alias("qn"))
    e = entries.select("sku", F.explode(trigrams(F.col("description"))).alias("gram"), F.size(trigrams(F.col("description"))).alias("en"))
    shared = q.join(e, "gram").groupBy("qid", "sku").agg(F.count("*").alias("s"), F.any_value("qn").alias("qn"), F.any_value("en").alias("en"))
    scored = shared.select("qid", "sku", F.round(F.col("s") / (F.col("qn") + F.col("en") - F.col("s")), 6).alias("score"))
    return ranked(scored, depth)


def ranked(scored: DataFrame, depth: int) -> DataFrame:
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), "sku")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def vector_arm(queries: DataFrame, entries: DataFrame, depth: int = TOP) -> DataFrame:
    """qid, sku, score, rank by exact cosine; a stated query set against all entries, whose blocks
    are as many as `entries` has partitions. Both sides have an array `vector`; a null or a zero
    vector has no neighbours."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    side = lambda df, key: df.select(key, "vector", norm.alias("norm")).where("norm > 0")
    q = side(queries, "qid").withColumnsRenamed({"vector": "qv", "norm": "qn"})
    e = side(entries, "sku")
    dot = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    # Each block of queries meets each block of entries on the blocks' numbers.
    nq, ne = -(-queries.count() // 2_000) or 1, -(-entries.count() // 20_000) or 1
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("eb", blocks(ne))
    e = e.withColumn("eb", F.pmod(F.xxhash64("sku"), F.lit(ne)).cast("int")).withColumn("qb", blocks(nq))
    scored = e.join(q, ["qb", "eb"]).select("qid", "sku", F.round(dot / (F.col("qn") * F.col("norm")), 6).alias("score"))
    return ranked(scored, depth)


def fuse(*arms: DataFrame, depth: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of ranked arms, best first."""
    whole = arms[0].select("qid", "sku", "rank")
    for arm in arms[1:]:
        whole = whole.unionByName(arm.select("qid", "sku", "rank"))
    summed = whole.groupBy("qid", "sku").agg(F.round(F.sum(1 / (FUSED_K + F.col("rank"))), 9).alias("score"))
    return ranked(summed, depth)


def unlike(texts: DataFrame, entries: DataFrame, least: float = 0.95) -> DataFrame:
    """Texts (qid, text) to which no entry's description is as similar as `least`.

    Similar strings of longer length n differ in k <= n (1 - least) edits, so of k + 1 pieces of a
    description one stands in the text unchanged, shifted by k at most: they meet on the length,
    the piece and its place, and are then verified by bounded distance.
    """
    width = 1 - least
    most = lambda n: F.floor(n * width / least + 1e-9).cast("int")
    n = F.length("description")
    cuts = entries.select("description", n.alias("n"), most(n).alias("k")).where("n > 0").distinct()
    size = F.floor(F.col("n") / (F.col("k") + 1)).cast("int")
    piece = lambda i: F.struct(i.alias("i"), F.col("description").substr(i * size + 1, F.when(i == F.col("k"), F.col("n")).otherwise(size)).alias("piece"))
    pieces = cuts.select("description", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), piece)).alias("_p")).select("description", "n", "_p.*")
    own = F.length("text")
    bands = texts.where("length(text) > 0").select("qid", "text", F.explode(F.sequence(own - most(own), own + most(own))).alias("n")).withColumn("k", most(F.col("n")))
    placed = bands.select("qid", "text", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select("*", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("shift"))
    begin = F.col("i") * size + 1 + F.col("shift")
    length = F.when(F.col("i") == F.col("k"), F.col("n") - F.col("i") * size).otherwise(size)
    found = placed.where(begin >= 1).select("qid", "text", "n", "i", F.col("text").substr(begin, length).alias("piece")).join(pieces, ["n", "i", "piece"])
    longer = F.greatest(F.length("text"), F.length("description"))
    near = found.where(F.levenshtein("text", "description") <= longer * width + 1e-9).select("qid").distinct()
    return texts.join(near, "qid", "left_anti")
