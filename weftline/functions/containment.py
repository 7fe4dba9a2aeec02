"""Which texts contain which terms: a join by the rarest piece of each term instead of a comparison of all with all."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; shorter terms are looked up among the pieces of their own length.
PIECE = 4
#: Wanted pieces are broadcast up to this number.
BROADCAST_PIECES = 1_000_000


def _pieces(c: Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters; none of a shorter text."""
    starts = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, n)))


def containing(texts: DataFrame, terms: DataFrame, by: tuple[str, ...] = (), text: str = "text", term: str = "term") -> DataFrame:
    """(by, text, term): distinct pairs of a text and a term that it contains, where both agree in the columns ``by``.

    Every term is looked up by that piece of it which the fewest texts have; the texts of that piece are then compared with the
    whole term. Texts move as hashes until then. Empty terms and nulls match nothing.
    """
    keys = list(by)
    x = texts.select(*keys, F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_id", F.xxhash64("_text"))
    t = terms.select(*keys, F.col(term).alias("_term")).where("_term <> ''").distinct()
    found = []
    lengths = [r.n for r in t.select(F.least(F.length("_term"), F.lit(PIECE)).alias("n")).distinct().collect()]  # four at most
    for n in sorted(lengths):
        mine = t.where(F.length("_term") == n if n < PIECE else F.length("_term") >= PIECE)
        wanted = mine.select(*keys, "_term", F.explode(_pieces(F.col("_term"), n)).alias("_piece"))
        known = wanted.select(*keys, "_piece").distinct()
        known = F.broadcast(known) if known.count() <= BROADCAST_PIECES else known
        posts = x.select(*keys, "_id", F.explode(_pieces(F.col("_text"), n)).alias("_piece")).join(known, [*keys, "_piece"], "left_semi")
        often = posts.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
        # A term with a piece that no text has is in none.
        counted = wanted.join(often, [*keys, "_piece"], "left").groupBy(*keys, "_term").agg(F.count_if(F.col("_n").isNull()).alias("_lost"), F.min_by("_piece", F.struct("_n", "_piece")).alias("_piece"))
        found.append(counted.where("_lost = 0").select(*keys, "_term", "_piece").join(posts, [*keys, "_piece"]).select(*keys, "_id", "_term").distinct())
    if not found:
        return x.select(*keys, F.col("_text").alias(text), F.lit("").alias(term)).where("false")
    pairs = functools.reduce(DataFrame.unionByName, found)
    return pairs.join(x, [*keys, "_id"]).where(F.col("_text").contains(F.col("_term"))).select(*keys, F.col("_text").alias(text), F.col("_term").alias(term))
