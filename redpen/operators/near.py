"""Pairs of different texts within a small edit distance, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 2
_LEFT, _RIGHT = "\ue001", "\ue002"  # end marks


def _grams(c: Column) -> Column:
    """(gram, pos) of a text between two end marks: one more than it has characters."""
    marked = F.concat(F.lit(_LEFT), c, F.lit(_RIGHT))
    return F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.struct(F.substring(marked, i, F.lit(Q)).alias("gram"), i.alias("pos")))


def _shorter(c: Column) -> Column:
    """All texts with one character less."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))


def candidates(texts: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """(a, b): pairs of different texts that may be within the distance, each once, the shorter (else the lesser) first.

    An edit touches at most Q grams, so of the distance * Q + 1 rarest grams of a text at least one stands in a near text, among its
    own rarest, at most `distance` places away. Texts with too few grams for that are joined on what is left of them after
    deleting up to `distance` characters. Joins are on (gram, length), so lengths that differ too much never meet."""
    few = Q * distance
    have = texts.select(F.col(column).alias("t")).filter("t is not null").distinct().withColumn("len", F.length("t"))
    grams = have.select("t", "len", F.explode(_grams(F.col("t"))).alias("g")).select("t", "len", "g.*")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    rare = grams.filter(F.col("len") >= few).join(often, "gram").groupBy("t", "len").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))), 1, few + 1).alias("g"))
    keyed = rare.select("t", "len", F.explode("g").alias("g")).select("t", "len", F.col("g.gram").alias("key"), "g.pos")
    left = keyed.select(F.col("t").alias("a"), F.col("pos").alias("a_pos"), "key", F.explode(F.sequence("len", F.col("len") + distance)).alias("len"), F.col("len").alias("a_len"))
    right = keyed.select(F.col("t").alias("b"), F.col("pos").alias("b_pos"), "key", "len")
    found = left.join(right, ["key", "len"]).filter((F.abs(F.col("a_pos") - F.col("b_pos")) <= distance) & ((F.col("a_len") < F.col("len")) | (F.col("a") < F.col("b")))).select("a", "b")

    rests = F.array(F.col("t"))
    level = rests
    for _ in range(distance):
        level = F.flatten(F.transform(level, _shorter))
        rests = F.array_union(rests, level)
    short = have.filter(F.col("len") < few + distance).select("t", "len", F.explode(rests).alias("key"))
    a, b = short.filter(F.col("len") < few).select(F.col("t").alias("a"), F.col("len").alias("a_len"), "key"), short.select(F.col("t").alias("b"), "len", "key")
    brief = a.join(b, "key").filter((F.col("a_len") < F.col("len")) | ((F.col("a_len") == F.col("len")) & (F.col("a") < F.col("b")))).select("a", "b")
    return found.unionByName(brief).distinct()


def near_pairs(texts: DataFrame, column: str, distance: int = 2) -> DataFrame:
    """(a, b, distance): every pair of different texts within the edit distance. Null texts have no pairs, repeated ones count once."""
    close = F.levenshtein("a", "b", distance)
    return candidates(texts, column, distance).withColumn("distance", close).filter(F.col("distance") >= 0)
