"""Connected components by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.scratch import discard, stored


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link: root is the smallest node reachable from it.

    A large star hangs the larger neighbours of a node on its smallest neighbour, a small star does so with
    the smaller ones; the number of rounds grows with the logarithm of the longest chain. Each round holds at
    most one row a link. Links with a null end and links of a node to itself say nothing and are left out; no links,
    no rows. A node may have any number of neighbours: minima are combined before the shuffle, and joins on
    a hot node are left to the adaptive skew join.
    """
    pairs = stored(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct(),
        "links",
    )
    seen = _digest(pairs)
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(smallest, "u").select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        ).distinct()
        large = stored(large, "large-star")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(lowest, "hi").where(F.col("lo") != F.col("m")).select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")
        )
        after = stored(hung.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        discard(large)
        discard(pairs)
        pairs, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    roots = pairs.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")))


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")),
                           F.sum(F.xxhash64("hi", "lo").bitwiseAND(0x3FFFFFFF))).first())
