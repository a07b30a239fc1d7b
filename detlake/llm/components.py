"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    """Node ``u`` -> smallest of itself and its partners ``v``, written once so that hot nodes can be split in the join."""
    return materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "lowest")


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links -> ``(node, component)`` with the smallest node of each component, for every linked node.

    Alternates two star operations (large and small) until no link changes; stars of any size are aggregates that
    combine before the shuffle, and the number of rounds grows with the logarithm of the longest chain. Links to itself and
    repeated links change nothing; an empty table gives an empty result.
    """
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large, "large")
        down = _lowest(large)
        small = large.join(down, "u").select("v", "low").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = materialize(small.unionByName(down.select("u", F.col("low").alias("v"))).distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign:
            break
        sign = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
