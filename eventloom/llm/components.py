"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """The component of every node that has an edge: columns node, component (its smallest node).

    edges has columns a and b (long); self loops and repeated edges do no harm. Large
    star: each node hands its larger neighbours its smallest one; small star: each node
    links its smaller neighbours to the smallest. Both are one aggregate and one join on
    the node, so a centre with very many neighbours costs partial minima and a join
    whose large side adaptive execution splits. Every round is written to the shared
    folder; rounds grow with the logarithm of the largest component. No edge passes
    through the driver, which compares a count and a checksum.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = written(large, tag)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        small = written(small.select("e.*").filter("a <> b").distinct(), tag)
        dropped(now, large)
        now, before = small, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
