"""Connected components of a graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm._store import written


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): of pairs (a, b), the least node that each node is connected to.

    Alternates large-star and small-star steps, which keep components and end in stars around their least nodes
    after about log^2 n rounds; each round is a written table, so lineage does not grow."""
    edges = written(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: greater neighbours of a node go to the least of it and its neighbours
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star", edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node and its lesser neighbours go to the least of these
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "small-star", large)
        # a star forest is a fixed point: nothing is a centre and a leaf
        if new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            done = new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
            return written(done, "components", new)
        edges = new
