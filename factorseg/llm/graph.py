"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node (combined before its shuffle) and one join back; the join's result is
shuffled again by edge, so adaptive execution can split a hot node. Edges of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factorseg.operators.lineage import drop_written, lean, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) that is not its component's smallest node.

    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    current, path = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                            .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
                            .distinct())
    state = _state(current)
    while state[0]:
        ends = current.select(F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")),
                                                F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))).alias("e")).select("e.u", "e.v")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (ends.join(least, "u").filter("v > u and v > m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                                 F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        small = large.join(lowest, "hi").select(pair.alias("e")).select("e.hi", "e.lo").filter("hi > lo").distinct()
        following, new_path = written(small)
        new_state = _state(following)
        drop_written(spark, path)
        current, path = following, new_path
        if new_state == state:
            break
        state = new_state
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(edges: DataFrame) -> tuple:
    with lean(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
