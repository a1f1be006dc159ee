"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: each node of an edge with the least node of its component.

    Every round costs a few shuffles of the edges and writes them once; rounds grow with the
    logarithm of the longest path. Minima are pre-aggregated and joins can be split, so a node
    with very many neighbours is no single task's load. Nothing but three numbers a round reaches the driver.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = stored(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are stored, so that the joins below deal both sides anew and may split a hub's rows
        low = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("low", "a").alias("low")), "minima")
        large = both.where("b > a").join(low, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        forget(low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "of"), "minima")
        small = large.join(low, F.col("a") == F.col("of")).select("a", "b", "low")
        small = small.select("a", F.col("low").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
        small = stored(small, "small-star")
        for done in (low, large, e):
            forget(done)
        e, before, state = small, state, _state(small)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
