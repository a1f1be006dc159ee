"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each document of the shuffled source gets a virtual finish time: the source's words up
to and with it, divided by the source's target. All documents, repeats included, are
ordered by it and cut off at the total budget. The global order is a range sort by radix:
a running total comes from a tree of sums over ranges of the order's key, and only rows of
one leaf are sorted with each other, so no source and no range of the order is ever one
task. Ranks and targets of the sources, however many there are, come from the same totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, quoted, stored, text_of

#: Positions of an order are whole numbers below 2 ** BITS, a tree's node has 2 ** FAN parts.
BITS, FAN = 60, 9
#: A leaf of the tree is made to hold about this many rows.
LEAF_ROWS = 512


def shuffled_position(ident: Column) -> Column:
    """A reproducible random position: the first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def running_total(df: DataFrame, group: str, position: str, value: str, order: list[str], out: str, rows: int) -> DataFrame:
    """df with the running total of value within group, in the order of position, then order.

    rows is the largest group's row count; it sets only the depth of the tree. Positions
    are expected to be spread; if they aren't, leaves grow, and the totals stay right.
    """
    depth = 0
    while rows > LEAF_ROWS and (rows >> (FAN * depth)) > LEAF_ROWS and FAN * (depth + 1) <= BITS:
        depth += 1
    if not depth:
        here = Window.partitionBy(group).orderBy(position, *order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(here))
    leaf = F.shiftright(F.col(position), BITS - FAN * depth)
    sums = stored(df.groupBy(group, leaf.alias("leaf_")).agg(F.sum(value).alias("sum_")), "leaf-sums")
    before = None
    for level in range(1, depth + 1):
        node = F.shiftright(F.col("leaf_"), FAN * (depth - level))
        nodes = sums.groupBy(group, node.alias("node_")).agg(F.sum("sum_").alias("sum_"))
        siblings = Window.partitionBy(group, F.shiftright(F.col("node_"), FAN)).orderBy("node_").rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("before_", F.coalesce(F.sum("sum_").over(siblings), F.lit(0))).drop("sum_")
        if before is not None:
            up = before.select(group, F.col("node_").alias("up_"), F.col("before_").alias("more_"))
            nodes = nodes.withColumn("up_", F.shiftright(F.col("node_"), FAN)).join(up, [group, "up_"])
            nodes = nodes.select(group, "node_", (F.col("before_") + F.col("more_")).alias("before_"))
        before = nodes
    offsets = stored(before.select(group, F.col("node_").alias("leaf_"), "before_"), "leaf-offsets")
    here = Window.partitionBy(group, "leaf_").orderBy(position, *order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("leaf_", leaf)
        .join(offsets, [group, "leaf_"])
        .withColumn(out, F.col("before_") + F.sum(value).over(here))
        .drop("leaf_", "before_")
    )


def source_position(source: Column, skip: int = 0) -> Column:
    """A position of a text that keeps the order of code points: seven bytes, after those that all share; null last."""
    first = F.rpad(F.hex(F.substring(F.encode(source, "UTF-8"), skip + 1, 7)), 14, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(1 << (BITS - 1)))


def ranked(sources: DataFrame, rows: int) -> DataFrame:
    """sources (of which there are rows) with rank: from 0, by code point, null last."""
    least, most = ((x or "").encode() for x in sources.agg(F.min("source"), F.max("source")).first())
    shared = next((i for i, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
    s = sources.withColumns({"all": F.lit(0), "pos": source_position(F.col("source"), shared), "one": F.lit(1), "none": F.col("source").isNull()})
    s = running_total(s, "all", "pos", "one", ["none", "source"], "rank", rows)
    return s.withColumn("rank", (F.col("rank") - 1).cast("int")).drop("all", "pos", "one", "none")


def targets(sources: DataFrame, max_repeats: int, total: int | float, rows: int) -> DataFrame:
    """sources (rank, source, n, source_size, weight; so many rows) with target: weights share out the
    total; no target is above max_repeats times its source, and what that leaves over is
    shared again by weight, until none is above. One row per source."""
    s = sources.withColumn("cap", F.col("source_size") * max_repeats)
    s = s.withColumn("full_at", F.col("cap").cast("double") / F.col("weight")).withColumn("all", F.lit(0))
    s = stored(s, "mix-caps")
    weights, highest = s.agg(F.sum("weight"), F.max("full_at")).first()
    # sources fill up in this order; before each, what is used up and whose weights are gone
    s = s.withColumn("at", (F.col("full_at") / F.lit(max(highest or 0.0, 1.0)) * F.lit(float(1 << (BITS - 1)))).cast("long"))
    s = running_total(s, "all", "at", "cap", ["full_at", "rank"], "used", rows)
    s = running_total(s, "all", "at", "weight", ["full_at", "rank"], "gone", rows)
    rest, onward = F.lit(total) - (F.col("used") - F.col("cap")), F.lit(weights or 0) - (F.col("gone") - F.col("weight"))
    s = stored(s.withColumn("level", rest.cast("double") / onward.cast("double")), "mix-levels")
    level = s.where("level <= full_at").agg(F.min_by("level", F.struct("full_at", "rank"))).first()[0]
    cap = F.col("cap").cast("double")
    return s.withColumn("target", cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))).drop("all", "at", "used", "gone", "level")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes: one row per row of docs.

    The source of rank i (by code point, null last) weighs weights[i % len(weights)]; the
    budget is share of all words. A document is taken once per pass over its source, up to
    max_repeats. Null or blank texts have size 0 and are never taken; a source without
    words has target 0. Null ids take part; rows that are repeated count each. An empty
    table gives an empty result. The shuffle depends on the id alone, so reruns agree.
    """
    rows = stored(
        docs.select(
            quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("uid"), shuffled_position(quoted(id_col)).alias("pos"),
        ),
        "mix-rows",
    )
    per = stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), "mix-sources")
    n_rows, largest, words, n_sources = per.agg(F.sum("n"), F.max("n"), F.sum("source_size"), F.count(F.lit(1))).first()
    budget = (words or 0) * share if share != 1 else words or 0
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    per = ranked(per, n_sources).withColumn("weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int")))
    plan = stored(targets(per, max_repeats, budget, n_sources), "mix-targets")
    named = plan.select(F.col("source").alias("of"), "rank", "source_size", "target")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    # words of its source up to and with each document
    placed = stored(running_total(placed, "rank", "pos", "size", ["doc_id", "uid"], "upto", int(largest or 0)), "mix-placed")

    def ends(k: Column | int) -> Column:
        return (F.col("source_size") * k + F.col("upto")).cast("double") / F.col("target")

    def queued(k: Column | int) -> Column:
        """Of each source come those that end in its target, and the one that straddles it."""
        begins = F.col("source_size") * k + F.col("upto") - F.col("size")
        return (F.col("size") > 0) & (F.col("target") > 0) & (begins < F.col("target"))

    queue = (
        placed
        .withColumn("pass", F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])))
        .where(queued(F.col("pass")))
        .select(F.lit(0).alias("all"), ends(F.col("pass")).alias("time"), "rank", "pass", "pos", "doc_id", "uid", "size")
    )
    key = ["time", "rank", "pass", "pos", "doc_id", "uid"]
    queue = queue.withColumn("at", (F.least(F.col("time"), F.lit(1.9999)) * F.lit(float(1 << (BITS - 1)))).cast("long"))
    queue = running_total(queue, "all", "at", "size", key, "words", int(n_rows or 0))
    cut = queue.where(F.col("words") <= F.lit(budget)).agg(F.max(F.struct(*key)).alias("last")).first()["last"]

    def taken(k: int) -> Column:
        if cut is None:
            return F.lit(0)
        mine = F.struct(ends(k).alias("time"), F.col("rank"), F.lit(k).alias("pass"), "pos", "doc_id", "uid")
        last = F.struct(*[F.lit(cut[c]).cast(t).alias(c) for c, t in zip(key, ("double", "int", "int", "long", "long", "long"))])
        return F.when(queued(k) & (mine <= last), 1).otherwise(0)

    passes = sum((taken(k) for k in range(max_repeats)), F.lit(0))
    return placed.withColumn("passes", passes.cast("int")).select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("passes")).cast("long").alias("taken"), "passes",
    )
