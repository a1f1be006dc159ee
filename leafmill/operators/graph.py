"""Operators on a document's object graph: duplicates, references, resources, owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import totals


def canonical(objects: DataFrame, doc: list[str], content: list[str], ident: str) -> DataFrame:
    """duplicate, canonical: objects equal to one with a smaller id, and that id.

    Content is equal where its SHA-256 and a second hash of 64 bits are. The least id is an
    aggregate, so very many equal objects are combined before they are shuffled.
    """
    key = F.sha2(F.to_json(F.struct(*content)), 256)
    keyed = objects.select(*doc, ident, key.alias("content_key"), F.xxhash64(*content).alias("content_check"))
    first = keyed.groupBy(*doc, "content_key", "content_check").agg(F.min(ident).alias("canonical"), F.count(F.lit(1)).alias("uses"))
    same = [*doc, "content_key", "content_check"]
    found = keyed.join(first.where("uses > 1"), same).where(F.col(ident) != F.col("canonical"))
    return found.select(*doc, F.col(ident).alias("duplicate"), "canonical")


def rewritten(edges: DataFrame, duplicates: DataFrame, doc: list[str], target: str) -> DataFrame:
    """edges with references to duplicates replaced by their canonical id."""
    d = duplicates.withColumnRenamed("duplicate", target)
    return edges.join(d, [*doc, target], "left").withColumn("new_target", F.coalesce("canonical", target)).drop("canonical")


def without(objects: DataFrame, gone: DataFrame, doc: list[str], ident: str, gone_id: str = "duplicate") -> DataFrame:
    """objects that aren't among the gone ones."""
    return objects.join(gone.withColumnRenamed(gone_id, ident), [*doc, ident], "left_anti")


def unused(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Declared names that nothing uses."""
    return declared.join(used.select(*keys).distinct(), keys, "left_anti")


def unvetoed(owners: DataFrame, members: DataFrame, owner: str, safe: str) -> DataFrame:
    """Owners all of whose members are safe: one that can't be shown to be safe vetoes its owner."""
    ok = members.groupBy(owner).agg(F.bool_and(F.coalesce(F.col(safe), F.lit(False))).alias("all_safe"), F.count(F.lit(1)).alias("members"))
    return owners.join(ok, owner, "left").withColumn("cleanable", F.coalesce("all_safe", F.lit(False)))


def unambiguous(names: DataFrame, doc: list[str], name: str, value: str) -> DataFrame:
    """Names that stand for one value only, with it."""
    per = names.groupBy(*doc, name).agg(F.min(value).alias("value"), F.max(value).alias("other"), F.count(F.lit(1)).alias("uses"))
    return per.where(F.col("value") == F.col("other")).drop("other")


def reachable(edges: DataFrame, roots: DataFrame, doc: list[str], hops: int | None = None) -> DataFrame:
    """doc, node, depth: nodes that roots reach over edges (src, dst), with the fewest hops.

    A frontier a round, until none is new or hops, if given, is reached; each round's state is written to
    the session's checkpoint folder, if it has one, to keep the plan short.
    """
    spark = edges.sparkSession
    seen = roots.select(*doc, "node").distinct().withColumn("depth", F.lit(0))
    front, depth = seen, 0
    while hops is None or depth < hops:
        depth += 1
        step = edges.join(front.withColumnRenamed("node", "src").drop("depth"), [*doc, "src"]).select(*doc, F.col("dst").alias("node")).distinct()
        front = step.join(seen, [*doc, "node"], "left_anti").withColumn("depth", F.lit(depth))
        if spark.conf.get("spark.checkpoint.dir", None):
            front = front.checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def inherited(pages: DataFrame, parents: DataFrame, doc: list[str], node: str = "node") -> DataFrame:
    """Each page's nearest value up its parents: pages (doc, node, parent, value), parents likewise.

    Each round doubles how far a parent looks up, so a chain of n parents takes log2(n) rounds,
    after which only cycles are left, whose value is null. Rounds are written to the session's
    checkpoint folder, if it has one.
    """
    spark = pages.sparkSession
    at = pages.select(*doc, node, F.col("parent").alias("up"), "value")
    nodes = parents.select(*doc, F.col("node").alias("up"), F.col("parent").alias("next_up"), F.col("value").alias("up_value"))
    for _ in range(max(1, parents.count()).bit_length() + 1):
        if at.where(F.col("value").isNull() & F.col("up").isNotNull()).isEmpty():
            break
        at = at.join(nodes, [*doc, "up"], "left").select(
            *doc, node, F.when(F.col("value").isNull(), F.col("next_up")).alias("up"), F.coalesce("value", "up_value").alias("value")
        )
        far = nodes.select(*doc, F.col("up").alias("next_up"), F.col("next_up").alias("far_up"), F.col("up_value").alias("far_value"))
        nodes = nodes.join(far, [*doc, "next_up"], "left").select(
            *doc, "up", F.when(F.col("up_value").isNull(), F.col("far_up")).alias("next_up"), F.coalesce("up_value", "far_value").alias("up_value")
        )
        if spark.conf.get("spark.checkpoint.dir", None):
            at, nodes = at.checkpoint(), nodes.checkpoint()
    return at.select(*doc, node, "value")


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a null or blank key go. An aggregate, so that a key
    which stands in very many rows is combined where they are read."""
    clean = rows.where(F.trim(F.col(key)) != "")
    # nulls come last, as the smallest number stands for a value that is there
    least = F.min_by(F.struct(*rows.columns), F.struct(*[x for c in order for x in (F.col(c).isNull().cast("int").alias(f"{c}_none"), F.col(c).alias(c))]))
    return clean.groupBy(F.col(key).alias("of_key")).agg(least.alias("first")).select("first.*")


def evictions(entries: DataFrame, group: str, size: str, order: list[str], budget: int) -> DataFrame:
    """Entries that go, largest first, until what is left fits the budget."""
    sums = entries.groupBy(F.col(group).alias("of_group")).agg(F.sum(size).alias("total"))
    e = totals.running_total(entries, group, [F.col(size).desc(), *[F.col(c) for c in order]], size, "freed")
    e = e.join(sums, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group")
    e = e.withColumn("freed_before", F.col("freed") - F.col(size)).drop("freed")
    return e.withColumn("evicted", F.col("total") - F.col("freed_before") > budget)


def output_names(files: DataFrame, folder: str, stem: str, preset: str, order: list[str], most: int = 99, short: bool = False) -> DataFrame:
    """files with output_name; equal names of a folder get -1, -2, ...; null beyond most: no name is free.

    Names are stem__optimized-preset.pdf, or stem_optimized.pdf if short.
    """
    if short:
        files = files.withColumn(preset, F.lit(""))
    files = files.withColumn("name_key", F.to_json(F.struct(folder, stem, preset)))
    files = totals.running_total(files, "name_key", [F.col(c) for c in order], F.lit(1), "name_nth").drop("name_key")
    nth = F.col("name_nth") - 1
    base = F.concat(F.col(stem), F.lit("_optimized" if short else "__optimized-"), F.col(preset))
    name = F.when(nth == 0, F.concat(base, F.lit(".pdf"))).when(nth <= most, F.concat(base, F.lit("-"), nth.cast("string"), F.lit(".pdf")))
    return files.withColumn("output_name", name).drop("name_nth")
