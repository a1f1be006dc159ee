"""Exact deduplication by skew-safe combining (DataFrame functions only).

Three stages, each comparing the whole normalised text, not only its digest:

1. locally: the partial aggregate of each map task leaves one row per text;
2. salted: tasks' rows meet under (salt, digest, text), so that a text that makes
   up a third of the corpus is spread over ``salts`` reducers;
3. globally: the winners of the salts, at most ``salts`` per text, meet.

A group's row is its size and its best member. Rows find their group by digest, a
second independent hash and the length; that join carries no text, and as both
sides are dealt for it alone, the adaptive planner may split a hot digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WHITE, free_name, quoted, stored, text_of

#: Rank = length * _STEP - id: the longest original wins, then the smallest id. A step is
#: over twice the largest id, so that rounding to steps gives the length back.
_STEP = Decimal(20_000_000_000_000_000_000)
_NO_ID = Decimal(9_500_000_000_000_000_000)


def normalised(text: Column) -> Column:
    """The text without any of the six white-space characters."""
    return F.translate(text, WHITE, "")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_chars (of the original text), digest, check, n_norm, norm, and more columns of docs."""
    t = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *more)
    t = t.select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"), *more)
    return t.select(
        *more, "doc_id", "n_chars", F.sha2("norm", 256).alias("digest"),
        F.xxhash64("norm").alias("check"), F.length("norm").alias("n_norm"), "norm",
    )


def text_groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """digest, check, n_norm, keep_id, keep_chars, group_size: one row per distinct text."""
    ident = ["digest", "check", "n_norm", "norm"]
    rank = _wide(F.col("n_chars")) * F.lit(_STEP) - F.coalesce(_wide(F.col("doc_id")), F.lit(_NO_ID))
    salted = (
        rows.select(*ident, _wide(rank).alias("rank"), (F.spark_partition_id() % salts).alias("salt"))
        .groupBy("salt", *ident)
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    whole = salted.groupBy(*ident).agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    chars = F.round(F.col("rank") / F.lit(_STEP))
    less = _wide(F.col("chars")) * F.lit(_STEP) - F.col("rank")
    return (
        whole.select("digest", "check", "n_norm", "group_size", "rank", chars.cast("long").alias("chars"))
        .withColumn("less", _wide(less))
        .select(
            "digest", "check", "n_norm", "group_size", F.col("chars").alias("keep_chars"),
            F.when(F.col("less") != F.lit(_NO_ID), F.col("less").cast("long")).alias("keep_id"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Texts are equal when identical without white space. Of equal texts the row with
    the longest original stays, then the smallest id; a null id comes last. Null text
    counts as empty, empty texts are equal to each other. Of rows repeated with their
    id, exactly one stays. An empty table gives an empty result; other columns of docs
    are not read, so their names cannot clash.
    """
    rows = keyed(docs, id_col, text_col)
    groups = stored(text_groups(rows, salts), "exact-groups")
    found = rows.drop("norm").join(groups, ["digest", "check", "n_norm"])
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    again = Window.partitionBy("digest", "doc_id", "n_chars").orderBy("check")
    return found.withColumn("turn", F.row_number().over(again)).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (best & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns and nothing else.

    Rows are known by two hashes of id and text, so texts are normalised and digested once, and docs
    are shuffled once, for those of the winners. Of rows that share id and text, which differ at
    most in other columns, the one whose columns have the least hash stays.
    """
    one, two, nth = (free_name(docs, n) for n in ("mark_one_", "mark_two_", "nth_"))
    marks = {one: F.xxhash64(quoted(id_col).cast("long"), text_of(text_col)), two: F.xxhash64(text_of(text_col), quoted(id_col).cast("long"), F.lit(1))}
    rows = keyed(docs.select(quoted(id_col), quoted(text_col)).withColumns(marks), id_col, text_col, [one, two])
    found = rows.drop("norm").join(stored(text_groups(rows, salts), "exact-groups"), ["digest", "check", "n_norm"])
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    winners = found.where(best).groupBy("digest", "check", "n_norm").agg(F.min(F.struct(one, two)).alias("w"), F.count(F.lit(1)).alias("n"))
    winners = stored(winners.select(F.col(f"w.{one}").alias("k_one"), F.col(f"w.{two}").alias("k_two"), "n"), "exact-winners")
    kept = docs.withColumns(marks).join(winners.drop("n"), (quoted(one) == F.col("k_one")) & (quoted(two) == F.col("k_two")), "left_semi")
    twice = winners.where("n > 1").select("k_one", "k_two")
    if twice.isEmpty():
        return kept.drop(one, two)
    # few: rows that share id and text with a winner
    same = (quoted(one) == F.col("k_one")) & (quoted(two) == F.col("k_two"))
    order = F.xxhash64(F.to_json(F.struct(*[quoted(c) for c in docs.columns])))
    several = kept.join(twice, same, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(quoted(one), quoted(two)).orderBy(order)))
    return kept.join(twice, same, "left_anti").unionByName(several.where(quoted(nth) == 1).drop(nth)).drop(one, two)
