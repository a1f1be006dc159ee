"""A Bloom filter of bounded size over a column of 64-bit hashes.

It decides what is worth shuffling, never what is in a result: what it lets through is
joined exactly afterwards. It has about PER_KEY bits a key, but at most 2 ** MOST (128 MB),
so it may be broadcast; beyond some 100 million keys it lets more through and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, quoted

#: Bits a key, and the least and the most bits of a filter, as powers of two.
PER_KEY, LEAST, MOST = 10, 16, 30
SHIFTS = (0, 17, 34)


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """The filter's words. At most 2 ** MOST / 64 rows, each a word, come to the driver."""
    size = min(max((PER_KEY * keys.count()).bit_length(), LEAST), MOST)
    mask = F.lit((1 << size) - 1)
    bits = keys.select(F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(mask) for s in SHIFTS])).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bits.select(F.shiftright("bit", 6).alias("word"), one.alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint64)
    return out


def maybe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be among those of the filter."""
    ok, mask = np.ones(len(keys), bool), np.uint64(64 * len(words) - 1)
    for s in SHIFTS:
        bit = (keys >> np.uint64(s)) & mask
        ok &= (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return ok


def drop_rows(docs: DataFrame, key: Column, bad: DataFrame, bad_key: str) -> DataFrame:
    """docs without the rows whose key (a long) is among bad's, null keys staying.

    Rows that the filter clears, most of them, aren't shuffled; the others are joined exactly.
    """
    spark = docs.sparkSession
    bad = bad.select(F.col(bad_key).alias("bad_key"), F.xxhash64(bad_key).alias("bad_hash"))
    words = spark.sparkContext.broadcast(bloom(bad, "bad_hash"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(maybe(words.value, b.to_numpy(zero_copy_only=False).view(np.uint64)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    own, doubt = free_name(docs, "key_"), free_name(docs, "doubt_")
    rows = docs.withColumn(own, key).withColumn(doubt, F.arrow_udf(run, "boolean")(F.xxhash64(quoted(own))))
    left = rows.where(quoted(doubt)).join(bad, quoted(own) == F.col("bad_key"), "left_anti")
    return rows.where(~quoted(doubt)).unionByName(left).drop(own, doubt)
