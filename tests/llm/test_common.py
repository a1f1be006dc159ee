"""Scratch tables and batches."""

import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import _common


def test_damaged_scratch_files_are_noticed(spark):
    out = _common.stored(spark.range(20_000).select("id", F.xxhash64("id").alias("x")), "damage")
    assert out.count() == 20_000 and out.agg(F.bit_xor("x")).first()[0] is not None
    path = out._leafmill_path.removeprefix("file://").removeprefix("file:")
    for name in glob.glob(f"{path}/*.parquet"):
        with open(name, "r+b") as f:
            f.seek(2_000)
            byte = f.read(1)
            f.seek(2_000)
            f.write(bytes([byte[0] ^ 0xFF]))
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        spark.read.options(**_common._VERIFIED).parquet(out._leafmill_path).agg(F.bit_xor("x"), F.sum("id")).collect()


def test_batches_are_bounded_in_bytes(spark):
    _common.small_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["bytes", "rows"])

    rows = spark.range(96).coalesce(1).select(F.repeat(F.lit("x"), 2 << 20).alias("text"))
    got = rows.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in got) == 96 and max(r.bytes for r in got) <= _common.BATCH_BYTES + (4 << 20)


def test_scratch_folder_is_the_one_that_is_set(spark):
    assert _common.scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
