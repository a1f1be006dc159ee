"""Shared plumbing of the text operators: inputs, scratch tables, defined defaults."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every text contract here: blank, \t, \n, \v, \f, \r.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_own_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's spark.checkpoint.dir, or the one that
    was set on its context.

    Only a session without either that has no other machines (as in tests) gets a folder of its
    own; on a cluster that is an error, as executors would write to disks of their own.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = set_.get() if set_.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if app not in _own_roots:
            _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        base = _own_roots[app]
    return f"{base.rstrip('/')}/leafmill-{app}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


#: Pages of scratch files carry checksums, which are verified as they are read, in any file system.
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
#: A local file system would keep a second checksum in a file beside each; those are left out.
_WRITTEN = {"parquet.page.write-checksum.enabled": "true", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a re-run), makes
    nondeterministic columns stable and lets the next join deal its rows anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**_WRITTEN).parquet(path)
    out = spark.read.schema(df.schema).options(**_VERIFIED).parquet(path)
    out._leafmill_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored() table that nothing reads any more."""
    if path := getattr(df, "_leafmill_path", None):
        drop_scratch(df.sparkSession, path)


def text_of(col: str | Column) -> Column:
    """The text of a column, the empty one for null."""
    return F.coalesce((F.col(f"`{col}`") if isinstance(col, str) else col).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not got, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of an Arrow batch; with whole texts in them, Spark's own 10,000 rows can be gigabytes.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that this session sends to Python workers, where they aren't bounded
    as tightly. Batches are made when a result is asked for, so the settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).upper()
        if not (now.removesuffix("B").isdigit() and 0 < int(now.removesuffix("B")) <= most):
            spark.conf.set(key, str(most))
