"""A folder of PDF files as a queue: each new file is analysed or rewritten once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_FILE = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """doc_id, length, content of files as they come to the folder, oldest first."""
    s = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true")
    return s.option("maxFilesPerTrigger", files_at_once).load(folder).select(F.col("path").alias("doc_id"), "length", "content")


def process(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_at_once: int = 64) -> StreamingQuery:
    """Start work (say leafmill.sources.pdf.analyze) on every file that is there, results as Parquet
    below out. The checkpoint remembers what is done, so starting again takes only what is new, and
    a batch that is done again after a failure replaces what it wrote."""

    def batch(files: DataFrame, number: int) -> None:
        work(files).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return incoming(spark, folder, files_at_once).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
