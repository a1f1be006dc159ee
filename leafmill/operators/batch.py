"""Runs over many files: their inputs, their summary, what is told about each."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.scalars import human_size, notice
from leafmill.operators.images import MAX_SKIPS


def listed(folder: str) -> list[str]:
    """PDF files below a folder, depth first, by name within each; linked folders aren't followed."""
    out: list[str] = []
    for e in sorted(os.scandir(folder), key=lambda e: e.name):
        if e.is_dir(follow_symlinks=False):
            out += listed(e.path)
        elif e.is_file() and e.name.lower().endswith(".pdf"):
            out.append(e.path)
    return out


def expanded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """arg_pos, path, canonical: folders become their files, files stay as named, each file once at
    its first place. For paths that the driver lists; read_files() takes folders of any store."""
    rows = []
    for i, p in enumerate(paths):
        for q in listed(p) if os.path.isdir(p) else [p]:
            rows.append((i, len(rows), q, os.path.realpath(q)))
    d = spark.createDataFrame(rows, "arg_pos int, at int, path string, canonical string")
    first = d.groupBy("canonical").agg(F.min("at").alias("at"))
    return d.join(first, ["canonical", "at"]).orderBy("at").select("arg_pos", "path", "canonical")


def existing(queue: DataFrame, files: DataFrame, path: str = "path", known: str = "doc_id") -> DataFrame:
    """Queue entries whose file is among files; blank paths go."""
    return queue.where(F.trim(F.col(path)) != "").join(files.select(F.col(known).alias(path)), path, "left_semi")


def status(results: DataFrame) -> Column:
    return F.when(results["error"].isNotNull(), "failed").when(results["output_was_smaller"], "compressed").otherwise("notSmaller")


def summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each of by): files by status, bytes before and after of those that didn't fail, percent saved, and
    whether any failed, which is a run's exit status."""
    s = F.col("status")
    kept = F.when(s == "compressed", F.col("compressed_size_bytes")).when(s == "notSmaller", F.col("original_size_bytes"))
    g = results.withColumn("status", status(results)).groupBy(*by).agg(
        F.count_if(s == "compressed").alias("files_compressed"), F.count_if(s == "notSmaller").alias("files_not_smaller"), F.count_if(s == "failed").alias("files_failed"),
        F.coalesce(F.sum(F.when(s != "failed", F.col("original_size_bytes"))), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum(kept), F.lit(0)).alias("compressed_bytes"),
    )
    saved = 100.0 * (F.col("original_bytes") - F.col("compressed_bytes")) / F.when(F.col("original_bytes") > 0, F.col("original_bytes"))
    return g.withColumns({"savings_percent": F.coalesce(saved, F.lit(0.0)), "any_failed": F.col("files_failed") > 0})


def with_notices(results: DataFrame, settings: dict, target_bytes: int | None = None) -> DataFrame:
    """results with saved_bytes, savings_percent and notices, in order; null for failed files.

    At most six skipped images are told one by one, the others are counted.
    """
    c = F.col
    quality = F.coalesce("quality", F.lit(settings["image_quality"]))
    skips = F.coalesce("skips", F.array().cast("array<struct<num:int,reason:string>>"))
    one = [
        (~c("output_was_smaller"), notice("outputNotSmaller", "warning", "The result would not have been smaller, so the original stays.", original=c("original_size_bytes"))),
        (F.lit(target_bytes is not None) & c("target_met"), notice("targetSizeMet", "success", "The file fits the target size.", target=human_size(F.lit(target_bytes or 0)), quality=quality)),
        (F.lit(target_bytes is not None) & ~c("target_met"), notice("targetSizeMissed", "warning", "The target size was out of reach.", target=human_size(F.lit(target_bytes or 0)))),
        (F.lit(True), notice("appliedProfile", "info", "Settings that were used.", preset=F.lit(settings["preset"]), quality=quality)),
    ]
    rest = [
        (F.lit(True), notice("safeRewrite", "info", "Text and structure are as they were.")),
        (c("was_encrypted"), notice("decryptedInput", "info", "The result is not encrypted.")),
        (c("images_skipped") > 0, notice("imageSkipSummary", "info", "Some images stay as they are.", count=c("images_skipped"))),
        (c("images_deduplicated") > 0, notice("imageDedupe", "success", "Equal images were merged.", count=c("images_deduplicated"))),
        (c("bilevel_encoded") > 0, notice("bilevelEncoded", "success", "Black and white images were fax coded.", count=c("bilevel_encoded"))),
        (c("streams_deduplicated") > 0, notice("streamDedupe", "success", "Equal streams were merged.", count=c("streams_deduplicated"))),
        (c("resources_removed") > 0, notice("resourcesCleaned", "success", "Unused resources were removed.", count=c("resources_removed"))),
        (c("fonts_subsetted") > 0, notice("fontsSubsetted", "success", "Unused glyphs were removed.", count=c("fonts_subsetted"), bytes=c("font_bytes_saved"))),
        (~c("metadata_removed"), notice("metadataKept", "info", "Metadata stay.")),
    ]
    told = F.transform(F.slice(skips, 1, MAX_SKIPS), lambda s: F.struct(F.lit("imageSkipped").alias("code"), F.lit("warning").alias("level"), F.create_map(F.lit("object"), s["num"].cast("string"), F.lit("reason"), s["reason"]).alias("values"), F.lit("An image was skipped.").alias("fallback")))
    listed_ = lambda parts: F.filter(F.array(*[F.when(w, n) for w, n in parts]), lambda x: x.isNotNull())
    out = F.concat(listed_(one), told, listed_(rest))
    saved = F.greatest(c("original_size_bytes") - c("compressed_size_bytes"), F.lit(0))
    ok = c("error").isNull()
    return results.withColumns(
        {
            "saved_bytes": F.when(ok, saved), "savings_percent": F.when(ok & (c("original_size_bytes") > 0), 100.0 * saved / c("original_size_bytes")), "notices": F.when(ok, out),
        }
    )
