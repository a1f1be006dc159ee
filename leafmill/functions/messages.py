"""Answers of the engine as user interfaces show them, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.presets import kind_of_label, preset_of_label
from leafmill.functions.records import distinct_notices, tone
from leafmill.functions.scalars import file_name, fill_template

#: Codes and texts where there are none.
UNKNOWN, TITLE, UNTOLD = "backend.unknown", "Something went wrong", "The engine gave no reason."


def message(code: Column, level: Column, values: Column, fallback: Column, default: str = "info") -> Column:
    """A message with a code and a known level; values without a text go."""
    kept = F.map_filter(values, lambda _, v: v.isNotNull())
    return F.struct(
        F.when(F.coalesce(code, F.lit("")) == "", UNKNOWN).otherwise(code).alias("code"), tone(level, default).alias("level"), F.coalesce(kept, F.create_map().cast("map<string,string>")).alias("values"),
        F.coalesce(fallback, code, F.lit(UNKNOWN)).alias("fallback"),
    )


def messages(notices: Column, default: str = "info") -> Column:
    """Notices as messages, each once."""
    return distinct_notices(F.transform(notices, lambda n: message(n["code"], n["level"], n["values"], n["fallback"], default)))


def error_message(error: Column, templates: Column | None = None) -> Column:
    """What is told of a failure: the template of its code filled in, else its own text, else a general one."""
    code, values = error["code"], error["values"]
    template = F.try_element_at(templates, code) if templates is not None else F.lit(None).cast("string")
    body = F.coalesce(fill_template(template, values), error["fallback"], F.lit(UNTOLD))
    return F.when(error.isNotNull(), F.struct(F.coalesce(code, F.lit("error.unknown")).alias("code"), F.lit("error").alias("level"), F.lit(TITLE).alias("title"), body.alias("body")))


def analysis_summary(analyses: DataFrame) -> DataFrame:
    """analyze() as it is shown: names in the shape of user interfaces, kinds and presets among the known ones."""
    c = F.col
    return analyses.select(
        c("doc_id").alias("sourcePath"), file_name(c("doc_id")).alias("fileName"), c("file_size_bytes").alias("fileSizeBytes"), c("page_count").alias("pageCount"),
        c("image_object_count").alias("imageObjectCount"), kind_of_label("document_kind").alias("documentKind"), c("image_coverage").alias("imageCoverage"),
        c("scanned_confidence").alias("scannedConfidence"), c("estimated_savings_percent").alias("estimatedSavingsPercent"), preset_of_label("recommended_preset").alias("recommendedPreset"),
        c("max_image_edge_px").alias("maxImageEdgePx"), c("recommended_max_image_size_px").alias("recommendedMaxImageSizePx"), c("recommended_image_quality").alias("recommendedImageQuality"),
        c("is_likely_scanned").alias("isLikelyScanned"), messages(c("notices")).alias("notes"), error_message(c("error")).alias("error"),
    )


def compression_result(results: DataFrame, output_path: Column | None = None) -> DataFrame:
    """optimize() as it is shown."""
    c = F.col
    return results.select(
        c("doc_id").alias("inputPath"), (output_path if output_path is not None else F.lit(None).cast("string")).alias("outputPath"), c("original_size_bytes").cast("double").alias("originalSizeBytes"),
        c("compressed_size_bytes").cast("double").alias("compressedSizeBytes"), c("saved_bytes").cast("double").alias("savedBytes"), c("savings_percent").alias("savingsPercent"),
        c("images_recompressed").alias("imagesRecompressed"), c("images_skipped").alias("imagesSkipped"), c("images_deduplicated").alias("imagesDeduplicated"),
        c("streams_compressed").alias("streamsCompressed"), c("metadata_removed").alias("metadataRemoved"), c("output_was_smaller").alias("outputWasSmaller"),
        messages(c("notices")).alias("notes"), error_message(c("error")).alias("error"),
    )
