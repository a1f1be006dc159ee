"""Scoring and classifying documents from signals of their pages and images.

All operators here are projections and one aggregation per document; ratios and scores
are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.presets import clamp, preset_default
from leafmill.functions.scalars import notice, ratio
from leafmill.operators import totals

#: Pages of a document that are looked into.
SAMPLED_PAGES = 24


def even_sample(pages: DataFrame, doc: str, order: list[str], size: int = SAMPLED_PAGES) -> DataFrame:
    """Up to size pages of each document, evenly spread, the first and the last among them.

    A page of index i (from 0, of n) is taken if it is round(k * (n - 1) / (size - 1)) for a whole
    k. Every page finds that out for itself, so the pages needn't meet the list of indexes. A
    document's pages are numbered range by range, so a very large one is no single task's.
    """
    totals_of = pages.groupBy(F.col(doc).alias("of_doc")).agg(F.count(F.lit(1)).alias("page_total"))
    p = totals.running_total(pages, doc, [F.col(c) for c in order], F.lit(1), "page_index").withColumn("page_index", F.col("page_index") - 1)
    p = p.join(totals_of, F.col(doc).eqNullSafe(F.col("of_doc"))).drop("of_doc")
    last, steps = (F.col("page_total") - 1).cast("double"), float(size - 1)
    # the nearest k for this index, and whether that k's index is this one
    near = F.round(F.col("page_index") * steps / F.greatest(last, F.lit(1.0)))
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        k = near + shift
        hit = hit | ((F.round(last * k / steps) == F.col("page_index")) & k.between(0, steps))
    return p.where((F.col("page_total") <= size) | hit)


def page_signals(pages: DataFrame, doc: str) -> DataFrame:
    """Per document: counts over its looked-into pages (text_chars, image_refs, has_text_ops, has_fonts, failed)."""
    yes = lambda c: F.count_if(F.col(c))
    return pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("inspected_pages"), F.sum("text_chars").alias("text_chars"), F.count_if(F.col("text_chars") > 0).alias("pages_text"),
        yes("has_text_ops").alias("pages_text_ops"), yes("has_fonts").alias("pages_fonts"), F.count_if(F.col("image_refs") > 0).alias("pages_images"),
        F.sum("image_refs").alias("image_refs"), yes("failed").alias("text_failures"),
    )


def scored(docs: DataFrame) -> DataFrame:
    """docs (signals plus size, page_count, image_objects) with coverage, confidence, kind, preset."""
    c = {k: F.col(k).cast("double") for k in ("size", "page_count", "image_objects", "text_chars", "pages_text", "pages_text_ops", "pages_fonts", "pages_images", "image_refs", "text_failures")}
    inspected = F.greatest(F.col("inspected_pages"), F.lit(1)).cast("double")
    bpp = ratio(c["size"], c["page_count"])
    tpp = c["text_chars"] / inspected
    ipp = F.when(c["image_refs"] > 0, c["image_refs"] / inspected).otherwise(ratio(c["image_objects"], c["page_count"]))
    structure = F.greatest(c["pages_text"], c["pages_text_ops"], c["pages_fonts"]) / inspected
    ipr, failed = c["pages_images"] / inspected, c["text_failures"] / inspected
    d = docs.withColumns({"bytes_per_page": bpp, "text_per_page": tpp, "images_per_page": ipp, "structure": structure, "image_pages": ipr, "failed_pages": failed})
    low = lambda x, y: F.least(F.col(x), F.lit(y))
    coverage = low("bytes_per_page", 180_000.0) / 180_000.0 * 45 + F.col("image_pages") * 35 + low("images_per_page", 3.0) / 3 * 20 - F.col("structure") * 10
    confidence = (
        (140 - low("text_per_page", 140.0)) / 140 * 45 + F.col("image_pages") * 25 + low("images_per_page", 2.5) / 2.5 * 15
        + low("bytes_per_page", 240_000.0) / 240_000.0 * 25 - F.col("structure") * 30 - F.col("failed_pages") * 12
    )
    d = d.withColumn("image_coverage", clamp(coverage, 8.0, 99.0)).withColumn("scanned_confidence", clamp(confidence, 5.0, 99.0))
    conf = F.col("scanned_confidence")
    strong = (F.col("text_per_page") >= 120) & (F.col("structure") >= 0.6)
    scanned = (conf >= 60) & (F.col("text_per_page") < 110) & (F.col("image_pages") >= 0.35) & (F.col("structure") < 0.75)
    kind = F.when(strong & (F.col("image_pages") < 0.65) & (F.col("images_per_page") < 1.25), "text-native").when(scanned, "scan-heavy").otherwise("mixed")
    preset = F.when(conf >= 80, "maximum").when(conf >= 48, "balanced").otherwise("conservative")
    return d.withColumns({"is_likely_scanned": scanned, "document_kind": kind, "recommended_preset": preset})


def estimated_savings(preset: Column, image_bytes: Column, size: Column) -> Column:
    """Percent of size: images shrink to the preset's ratio, the rest by a twentieth; 3 to 85, 5 for nothing."""
    image = image_bytes.cast("double") * (1.0 - preset_default(preset, lambda v: v[4]))
    rest = F.greatest(size - image_bytes, F.lit(0)).cast("double") * 0.05
    return F.when(size == 0, 5.0).otherwise(clamp((image + rest) / size.cast("double") * 100.0, 3.0, 85.0))


def recommended_edge(preset: Column, edges: Column) -> Column:
    """The cap from an array of edges: their 75th percentile by nearest rank, scaled, in hundreds."""
    ranked = F.array_sort(edges)
    at = F.round((F.size(edges) - 1) * 0.75).cast("int") + 1
    base = clamp(F.try_element_at(ranked, at).cast("double"), 800.0, 3200.0)
    scaled = base * preset_default(preset, lambda v: v[5])
    none = preset_default(preset, lambda v: {84: 2700, 68: 2200, 52: 1700}[v[1]])
    return F.when(F.size(edges) > 0, clamp(F.round(scaled / 100.0) * 100.0, 800.0, 3200.0).cast("int")).otherwise(none)


def nearest_rank_edges(images: DataFrame, doc: str, edge: str) -> DataFrame:
    """doc, base_edge: the 75th percentile by nearest rank, from counts of equal edges.

    Edges are aggregated first, so a document with very many images is a few thousand counts.
    """
    counts = images.where(F.col(edge).isNotNull()).groupBy(doc, edge).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(doc)
    c = counts.withColumn("upto", F.sum("n").over(w.orderBy(edge))).withColumn("total", F.sum("n").over(w))
    at = F.round((F.col("total") - 1) * 0.75)
    return c.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(doc, F.col(edge).alias("base_edge"))


def edge_cap(preset: Column, base_edge: Column) -> Column:
    scaled = clamp(base_edge.cast("double"), 800.0, 3200.0) * preset_default(preset, lambda v: v[5])
    return clamp(F.round(scaled / 100.0) * 100.0, 800.0, 3200.0).cast("int")


def analysis_notices(sampled: Column, page_count: Column, failures: Column, kind: Column, images: Column, unsupported: Column, unlocked: Column, structure: Column, image_pages: Column, size: Column) -> Column:
    """The notices of an analysis, in order."""
    always = F.lit(True)
    parts = [
        (always, notice("structureBased", "info", "The analysis looks at the document's structure.")),
        (always, notice("safeOptimization", "info", "Only safe changes are made.")),
        (sampled < page_count, notice("sampledPages", "info", "Some pages were looked into.", sampled=sampled, total=page_count)),
        (failures > 0, notice("textExtractionFallback", "warning", "Some text could not be read.", count=failures)),
        (kind == "text-native", notice("textNative", "info", "The document is mostly text.")),
        (page_count > 150, notice("largePageCount", "warning", "The document has many pages.", count=page_count)),
        (images == 0, notice("noImages", "info", "The document has no images.")),
        (unsupported > 0, notice("unsupportedImageCodecs", "warning", "Some images stay as they are.", count=unsupported)),
        (unlocked, notice("encryptedUnlocked", "info", "The document opened without a password.")),
        ((kind == "mixed") & (structure > 0.25) & (image_pages > 0.25), notice("mixedDocument", "info", "Text and images are mixed.")),
        (size < 1_000_000, notice("smallPdf", "info", "The document is small already.")),
    ]
    return F.filter(F.array(*[F.when(when, what) for when, what in parts]), lambda x: x.isNotNull())
