"""Predicates, reasons and summaries of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the gates, in bytes and pixels.
TRIVIAL_PIXELS, SMALL_JPEG_PIXELS = 10_000, 250_000
TINY_JPEG_BYTES, SMALL_BYTES = 6_144, 65_536
MANY_IMAGES, MIN_STREAM = 24, 64
MAX_SKIPS = 6
SIZE_TOLERANCE = 1.08


def small_floor(n_images: Column, lift: Column | None = None) -> Column:
    """Bytes at or below which an image within the cap is left alone; lower if there are many."""
    return F.when((n_images >= MANY_IMAGES) | (lift if lift is not None else F.lit(False)), TINY_JPEG_BYTES).otherwise(SMALL_BYTES)


def _holds(x: Column) -> Column:
    """A check on an unknown value doesn't hold."""
    return F.coalesce(x, F.lit(False))


def actionable(jpeg: Column, supported: Column, size: Column, edge: Column, pixels: Column, cap: Column, floor: Column, cmyk: Column, g4_input: Column) -> Column:
    """Whether recompressing an image is worth a try."""
    compact = _holds(edge <= cap) & ((size <= floor) & ~g4_input | _holds(jpeg & (pixels <= SMALL_JPEG_PIXELS)))
    return supported & ~cmyk & ~_holds(pixels <= TRIVIAL_PIXELS) & ~(jpeg & (size <= TINY_JPEG_BYTES)) & ~compact


def skip_reason(size: Column, edge: Column, pixels: Column, cap: Column, floor: Column, jpeg: Column, bilevel: Column, g4: Column) -> Column:
    """Why an image within the cap is skipped before it is decoded; null if it isn't."""
    within = _holds(edge <= cap)
    return F.when(within & (size <= floor) & ~(bilevel & g4), "already below target and unlikely to shrink meaningfully").when(
        within & _holds(jpeg & (pixels <= SMALL_JPEG_PIXELS)), "already near the requested target dimensions"
    )


def gates(x: dict[str, Column], cap: Column, floor: Column) -> Column:
    """The first gate that an image fails, in their order; null if it passes all."""
    small_jpeg = _holds(x["jpeg"] & (x["header_edge"] <= cap) & (x["header_pixels"] <= SMALL_JPEG_PIXELS))
    chain = [
        (x["is_mask"], "image mask"), (x["color_key"], "colour key mask"), (x["mask_unresolved"], "soft mask not found"), (x["matte"], "soft mask with matte"),
        (~x["supported"], "unsupported filter"), (x["jpeg"] & (x["size"] <= TINY_JPEG_BYTES), "tiny image"), (_holds(x["pixels"] <= TRIVIAL_PIXELS), "trivial image"),
        (small_jpeg, "already near the requested target dimensions"),
        (_holds(x["jpeg"] & (x["header_edge"] <= cap * SIZE_TOLERANCE) & (x["size"] <= floor / 2)), "already compact for the target"),
        (skip_reason(x["size"], x["edge"], x["pixels"], cap, floor, x["jpeg"], x["bilevel"], x["g4"]).isNotNull(), "already below target"),
        (x["cmyk"] & ~x["converts_cmyk"], "CMYK stays as it is"),
    ]
    out = None
    for when, reason in chain:
        out = F.when(when, reason) if out is None else out.when(when, reason)
    return out


def not_smaller(encoded: Column, original: Column, edge: Column, cap: Column) -> Column:
    """An encoding is dropped if it is no smaller and wasn't resized."""
    return (encoded >= original) & (edge <= cap)


def filter_info(filters: Column) -> dict[str, Column]:
    """What an array of filter names says: jpeg, ccitt, jpx, jbig2, supported."""
    has = lambda *names: F.arrays_overlap(filters, F.array(*[F.lit(n) for n in names]))
    jpeg, ccitt, jpx, jbig2 = has("DCTDecode", "DCT"), has("CCITTFaxDecode", "CCF"), has("JPXDecode"), has("JBIG2Decode")
    known = F.size(F.array_except(filters, F.array(*[F.lit(n) for n in ("DCTDecode", "DCT", "FlateDecode", "Fl", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode", "CCITTFaxDecode", "CCF", "JPXDecode", "JBIG2Decode")]))) == 0
    alone = ~(ccitt | jpx | jbig2) | (F.size(filters) == 1)
    return {"jpeg": jpeg, "ccitt": ccitt, "jpx": jpx, "jbig2": jbig2, "supported": known & alone}


def summary(images: DataFrame, doc: str) -> DataFrame:
    """Per document: images, their bytes, bytes worth a try, unsupported ones, the largest edge."""
    return images.groupBy(doc).agg(
        F.count(F.lit(1)).alias("image_count"), F.sum("size").alias("image_bytes"), F.sum(F.when(F.col("actionable"), F.col("size")).otherwise(0)).alias("actionable_bytes"),
        F.count_if(~F.col("supported")).alias("unsupported"), F.max("edge").alias("max_edge"),
    )


def reported_skips(skips: DataFrame, doc: str, order: list[str], most: int = MAX_SKIPS) -> DataFrame:
    """skips with nth and whether each is reported: the first most per document are."""
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return skips.withColumn("nth", nth).withColumn("reported", F.col("nth") <= most)


def mask_census(images: DataFrame, doc: list[str], mask: str) -> DataFrame:
    """Soft masks by how many images use them; shared if more than one."""
    return images.where(F.col(mask).isNotNull()).groupBy(*doc, mask).agg(F.count(F.lit(1)).alias("uses")).withColumn("shared", F.col("uses") > 1)


def decoded_estimate(pixels: Column, size: Column, jpx: Column, cmyk: Column) -> Column:
    """Bytes that decoding an image takes."""
    return F.when(pixels.isNull(), size * 12).when(jpx, pixels * 19).when(cmyk, pixels * 7).otherwise(pixels * 3)


def without_masks(images: DataFrame, doc: list[str], ident: str, mask: str) -> DataFrame:
    """Images that aren't themselves the soft mask of an image of their document."""
    masks = images.where(F.col(mask).isNotNull()).select(*doc, F.col(mask).cast(dict(images.dtypes)[ident]).alias(ident)).distinct()
    return images.join(masks, [*doc, ident], "left_anti")


def largest_first(size: str, ident: str) -> list[Column]:
    """The order in which images are worked on: the largest first, then by number."""
    return [F.col(size).desc(), F.col(ident)]
