"""Presets, settings and configuration values, as column functions.

Settings resolve field by field: overrides, then the payload, then the preset's default;
values are clamped, and an absolute size wins over a percentage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per preset its quality, size in percent, whether metadata go and fonts are
#: subset, the size of images after recompression, and the factor of the recommended edge.
PRESETS = {
    "conservative": (72, 84, False, False, 0.62, 1.0),
    "balanced": (60, 68, True, False, 0.48, 0.85),
    "maximum": (46, 52, True, True, 0.34, 0.7),
}
PRESET_SCHEMA = "preset string, image_quality int, max_image_size_percent int, strip_metadata boolean, subset_fonts boolean, image_ratio double, edge_factor double"
#: The reference edge of percentages and the clamps of resolved settings.
REFERENCE_EDGE = 3200
EDGE_RANGE, QUALITY_RANGE, PERCENT_RANGE = (100, 8000), (10, 100), (5, 100)
CONFIG_VERSION = 3


def text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _any_of(x: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(x, F.lit(p))
    return found


def preset_of(x: Column | str) -> Column:
    """The preset that a text names; balanced for anything else, null too."""
    low = F.lower(text(x))
    return (
        F.when(_any_of(low, "conservative", "light"), "conservative").when(_any_of(low, "maximum", "aggressive"), "maximum").otherwise("balanced")
    )


def preset_of_label(x: Column | str) -> Column:
    """The looser reading of labels in user interfaces."""
    low = F.lower(F.trim(text(x)))
    return (
        F.when(_any_of(low, "max", "aggressive", "strong"), "maximum").when(_any_of(low, "light", "gentle", "conservative"), "conservative").otherwise("balanced")
    )


def kind_of_label(x: Column | str) -> Column:
    low = F.lower(F.trim(text(x)))
    return F.when(F.contains(low, F.lit("text")), "text-native").when(F.contains(low, F.lit("scan")), "scan-heavy").otherwise("mixed")


def bilevel_of(x: Column | str) -> Column:
    """The bilevel codec that a text names: g4 unless it names JPEG alone."""
    low = F.lower(text(x))
    return F.when(_any_of(low, "g4", "ccitt"), "g4").when(_any_of(low, "jpeg", "jpg"), "jpeg").otherwise("g4")


def percent_to_px(percent: Column, edge: Column) -> Column:
    """A percentage of an edge in whole hundreds of pixels."""
    exact = edge.cast("double") * percent.cast("double") / 100.0
    return clamp(F.round(exact / 100.0) * 100.0, *EDGE_RANGE).cast("int")


def preset_default(preset: Column, pick: Callable[[tuple], object]) -> Column:
    """A preset's value as an expression; only three rows, so no join."""
    out = None
    for name, values in PRESETS.items():
        when = preset == name
        out = F.when(when, F.lit(pick(values))) if out is None else out.when(when, F.lit(pick(values)))
    return out


def preset_table(spark: SparkSession) -> DataFrame:
    """Every preset with its defaults."""
    rows = [(k, *v) for k, v in PRESETS.items()]
    table = spark.createDataFrame(rows, PRESET_SCHEMA)
    return table.withColumn("max_image_size_px", percent_to_px(F.col("max_image_size_percent"), F.lit(REFERENCE_EDGE)))


FIELDS = (
    "preset", "image_quality", "max_image_size_px", "max_image_size_percent", "optimize_images", "compress_streams",
    "strip_metadata", "grayscale", "bilevel_codec", "subset_fonts", "cmyk_conversion", "output_dir",
)


def first_of(*layers: dict[str, Column]) -> dict[str, Column]:
    """Layers of settings put together field by field; the first that isn't null wins."""
    none = F.lit(None)
    return {f: F.coalesce(*[x.get(f, none) for x in layers]) for f in FIELDS if any(f in x for x in layers)}


def resolve(overrides: dict[str, Column], payload: dict[str, Column], cms: bool = True) -> dict[str, Column]:
    """Settings from both layers and the preset's defaults. max_image_size_px is the cap that
    holds without a document; size_percent is set if the cap depends on the document's edge."""
    both = first_of(overrides, payload)
    get = lambda name, kind: both.get(name, F.lit(None)).cast(kind)
    preset = preset_of(get("preset", "string"))
    percent = clamp(get("max_image_size_percent", "int"), *PERCENT_RANGE).cast("int")
    percent = F.coalesce(percent, preset_default(preset, lambda v: v[1]))
    pixels = clamp(get("max_image_size_px", "int"), *EDGE_RANGE).cast("int")
    gray = F.coalesce(get("grayscale", "boolean"), F.lit(False))
    cmyk = F.coalesce(get("cmyk_conversion", "boolean"), F.lit(False))
    return {
        "preset": preset,
        "image_quality": F.coalesce(clamp(get("image_quality", "int"), *QUALITY_RANGE).cast("int"), preset_default(preset, lambda v: v[0])),
        "max_image_size_px": F.coalesce(pixels, percent_to_px(percent, F.lit(REFERENCE_EDGE))),
        "size_percent": F.when(pixels.isNull(), percent),
        "optimize_images": F.coalesce(get("optimize_images", "boolean"), F.lit(True)),
        "compress_streams": F.coalesce(get("compress_streams", "boolean"), F.lit(True)),
        "strip_metadata": F.coalesce(get("strip_metadata", "boolean"), preset_default(preset, lambda v: v[2])),
        "grayscale": gray,
        "bilevel_codec": bilevel_of(get("bilevel_codec", "string")),
        "subset_fonts": F.coalesce(get("subset_fonts", "boolean"), preset_default(preset, lambda v: v[3])),
        "cmyk_conversion": cmyk,
        "converts_cmyk": (F.lit(cms) & cmyk) | gray,
        "output_dir": get("output_dir", "string"),
    }


#: What a stored profile stands for where neither it nor its preset says anything.
LEGACY = {"image_quality": 60, "max_image_size_percent": 68, "optimize_images": True, "compress_streams": True, "strip_metadata": True, "grayscale": False, "bilevel_codec": "jpeg", "subset_fonts": False, "cmyk_conversion": False}


def sanitized_profile(value: dict[str, Column], fallback: dict[str, Column]) -> dict[str, Column]:
    """A stored profile with every field: its own value, that of the fallback, or the legacy one; numbers are clamped."""
    out = {f: F.coalesce(value.get(f, F.lit(None)), fallback.get(f, F.lit(None)), F.lit(v)) for f, v in LEGACY.items()}
    out["image_quality"] = clamp(out["image_quality"], *QUALITY_RANGE).cast("int")
    out["max_image_size_percent"] = clamp(out["max_image_size_percent"], *PERCENT_RANGE).cast("int")
    return out


def sanitized_config(version: Column, profiles: Column) -> Column:
    """A stored configuration: a whole version of 1 or more, and profiles of known presets."""
    return F.struct(F.greatest(F.round(F.coalesce(version.cast("double"), F.lit(1.0))).cast("int"), F.lit(1)).alias("version"), F.map_filter(profiles, lambda k, _: k.isin(*PRESETS)).alias("presets"))


def document_cap(px: Column, percent: Column, document_edge: Column) -> Column:
    """The cap for a document: a percentage of its largest edge (3200 if it has none), or px."""
    edge = F.when(document_edge > 0, document_edge).otherwise(F.lit(REFERENCE_EDGE))
    return F.when(percent.isNotNull(), percent_to_px(percent, edge)).otherwise(px)


def profile_overrides(profile: dict[str, Column]) -> dict[str, Column]:
    """Overrides from a stored profile: a percentage beats pixels, the folder is never taken over."""
    out = {k: v for k, v in profile.items() if k in FIELDS and k != "output_dir"}
    if "max_image_size_px" in out and "max_image_size_percent" in out:
        out["max_image_size_px"] = F.when(out["max_image_size_percent"].isNull(), out["max_image_size_px"])
    return out


def config_version(version: Column) -> Column:
    """A configuration without a version counts as current, so that no migration runs on it."""
    return F.coalesce(version.cast("int"), F.lit(CONFIG_VERSION))


def migrated_cmyk(version: Column, value: Column) -> Column:
    """Before version 2 only an explicit true was a choice."""
    return F.when((config_version(version) >= 2) | value, value)


def migrated_bilevel(version: Column, codec: Column) -> Column:
    """Before version 3 JPEG was the default, not a choice."""
    return F.when((config_version(version) >= 3) | ~F.coalesce(F.lower(F.trim(codec)).isin("jpeg", "jpg"), F.lit(False)), codec)
