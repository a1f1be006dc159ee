"""Text, number and predicate functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024.0


def parse_size(x: Column) -> Column:
    """Bytes of '5MB', '500K' or '1.5 GiB' (base 1024); null for anything else."""
    form = r"^\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+\.)\s*([A-Za-z]*)\s*$"
    unit = F.upper(F.regexp_extract(x, form, 2))
    times = (
        F.when(unit.isin("", "B"), 1.0).when(unit.isin("K", "KB", "KIB"), KIB).when(unit.isin("M", "MB", "MIB"), KIB**2).when(unit.isin("G", "GB", "GIB"), KIB**3)
    )
    value = F.regexp_extract(x, form, 1).try_cast("double")
    return F.when(F.regexp_like(x, F.lit(form)), F.floor(value * times)).cast("long")


def _scaled(x: Column, units: list[str]) -> list[tuple[Column, Column, str]]:
    """(condition, value, unit) for each unit, the largest first."""
    out = []
    for k in reversed(range(len(units))):
        out.append((x >= KIB**k if k else F.lit(True), x / KIB**k, units[k]))
    return out


def human_size(x: Column) -> Column:
    """'512 B', '1.5 KB', '20 MB': one decimal below ten; ties go to even."""
    out = None
    for when, value, unit in _scaled(x.cast("double"), ["B", "KB", "MB", "GB", "TB"]):
        if unit == "B":
            text = F.format_string("%d B", x.cast("long"))
        else:
            text = F.when(value < 10, F.format_string(f"%.1f {unit}", F.bround(value, 1))).otherwise(F.format_string(f"%.0f {unit}", F.bround(value)))
        out = F.when(when, text) if out is None else out.when(when, text)
    return out


def human_bytes(x: Column) -> Column:
    """'512B', '1.50KB', '20.00MB': two decimals, no blank, nothing below zero."""
    x = F.greatest(x.cast("double"), F.lit(0.0))
    out = None
    for when, value, unit in _scaled(x, ["B", "KB", "MB", "GB"]):
        text = F.format_string(f"%.0f{unit}" if unit == "B" else f"%.2f{unit}", F.bround(value, 0 if unit == "B" else 2))
        out = F.when(when, text) if out is None else out.when(when, text)
    return out


def format_bytes(x: Column) -> Column:
    """'--' for null; else two, one or no decimals by magnitude."""
    out = None
    for when, value, unit in _scaled(x.cast("double"), ["B", "KB", "MB", "GB", "TB"]):
        if unit == "B":
            text = F.concat(x.cast("long").cast("string"), F.lit(" B"))
        else:
            text = F.format_string("%s " + unit, F.when(value >= 100, F.format_string("%.0f", value)).when(value >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value)))
        out = F.when(when, text) if out is None else out.when(when, text)
    return F.coalesce(out, F.lit("--"))


def format_percent(x: Column) -> Column:
    text = F.when(x >= 10, F.format_string("%.0f%%", x.cast("double"))).otherwise(F.format_string("%.1f%%", x.cast("double")))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "--").otherwise(text)


def format_duration(ms: Column) -> Column:
    """'830 ms', '4.2 s', '2 min 05 s'; '--' for null or negative."""
    s = ms.cast("double") / 1000.0
    minutes = F.floor(s / 60).cast("long")
    rest = F.round(s - minutes * 60).cast("long")
    return (
        F.when(ms.isNull() | (ms < 0), "--")
        .when(ms < 1000, F.format_string("%d ms", F.round(ms.cast("double")).cast("long")))
        .when(s < 60, F.format_string("%.1f s", s))
        .otherwise(F.format_string("%d min %02d s", minutes, rest))
    )


def file_name(path: Column) -> Column:
    """The last part of a path with slashes of either kind; the path itself if that is empty."""
    last = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.when(last == "", path).otherwise(last)


def is_pdf_path(path: Column) -> Column:
    return F.lower(F.trim(path)).endswith(".pdf")


def fill_template(template: Column, values: Column) -> Column:
    """'{key}' replaced from a map of texts; keys that are unknown, or have no value, stay."""
    values = F.map_filter(values, lambda _, v: v.isNotNull())
    keys = F.map_keys(values)
    return F.aggregate(keys, template, lambda t, k: F.replace(t, F.concat(F.lit("{"), k, F.lit("}")), values[k]))


def notice(code: str, level: str, fallback: str, **values: Column) -> Column:
    """A notice: code, level, values by name in order, text to fall back on."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(values.items())]
    found = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), found.alias("values"), F.lit(fallback).alias("fallback"))


def longest_edge(width: Column, height: Column) -> Column:
    """The longer side, null unless both are positive."""
    return F.when((width > 0) & (height > 0), F.greatest(width, height))


def pixel_count(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.try_multiply(width.cast("long"), height.cast("long")))


def dims_in_budget(width: Column, height: Column, edge: int = 65_535, pixels: int = 100_000_000) -> Column:
    return width.between(1, edge) & height.between(1, edge) & (width.cast("long") * height.cast("long") <= pixels)


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 where total is 0."""
    return F.when(total == 0, 0.0).otherwise(part.cast("double") / total.cast("double"))


def round_quality(quality: Column, detail: Column) -> Column:
    """Quality for an image by its detail: plain ones bear less, busy ones need more."""
    shifted = quality + F.when(detail < 8, -12).when(detail > 25, 6).otherwise(0)
    return F.least(F.greatest(shifted, F.lit(10)), F.lit(100))


def worker_count(tasks: Column, cores: Column, largest: Column) -> Column:
    """How many images to work on at once: below three one, else by cores and by memory."""
    memory = F.greatest(F.floor(F.lit(float(1 << 30)) / F.greatest(largest.cast("double"), F.lit(1.0))), F.lit(1))
    most = F.least(tasks, F.greatest(cores - 1, F.lit(1)), F.lit(8), memory)
    return F.when(tasks < 3, 1).otherwise(F.greatest(most, F.lit(1))).cast("int")


def stream_workers(streams: Column, cores: Column) -> Column:
    """How many streams to pack at a time: below eight one, else by cores."""
    return F.when(streams < 8, 1).otherwise(F.greatest(F.least(cores - 1, F.lit(8), streams), F.lit(1))).cast("int")


def mobile_limit(heap: Column, most: int = 512 << 20) -> Column:
    """Bytes of a file that a device with so much memory for a program may read."""
    return F.least(F.lit(most), F.floor(heap / 8)).cast("long")
