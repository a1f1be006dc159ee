"""Command lines as arrays of arguments: flags, inputs, settings, as column functions.

A value is a struct of value and error, of which one at most is set; an error is a text.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.presets import bilevel_of
from leafmill.functions.scalars import parse_size

#: Flags that take a value, and what a flag without one stands for.
VALUE_FLAGS = ("--preset", "--quality", "--max-edge", "--bilevel", "--target-size", "--output-dir", "--password")
SWITCHES = {"grayscale": (("--grayscale", True),), "subset_fonts": (("--subset-fonts", True),), "cmyk_conversion": (("--no-convert-cmyk", False), ("--convert-cmyk", True)), "strip_metadata": (("--keep-metadata", False),)}
COMMANDS = ("analyze", "compress", "quick")


def _result(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def flag_value(args: Column, name: str) -> Column:
    """The value of '--name value' or '--name=value', the first that there is. An error where no value
    follows, or one that looks like a flag; value and error are null where the flag isn't given."""
    at = F.array_position(F.transform(args, lambda a: (a == name) | a.startswith(f"{name}=")), True)
    here, after = F.try_element_at(args, at.cast("int")), F.try_element_at(args, (at + 1).cast("int"))
    inline = here.startswith(f"{name}=")
    value = F.when(at > 0, F.when(inline, F.substring(here, len(name) + 2, 1 << 30)).otherwise(after))
    error = F.when((at > 0) & ~inline & after.isNull(), F.lit(f"{name} requires a value")).when(
        (at > 0) & ~inline & after.startswith("--"), F.concat(F.lit(f"{name} requires a value, but the next argument looks like a flag: "), after)
    )
    return _result(value, error)


def number_flag(args: Column, name: str, most: int) -> Column:
    """A flag's value as a whole number from 0 to most, an error for anything else."""
    raw = flag_value(args, name)
    number = F.when(F.regexp_like(raw["value"], F.lit(r"^\+?[0-9]{1,18}$")), raw["value"].try_cast("bigint"))
    bad = raw["value"].isNotNull() & ~F.coalesce(number <= most, F.lit(False))
    return _result(number, F.coalesce(raw["error"], F.when(bad, F.concat(F.lit(f"{name} got an invalid value: "), raw["value"]))))


def size_flag(args: Column, name: str = "--target-size") -> Column:
    """A flag's value as bytes, as in '5MB'."""
    raw = flag_value(args, name)
    size = parse_size(raw["value"])
    bad = raw["value"].isNotNull() & size.isNull()
    return _result(size, F.coalesce(raw["error"], F.when(bad, F.concat(F.lit(f"{name} got an invalid value: "), raw["value"]))))


def inputs(args: Column) -> Column:
    """inputs, flags and error of a command line: flags that take a value take the next argument with
    them, whatever it is, so that it is never taken for an input."""
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("inputs"), none.alias("flags"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, a: Column) -> Column:
        makes = lambda i, f, o: F.struct(i.alias("inputs"), f.alias("flags"), o.alias("open"))
        closed = F.lit(None).cast("string")
        return (
            F.when(s["open"].isNotNull(), makes(s["inputs"], F.concat(s["flags"], F.array(s["open"], a)), closed))
            .when(a.isin(*VALUE_FLAGS), makes(s["inputs"], s["flags"], a))
            .when(a.startswith("--"), makes(s["inputs"], F.array_append(s["flags"], a), closed))
            .otherwise(makes(F.array_append(s["inputs"], a), s["flags"], closed))
        )

    end = F.aggregate(args, begin, step)
    error = F.when(end["open"].isNotNull(), F.concat(end["open"], F.lit(" requires a value")))
    return F.struct(end["inputs"].alias("inputs"), end["flags"].alias("flags"), error.alias("error"))


def password(args: Column) -> Column:
    return flag_value(args, "--password")


def overrides(args: Column) -> tuple[dict[str, Column], Column]:
    """Settings that a command line overrides, null where it doesn't, and the first error."""
    codec, preset, folder = (flag_value(args, n) for n in ("--bilevel", "--preset", "--output-dir"))
    quality, edge = number_flag(args, "--quality", 255), number_flag(args, "--max-edge", 65_535)
    found = F.when(codec["value"].isNotNull(), bilevel_of(codec["value"]))
    bad = (found == "g4") & ~F.contains(F.lower(codec["value"]), F.lit("g4"))
    errors = [codec["error"], F.when(bad, F.concat(F.lit("--bilevel got an invalid value: "), codec["value"], F.lit(" (expected g4 or jpeg)")))]
    errors += [x["error"] for x in (preset, quality, edge, folder)]
    out = {
        "preset": preset["value"], "image_quality": quality["value"].cast("int"), "max_image_size_px": edge["value"].cast("int"), "output_dir": folder["value"], "bilevel_codec": found,
    }
    for name, switches in SWITCHES.items():
        value = F.lit(None).cast("boolean")
        for flag, means in reversed(switches):
            value = F.when(F.array_contains(args, flag), means).otherwise(value)
        out[name] = value
    return out, F.coalesce(*errors)


def command(args: Column) -> Column:
    """What a command line asks for: help, one of COMMANDS with its input, or an error."""
    first, second = F.try_element_at(args, F.lit(1)), F.try_element_at(args, F.lit(2))
    helped = (F.size(args) == 0) | F.arrays_overlap(args, F.array(F.lit("-h"), F.lit("--help")))
    known = F.coalesce(first.isin(*COMMANDS), F.lit(False))
    piped = F.array_contains(args, "--stdout") & (first == "compress")
    error = (
        F.when(helped, F.lit(None))
        .when((first != "quick") & second.isNull(), "missing input path")
        .when(~known, F.concat(F.lit("unknown command: "), first))
        .when(piped & (second != "-"), "--stdout reads the PDF from stdin; pass - as the input path")
        .when(piped & flag_value(args, "--output-dir")["value"].isNotNull(), "--stdout writes to stdout; --output-dir is not combinable with it")
        .when((first == "compress") & (second == "-") & ~piped, "compress - reads the PDF from stdin; add --stdout")
    )
    return F.struct(F.when(helped, "help").when(error.isNull(), first).alias("command"), F.when(~helped & (first != "quick"), second).alias("input"), error.alias("error"))


def language(env: Mapping[str, str] | None = None) -> str:
    """zh or en, by LANG, or LC_ALL where that isn't set."""
    env = os.environ if env is None else env
    return "zh" if env.get("LANG", env.get("LC_ALL", "")).lower().startswith("zh") else "en"


def json_line(*columns: str | Column) -> Column:
    """A row as a line of JSON, fields without a value among it."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def top_lines(lines: Column, most: int = 3) -> Column:
    """The first lines, and how many more there are as one."""
    more = F.size(lines) - most
    return F.when(more > 0, F.array_append(F.slice(lines, 1, most), F.concat(F.lit("…and "), more.cast("string"), F.lit(" more")))).otherwise(lines)
