"""python -m leafmill analyze|compress|quick: one line of JSON, or the PDF itself.

  analyze FILE [--password P]
  compress FILE [--preset P] [--quality N] [--max-edge N] [--bilevel g4|jpeg] [--grayscale] [--subset-fonts]
           [--convert-cmyk|--no-convert-cmyk] [--keep-metadata] [--target-size S] [--output-dir D] [--password P]
  compress - --stdout ...    the PDF comes from stdin and goes to stdout, the summary to stderr
  quick FILE|FOLDER... [flags of compress]
Errors are a line of JSON on stderr; the exit status is 1 if anything failed.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill.functions import cli
from leafmill.operators import batch
from leafmill.sources import pdf
from leafmill.sources.pdf_model import PdfError


def _fail(message: str) -> int:
    print(json.dumps(pdf._error("config", message)), file=sys.stderr)
    return 1


def _settings(found: dict) -> dict:
    """Plain settings of an overrides row."""
    preset = found.pop("preset") or "balanced"
    chosen = {k: v for k, v in found.items() if v is not None and k != "output_dir"}
    return pdf.default_settings(preset, **chosen)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or {"-h", "--help"} & set(args):
        print(__doc__)
        return 0
    spark = spark or SparkSession.builder.master("local[*]").appName("leafmill").config("spark.ui.enabled", "false").getOrCreate()
    line = spark.createDataFrame([(args,)], "args array<string>")
    values, error = cli.overrides(F.col("args"))
    asked = line.select(
        cli.command(F.col("args")).alias("c"), cli.inputs(F.slice("args", 2, 1 << 20)).alias("i"), cli.password(F.col("args")).alias("p"), cli.size_flag(F.col("args")).alias("t"),
        F.struct(*[v.alias(k) for k, v in values.items()]).alias("o"), error.alias("e"),
    ).first()
    if wrong := asked.c.error or asked.e or asked.p.error or asked.t.error or asked.i.error:
        return _fail(wrong)
    found = asked.o.asDict()
    folder = found["output_dir"]
    preset = found["preset"] or "balanced"
    try:
        settings = _settings(found)
    except ValueError as e:
        return _fail(str(e))
    piped = asked.c.input == "-"
    paths = [r.path for r in batch.expanded(spark, asked.i.inputs).collect()] if asked.c.command == "quick" else [asked.c.input]
    rows = []
    for p in paths:
        try:
            if piped:
                data = pdf.read_limited(sys.stdin.buffer)
            else:
                with open(p, "rb") as f:
                    data = pdf.read_limited(f)
        except OSError as e:
            return _fail(f"{p}: {os.strerror(e.errno or 0)}")
        except PdfError as e:
            print(json.dumps(pdf._error(e.code, e.detail)), file=sys.stderr)
            return 1
        rows.append((p, len(data), bytearray(data)))
    files = spark.createDataFrame(rows, "doc_id string, length long, content binary")
    if asked.c.command == "analyze":
        out = pdf.analyze(files, password=asked.p.value)
        print(out.select(cli.json_line(*out.columns)).first()[0])
        return int(out.first().error is not None)
    done = pdf.optimize(files, settings, asked.t.value, asked.p.value).persist()
    told = done.drop("content").select(cli.json_line(*[c for c in done.columns if c != "content"]).alias("line"))
    if piped:
        print(told.first()[0], file=sys.stderr)
        row = done.first()
        if row.error is None:
            sys.stdout.buffer.write(bytes(row.content))
            sys.stdout.buffer.flush()
        return int(row.error is not None)
    failed = done.where("error IS NOT NULL").count()
    for name in {folder or os.path.dirname(p) or "." for p in paths}:
        mine = done if folder else done.where(F.regexp_replace("doc_id", "/?[^/]*$", "") == ("" if name == "." else name))
        failed += pdf.write_files(mine, name, preset).where("error IS NOT NULL").count()
    for r in told.collect():
        print(r.line)
    if asked.c.command == "quick":
        s = batch.summary(done)
        print(s.select(cli.json_line(*s.columns)).first()[0])
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
