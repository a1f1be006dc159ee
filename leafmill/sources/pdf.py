"""PDF files as DataFrames: reading, object and edge tables, analysis, optimisation.

A bad file is a row with an error, never a failed job. Parsing and codecs run in Arrow
batches; what is relational about the results stays in DataFrame functions.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.functions import presets
from leafmill.operators import batch, graph, images, pdf_rewrite, scoring
from leafmill.sources.pdf_model import MAX_FILE, Document, Name, PdfError, Ref, Stream, canonical, filters_of, operations, references

#: Texts of errors, by code.
ERRORS = {
    "missingInput": "The selected file does not exist.", "invalidPdfPath": "The selected file is not a PDF.", "inputTooLarge": "The selected file exceeds the processing limit.",
    "encryptedPdf": "The PDF is encrypted with an unsupported security handler.", "passwordRequired": "The PDF requires an open password.",
    "wrongPassword": "The supplied password did not unlock the PDF.", "io": "Filesystem operation failed.", "cancelled": "Compression cancelled.",
    "config": "Configuration operation failed.", "opener": "Failed to open the path.", "pdfBuild": "Failed to build the output PDF.",
}
MOBILE_LIMIT = 512 << 20
_ERROR = "struct<code: string, values: map<string, string>, fallback: string>"
_IMAGE = (
    "struct<num: int, bytes: bigint, width: bigint, height: bigint, longest_edge: bigint, pixels: bigint, filters: array<string>, is_jpeg: boolean,"
    " codec_supported: boolean, cmyk_declared: boolean, bilevel_input: boolean, smask_num: int, is_smask: boolean>"
)
_SIGNALS = ("inspected_pages", "text_chars", "pages_text", "pages_text_ops", "pages_fonts", "pages_images", "image_refs", "text_failures")
FACTS = f"doc_id string, size bigint, error {_ERROR}, page_count int, unlocked boolean, {', '.join(f'{s} bigint' for s in _SIGNALS)}, images array<{_IMAGE}>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), length, content of the PDF files below path, in any letter case of the suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_FILE).select(F.col("path").alias("doc_id"), "length", "content")


def read_limited(stream: BinaryIO, limit: int = MAX_FILE) -> bytes:
    """What a stream of unknown length holds; PdfError once it is more than limit, after one byte beyond."""
    data = stream.read(limit + 1)
    if len(data) > limit:
        raise PdfError("inputTooLarge", str(limit))
    return data


def preflight(files: DataFrame, limit: int = MOBILE_LIMIT) -> DataFrame:
    """files with preflight_error: too large, or no PDF header within the first 1,024 bytes."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    size = F.octet_length("content")
    return files.withColumn("preflight_error", F.when(size > limit, "inputTooLarge").when(~F.contains(head, F.lit("%PDF-")), "pdfBuild"))


def _error(code: str, detail: str = "") -> dict:
    return {"code": f"error.{code}", "values": {"detail": detail} if detail else {}, "fallback": ERRORS[code]}


def _opened(data: bytes | None, password: str | None) -> Document | dict:
    """The document, or the error that it is."""
    try:
        doc = Document(bytes(data or b""), password)
        return doc if doc.pages() else _error("pdfBuild", "no pages")
    except PdfError as e:
        return _error(e.code, e.detail)
    except (RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError, MemoryError) as e:
        return _error("pdfBuild", type(e).__name__)


def _text_size(doc: Document, content: bytes, fonts: dict) -> int:
    """Characters that text operators show, white space left out; two bytes each in composite fonts."""
    n, wide = 0, False
    for op, args in operations(content):
        if op == b"Tf" and args and isinstance(args[0], Name):
            wide = doc.dict_of(fonts.get(bytes(args[0]))).get(b"Subtype") == b"Type0"
        elif op in (b"Tj", b"TJ", b"'", b'"') and args:
            shown = args[-1] if isinstance(args[-1], list) else [args[-1]]
            for s in shown:
                if isinstance(s, bytes) and not isinstance(s, Name):
                    n += len(s) // 2 if wide else len(s) - sum(s.count(c) for c in (b" ", b"\n", b"\t", b"\r"))
    return n


def _page_images(doc: Document, res: dict) -> int:
    """Images among a page's objects and those of its forms, each once."""
    seen: set[int] = set()
    found: set[int] = set()
    todo = [res]
    while todo:
        for x in doc.dict_of(todo.pop().get(b"XObject")).values():
            o = doc.get(x)
            if not isinstance(o, Stream) or id(o) in seen:
                continue
            seen.add(id(o))
            if o.dict.get(b"Subtype") == b"Image":
                found.add(id(o))
            elif isinstance(doc.get(o.dict.get(b"Resources")), dict):
                todo.append(doc.get(o.dict[b"Resources"]))
    return len(found)


def sampled(n: int, size: int | None = scoring.SAMPLED_PAGES) -> list[int]:
    """Indexes of an even sample of n pages, or of all; halves round up."""
    return list(range(n)) if size is None or n <= size else sorted({int(i * (n - 1) / (size - 1) + 0.5) for i in range(size)})


def _signals(doc: Document, size: int | None) -> dict[str, int]:
    pages = doc.pages()
    out = dict.fromkeys(_SIGNALS, 0)
    for i in sampled(len(pages), size):
        _, page, up = pages[i]
        found = pdf_rewrite.resources_of(doc, page, up)
        res = found[1] if found else {}
        fonts, content = doc.dict_of(res.get(b"Font")), doc.content(page)
        refs = _page_images(doc, res)
        text = _text_size(doc, content, fonts) if content is not None else 0
        ops = text > 0 or content is not None and any(op in (b"Tj", b"TJ", b"'", b'"') for op, _ in operations(content))
        out["inspected_pages"] += 1
        out["text_chars"] += text
        out["pages_text"] += text > 0
        out["pages_text_ops"] += bool(ops)
        out["pages_fonts"] += bool(fonts)
        out["pages_images"] += refs > 0
        out["image_refs"] += refs
        out["text_failures"] += content is None
    return out


def facts(files: DataFrame, password: str | None = None, pages: int | None = scoring.SAMPLED_PAGES) -> DataFrame:
    """One row per file: signals of sampled pages (None: of all) and the images' facts, or an error."""

    def one(ident: str, data: bytes | None) -> dict:
        doc = _opened(data, password)
        row = {"doc_id": ident, "size": len(data or b"")}
        if isinstance(doc, dict):
            return row | {"error": doc}
        masks, aliases = pdf_rewrite.mask_uses(doc), pdf_rewrite.colour_aliases(doc)
        found = [pdf_rewrite.image_facts(doc, r, masks, aliases) for r, o in sorted(doc.objects.items()) if pdf_rewrite.is_image(o)]
        return row | {"page_count": len(doc.pages()), "unlocked": doc.unlocked, "images": found} | _signals(doc, pages)

    return _by_file(files, one, FACTS)


#: Rows and bytes of files that go to a worker at a time.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20


def _by_file(files: DataFrame, one, schema: str) -> DataFrame:
    """The row (or rows) of one(doc_id, content) for each file, a few files and a bounded amount of bytes at a time."""
    spark = files.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).upper().removesuffix("B")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for ident, data in zip(b.column(0).to_pylist(), b.column(1)):
                got = one(ident, data.as_py())
                rows += got if isinstance(got, list) else [got]
                size += len(data.as_py() or b"")
                if size > BATCH_BYTES:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    for r in rows:
        if r.get("error"):
            r["error"] = r["error"] | {"values": list(r["error"]["values"].items())}
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def analyze(files: DataFrame, settings: dict[str, Column] | None = None, password: str | None = None) -> DataFrame:
    """The analysis of each file: kind, scores, recommended settings, estimated savings, notices, error."""
    f = facts(files, password)
    found = F.coalesce("images", F.array())
    f = f.withColumns({"image_objects": F.size(found), "images": found})
    ok = F.col("error").isNull()
    d = scoring.scored(f)
    preset = settings["preset"] if settings and "preset" in settings else F.col("recommended_preset")
    edges = F.filter(F.transform("images", lambda x: x["longest_edge"]), lambda e: e.isNotNull())
    d = d.withColumn("edges", edges).withColumn("cap", scoring.recommended_edge(preset, F.col("edges")))
    cap = settings["max_image_size_px"] if settings and "max_image_size_px" in settings else F.col("cap")
    floor = images.small_floor(F.col("image_objects"))
    worth = lambda x: images.actionable(x["is_jpeg"], x["codec_supported"], x["bytes"], x["longest_edge"], x["pixels"], cap, floor, x["cmyk_declared"], x["bilevel_input"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + x["bytes"])
    d = d.withColumns({"actionable_bytes": total(F.filter("images", worth)), "unsupported": F.size(F.filter("images", lambda x: ~x["codec_supported"]))})
    savings = scoring.estimated_savings(preset, F.col("actionable_bytes"), F.col("size"))
    told = scoring.analysis_notices(
        F.col("inspected_pages"), F.col("page_count"), F.col("text_failures"), F.col("document_kind"), F.col("image_objects"), F.col("unsupported"),
        F.col("unlocked"), F.col("structure"), F.col("image_pages"), F.col("size"),
    )
    when = lambda c, name: F.when(ok, c).alias(name)
    return d.select(
        "doc_id", F.col("size").cast("double").alias("file_size_bytes"), "page_count", when(F.col("image_objects"), "image_object_count"), when(F.col("document_kind"), "document_kind"),
        when(F.col("scanned_confidence"), "scanned_confidence"), when(F.col("image_coverage"), "image_coverage"), when(savings, "estimated_savings_percent"),
        when(F.col("recommended_preset"), "recommended_preset"), when(F.coalesce(F.array_max("edges"), F.lit(0)), "max_image_edge_px"), when(F.col("cap"), "recommended_max_image_size_px"),
        when(presets.preset_default(F.col("recommended_preset"), lambda v: v[0]), "recommended_image_quality"), when(F.col("is_likely_scanned"), "is_likely_scanned"), when(told, "notices"), "error",
    )


_STATS = ("images_recompressed", "images_skipped", "images_deduplicated", "streams_deduplicated", "streams_compressed", "resources_removed", "fonts_subsetted", "font_bytes_saved", "bilevel_encoded")
RESULT = (
    f"doc_id string, error {_ERROR}, original_size_bytes bigint, compressed_size_bytes bigint, {', '.join(f'{s} int' for s in _STATS)}, metadata_removed boolean,"
    " skips array<struct<num: int, reason: string>>, was_encrypted boolean, target_met boolean, quality int, attempts int, output_was_smaller boolean, content binary"
)


def default_settings(preset: str = "balanced", **more) -> dict:
    """A preset's settings as plain values, with more of them replaced."""
    if preset not in presets.PRESETS:
        raise ValueError(f"no such preset: {preset}")
    quality, percent, strip, subset, _, _ = presets.PRESETS[preset]
    out = {
        "preset": preset, "image_quality": quality, "max_image_size_percent": percent, "max_image_size_px": None, "optimize_images": True, "compress_streams": True,
        "strip_metadata": strip, "grayscale": False, "bilevel_codec": "g4", "subset_fonts": subset, "converts_cmyk": False,
    } | more
    out["converts_cmyk"] = bool(out["converts_cmyk"] or out.pop("cmyk_conversion", False) or out["grayscale"])
    return out


def _capped(doc: Document, settings: dict) -> dict:
    """Settings with the size cap for this document."""
    if settings["max_image_size_px"]:
        return settings
    edges = [max(w, h) for o in doc.objects.values() if pdf_rewrite.is_image(o) and (w := pdf_rewrite.whole(o.dict.get(b"Width")) or 0) > 0 and (h := pdf_rewrite.whole(o.dict.get(b"Height")) or 0) > 0]
    edge = max(edges, default=presets.REFERENCE_EDGE)
    px = int(edge * settings["max_image_size_percent"] / 100 / 100 + 0.5) * 100
    return settings | {"max_image_size_px": min(max(px, presets.EDGE_RANGE[0]), presets.EDGE_RANGE[1])}


def optimize(files: DataFrame, settings: dict | None = None, target_bytes: int | None = None, password: str | None = None) -> DataFrame:
    """Each file rewritten: what was done, and the smaller of the two contents.

    With target_bytes the best quality that fits is searched for. Where the result is not smaller,
    the original's bytes are passed on and output_was_smaller is false.
    """
    chosen = settings or default_settings()

    def one(ident: str, data: bytes | None) -> dict:
        data = bytes(data or b"")
        row = {"doc_id": ident, "original_size_bytes": len(data)}
        doc = _opened(data, password)
        if isinstance(doc, dict):
            return row | {"error": doc}
        try:
            s = _capped(doc, chosen)
            out, stats = pdf_rewrite.optimize_to(doc, s, target_bytes) if target_bytes is not None else pdf_rewrite.optimize(doc, s)
        except PdfError as e:
            return row | {"error": _error(e.code, e.detail)}
        except (RecursionError, ValueError, TypeError, KeyError, IndexError, OverflowError, MemoryError) as e:
            return row | {"error": _error("pdfBuild", type(e).__name__)}
        smaller = len(out) < len(data)
        return row | stats | {"was_encrypted": doc.unlocked, "compressed_size_bytes": len(out), "output_was_smaller": smaller, "content": out if smaller else data}

    return batch.with_notices(_by_file(files, one, RESULT), chosen, target_bytes)


def optimize_recommended(files: DataFrame, password: str | None = None, **more) -> DataFrame:
    """Each file rewritten with the preset that its analysis recommends; files that don't open are rows with an error."""
    preset = analyze(files, password=password).select("doc_id", F.coalesce("recommended_preset", F.lit("balanced")).alias("preset_"))
    known = files.join(preset, "doc_id")
    parts = [optimize(known.where(F.col("preset_") == p), default_settings(p, **more), password=password) for p in presets.PRESETS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


OBJECTS = "doc_id string, num int, gen int, kind string, type string, subtype string, filters array<string>, canonical string, stream_len bigint, stream binary, refs array<struct<key_path: string, dst: int>>"
_KINDS = {type(None): "null", bool: "boolean", int: "integer", float: "real", Name: "name", bytes: "string", list: "array", dict: "dictionary", Stream: "stream", Ref: "reference"}


def _object_rows(ident: str, data: bytes | None, password: str | None) -> list[dict]:
    doc = _opened(data, password)
    if isinstance(doc, dict):
        return []
    rows = []
    for (num, gen), o in sorted(doc.objects.items()):
        d = o.dict if isinstance(o, Stream) else o if isinstance(o, dict) else {}
        name = lambda k, d=d: bytes(d[k]).decode("utf-8", "replace") if isinstance(d.get(k), Name) else None
        rows.append(
            {
                "doc_id": ident, "num": num, "gen": gen, "kind": _KINDS.get(type(o), "other"), "type": name(b"Type"), "subtype": name(b"Subtype"),
                "filters": [x.decode("latin-1") for x in filters_of(d)], "canonical": canonical(d if isinstance(o, Stream) else o).decode("latin-1"),
                "stream_len": len(o.data) if isinstance(o, Stream) else None, "stream": o.data if isinstance(o, Stream) else None,
                "refs": [{"key_path": k, "dst": n} for k, n in references(o)],
            }
        )
    return rows


def objects(files: DataFrame, password: str | None = None) -> DataFrame:
    """Every object of every file that opens, a row each."""
    return _by_file(files, lambda i, b: _object_rows(i, b, password), OBJECTS)


def edges(found: DataFrame) -> DataFrame:
    """doc_id, src, key_path, dst: the references of objects()."""
    return found.select("doc_id", F.col("num").alias("src"), F.explode("refs").alias("r")).select("doc_id", "src", "r.key_path", "r.dst")


def duplicate_streams(found: DataFrame) -> DataFrame:
    """Streams equal to an earlier one of their document."""
    return graph.canonical(found.where("kind = 'stream'"), ["doc_id"], ["canonical", "stream"], "num")


class PdfSource(DataSource):
    """spark.read.format("leafmill_pdf").load(path): the objects of PDF files, a partition per file.

    For paths that Python opens; read_files() and objects() go through Spark's own file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "leafmill_pdf"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.password = options["path"].removeprefix("file://"), options.get("password")

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(f"{self.path} isn't a path that Python opens; read_files() takes those of Spark's file systems")
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        found = [os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".pdf")]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        fields = ("doc_id", "num", "gen", "kind", "type", "subtype", "filters", "canonical", "stream_len", "stream", "refs")
        for r in _object_rows(partition.value, data, self.password):
            r["refs"] = [(x["key_path"], x["dst"]) for x in r["refs"]]
            yield tuple(r[k] for k in fields)


def write_outputs(results: DataFrame, path: str) -> None:
    """Results that are smaller, as a table of (doc_id, content), by Spark's commit protocol."""
    results.where("output_was_smaller").select("doc_id", "content").write.mode("overwrite").parquet(path)


def write_files(results: DataFrame, folder: str, preset: str) -> DataFrame:
    """doc_id, output_path, error: a row per result that is smaller, all written by the time this returns.

    Files go to a folder that executors reach. Names are settled before anything is written; a file
    is written beside its name and linked to it, which never replaces a file that is there, so
    none is ever half there or lost. Where another file has the name the next free one is taken; the
    hundredth clash, and whatever can't be written, is a row with an error. The part that was
    written goes in any case. A task that runs again finds its own files and leaves them.
    """
    spark = results.sparkSession
    stem = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.[pP][dD][fF]$", "")
    named = results.where("output_was_smaller").withColumns({"stem": stem, "preset": F.lit(preset), "folder": F.lit(folder)})
    named = graph.output_names(named, "folder", "stem", "preset", ["doc_id"]).select("doc_id", "stem", "output_name", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for f in frames:
            rows = [_written_file(folder, preset, *r) for r in zip(f["stem"], f["output_name"], f["content"])]
            yield pd.DataFrame({"doc_id": f["doc_id"], "output_path": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})

    told = f"{folder.rstrip('/')}/_outcomes-{uuid.uuid4().hex[:12]}"
    named.mapInPandas(run, f"doc_id string, output_path string, error {_ERROR}").write.parquet(told)
    return spark.read.parquet(told)


def _written_file(folder: str, preset: str, stem: str, name: str | None, data: bytes) -> tuple[str | None, dict | None]:
    """The path that data is at, or an error."""
    if name is None:
        return None, _error("io", "no free name")
    part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
    try:
        with open(part, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        clash = re.search(r"-(\d+)\.pdf$", name.removeprefix(f"{stem}__optimized-{preset}"))
        for k in range(int(clash[1]) if clash else 0, 100):
            path = os.path.join(folder, f"{stem}__optimized-{preset}{f'-{k}' if k else ''}.pdf")
            try:
                os.link(part, path)
                return path, None
            except FileExistsError:
                with open(path, "rb") as f:
                    if f.read() == bytes(data):
                        return path, None
        return None, _error("io", "no free name")
    except OSError as e:
        return None, _error("io", os.strerror(e.errno or 0))
    finally:
        if os.path.exists(part):
            os.remove(part)
