"""Queries that make PDF files and images of the supplied tables' rows and read them back.

What a file holds follows from its row, so that SQL can tell what has to be found in it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from leafmill.functions import aes, fax, jpeg, planes
from leafmill.plans.registry import _made, _query, _read
from leafmill.sources import pdf, pdf_make
from leafmill.sources.pdf_model import MAX_STREAM, Name, Ref, Stream, decoded, rc4


def _each(rows: DataFrame, one: Callable[..., tuple], schema: str) -> DataFrame:
    """A row of the schema for each row, from its values."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], schema=kinds)

    return rows.mapInArrow(run, schema)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")


def _files(rows: DataFrame, one: Callable[..., bytes]) -> DataFrame:
    """doc_id, content: a file for each row; its first column is the id."""
    return _each(rows, lambda *r: (str(r[0]), one(*r)), "doc_id string, content binary")


# ---- images of files

_GRAY, _RGB, _CMYK = Name(b"DeviceGray"), Name(b"DeviceRGB"), Name(b"DeviceCMYK")


def _image_file(key: int, _: str, size: int) -> bytes:
    """One image of a kind by key % 8, of sides by key and size; even keys have a soft mask."""
    w, h, kind = 80 + key % 60, 60 + size, key % 8
    flat = lambda n: zlib.compress(bytes(w * h * n), 1)
    mask = {"SMask": Ref(11)} if key % 2 == 0 else {}
    if kind in (0, 3):
        data = b"\xff\xd8 not decoded here \xff\xd9"
        made = pdf_make.image(w, h, data if kind == 0 else zlib.compress(data), [b"DCTDecode"] if kind == 0 else [b"FlateDecode", b"DCTDecode"], _RGB, **mask)
    elif kind == 2:
        made = pdf_make.image(w, h, b"\0", [b"CCITTFaxDecode"], _GRAY, DecodeParms={b"K": -1, b"Columns": w, b"Rows": h}, **mask)
        made.dict[b"BitsPerComponent"] = 1
    elif kind == 4:
        space = [Name(b"ICCBased"), Ref(12)]
        made = pdf_make.image(w, h, flat(4), [b"FlateDecode"], space, **mask)
    elif kind == 5:
        made = pdf_make.image(w, h, flat(3), [b"Crypt"], _RGB, **mask)
    elif kind == 7:
        made = pdf_make.image(w, h, flat(1), [b"FlateDecode"], [Name(b"Indexed"), _CMYK, 1, b"\0" * 8], **mask)
    else:
        made = pdf_make.image(w, h, flat(4 if kind == 6 else 1), [b"FlateDecode"], _CMYK if kind == 6 else _GRAY, **mask)
    more = {"o11": pdf_make.image(w, h, flat(1), [b"FlateDecode"], _GRAY)} if mask else {}
    return pdf_make.assembled(pdf_make.page_of([made], **more, o12=Stream({b"N": 4}, b"profile")))


_SHAPES = """
i AS (SELECT p_partkey::VARCHAR AS doc_id, p_partkey AS key, p_partkey % 8 AS kind, (80 + p_partkey % 60)::INTEGER AS w, (60 + p_size)::INTEGER AS h FROM part)"""


@_query(f"""
WITH {_SHAPES}
SELECT doc_id, 10 AS num, w::BIGINT AS width, h::BIGINT AS height, greatest(w, h)::BIGINT AS longest_edge, w::BIGINT * h AS pixels,
       CASE kind WHEN 0 THEN 'DCTDecode' WHEN 2 THEN 'CCITTFaxDecode' WHEN 3 THEN 'FlateDecode,DCTDecode' WHEN 5 THEN 'Crypt' ELSE 'FlateDecode' END AS filters,
       kind IN (0, 3) AS is_jpeg, kind <> 5 AS codec_supported, kind IN (4, 6, 7) AS cmyk_declared, kind = 2 AS bilevel_input, CASE WHEN key % 2 = 0 THEN 11 END AS smask_num, false AS is_smask
FROM i UNION ALL
SELECT doc_id, 11, w, h, greatest(w, h), w::BIGINT * h, 'FlateDecode', false, true, false, false, NULL, true FROM i WHERE key % 2 = 0
""")
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of images of many kinds in PDF files, soft masks among them."""
    f = pdf.facts(_files(_parts(spark, sf_dir), _image_file))
    x = f.select("doc_id", F.explode("images").alias("x")).select("doc_id", "x.*")
    return x.select("doc_id", "num", "width", "height", "longest_edge", "pixels", F.array_join("filters", ",").alias("filters"), "is_jpeg", "codec_supported", "cmyk_declared", "bilevel_input", "smask_num", "is_smask")


def _gated_file(key: int, _: str, size: int) -> bytes:
    """One image that a gate, by key % 8, keeps from being recompressed."""
    w, h, kind = 120 + key % 60, 100 + size, key % 8
    flat = lambda n: zlib.compress(bytes(w * h * n), 1)
    gray = lambda **more: pdf_make.image(w, h, flat(1), [b"FlateDecode"], _GRAY, **more)
    made = {
        0: lambda: gray(ImageMask=True), 1: lambda: gray(Mask=[0, 1]), 2: lambda: gray(SMask=Ref(99)), 3: lambda: gray(SMask=Ref(11)),
        4: lambda: pdf_make.image(w, h, b"x", [b"Crypt"], _RGB), 5: lambda: pdf_make.image(w, h, b"x" * 100, [b"DCTDecode"], _RGB),
        6: lambda: pdf_make.image(90, 90, zlib.compress(bytes(8100)), [b"FlateDecode"], _GRAY), 7: gray,
    }[kind]()
    mask = gray(Matte=[0])
    return pdf_make.assembled(pdf_make.page_of([made], o11=mask))


_REASONS = (
    "image mask", "colour key mask", "soft mask not found", "soft mask with matte", "unsupported filter", "tiny image", "trivial image", "already below target and unlikely to shrink meaningfully",
)


@_query(f"""
SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 8 {' '.join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(_REASONS))} END AS reason, 0 AS recompressed FROM part
""")
def pdf_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why images of PDF files stay as they are."""
    done = pdf.optimize(_files(_parts(spark, sf_dir), _gated_file), pdf.default_settings(max_image_size_px=1600))
    reason = F.filter("skips", lambda s: s["num"] == 10)
    return done.select("doc_id", F.try_element_at(reason, F.lit(1))["reason"].alias("reason"), F.col("images_recompressed").alias("recompressed"))


def _copies_file(key: int, name: str, size: int) -> bytes:
    """size % 5 + 1 equal images, an unused font, metadata, and long content that deflates."""
    n = size % 5 + 1
    one = pdf_make.image(120, 100, zlib.compress(bytes(12_000)), [b"FlateDecode"], _GRAY)
    objects = pdf_make.page_of([one] * n, name.encode("latin-1", "replace"))
    objects[3][b"Resources"][b"Font"][b"F2"] = Ref(6)
    objects[4] = Stream({}, objects[4].data + b" q Q" * 60)
    objects[1][b"Metadata"] = Ref(7)
    return pdf_make.assembled(objects | {6: {b"Type": Name(b"Font")}, 7: Stream({b"Type": Name(b"Metadata")}, b"<x/>"), 8: {b"Producer": b"me"}}, Info=Ref(8))


@_query("""
SELECT p_partkey::VARCHAR AS doc_id, (p_size % 5)::INTEGER AS images_deduplicated, 1 AS resources_removed, 1 AS streams_compressed, true AS metadata_removed, 0 AS images_recompressed, 1 AS images_skipped,
       true AS output_was_smaller, true AS smaller FROM part
""")
def pdf_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files rewritten: equal images merged, unused resources and metadata gone, streams deflated."""
    done = pdf.optimize(_files(_parts(spark, sf_dir), _copies_file), pdf.default_settings(max_image_size_px=1600))
    smaller = F.col("compressed_size_bytes") < F.col("original_size_bytes")
    return done.select("doc_id", "images_deduplicated", "resources_removed", "streams_compressed", "metadata_removed", "images_recompressed", "images_skipped", "output_was_smaller", smaller.alias("smaller"))


def _odd_file(key: int, name: str, size: int) -> bytes:
    objects = pdf_make.page_of([], b"some text")
    kind = key % 6
    if kind in (1, 2, 3):
        return pdf_make.locked(objects, {1: b"", 2: b"pw", 3: b"other"}[kind], 4)
    made = pdf_make.assembled(objects if kind != 4 else {1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2)}, 2: {b"Type": Name(b"Pages"), b"Kids": []}})
    return b"no file " + name.encode() if kind == 5 else made


@_query("""
SELECT p_partkey::VARCHAR AS doc_id, CASE p_partkey % 6 WHEN 3 THEN 'error.wrongPassword' WHEN 4 THEN 'error.pdfBuild' WHEN 5 THEN 'error.pdfBuild' END AS code,
       CASE WHEN p_partkey % 6 < 3 THEN p_partkey % 6 IN (1, 2) END AS unlocked, CASE WHEN p_partkey % 6 < 3 THEN 8 END::BIGINT AS text_chars FROM part
""")
def pdf_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files that open, with a password or without, and why others don't."""
    f = pdf.facts(_files(_parts(spark, sf_dir), _odd_file), password="pw")
    return f.select("doc_id", F.col("error.code").alias("code"), "unlocked", "text_chars")


@_query(r"""
SELECT doc_id::VARCHAR AS doc_id, greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1)::INTEGER AS page_count,
       length(regexp_replace(text, '[ \n\r\t]', '', 'g'))::BIGINT AS text_chars, true AS never_larger
FROM documents
""")
def pdf_keeps_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, rewritten and read again: pages and text are as they were."""
    done = pdf.optimize(_made(spark, sf_dir))
    size = done.select("doc_id", (F.octet_length("content") <= F.col("original_size_bytes")).alias("never_larger"))
    return pdf.facts(done.select("doc_id", "content"), pages=None).select("doc_id", "page_count", "text_chars").join(size, "doc_id")


@_query(r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1)::INTEGER AS pages FROM documents
), p AS (
  SELECT doc_id, pages, i // 50 AS page, sum(length(regexp_replace(line, '[ \n\r\t]', '', 'g'))) AS chars FROM l GROUP BY ALL
), s AS (
  SELECT * FROM p WHERE pages <= 24 OR page IN (SELECT round(k * (p.pages - 1) / 23.0) FROM range(0, 24) AS r(k))
), g AS (
  SELECT doc_id, pages, count(*) AS seen, sum(chars)::DOUBLE AS chars FROM s GROUP BY ALL
)
SELECT doc_id::VARCHAR AS doc_id, pages AS page_count, 0 AS image_object_count, CASE WHEN chars / seen >= 120 THEN 'text-native' ELSE 'mixed' END AS document_kind, false AS is_likely_scanned, 0::BIGINT AS max_image_edge_px,
       pages > 24 AS sampled, pages > 150 AS large, true AS no_images FROM g
""")
def pdf_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, analysed: what doesn't hang on the files' sizes."""
    a = pdf.analyze(_made(spark, sf_dir))
    has = lambda code: F.exists("notices", lambda n: n["code"] == code)
    return a.select(
        "doc_id", "page_count", "image_object_count", "document_kind", "is_likely_scanned", F.col("max_image_edge_px").cast("long").alias("max_image_edge_px"),
        has("sampledPages").alias("sampled"), has("largePageCount").alias("large"), has("noImages").alias("no_images"),
    )


@_query("""
SELECT n_nationkey::VARCHAR AS doc_id, 1 AS images_recompressed, 509::BIGINT AS width, 700::BIGINT AS height, 'DCTDecode' AS filters, true AS smaller FROM nation
""")
def pdf_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scanned page for each nation, of 800 by 1,100 pixels: rewritten, and what became of the image."""

    def one(key: int) -> bytes:
        y, x = np.mgrid[0:1100, 0:800]
        p = np.stack([np.sin(x / (9 + key)) * 50 + 128, np.cos(y / 23) * 60 + 128, (x + y) % 255], axis=-1)
        p = np.clip(p + np.random.default_rng(key).normal(0, 4, p.shape), 0, 255).astype(np.uint8)
        return pdf_make.assembled(pdf_make.page_of([pdf_make.image(800, 1100, zlib.compress(p.tobytes(), 1), [b"FlateDecode"], _RGB)]))

    rows = _read(spark, sf_dir, "nation").select("n_nationkey").repartition(2 * spark.sparkContext.defaultParallelism, "n_nationkey")
    done = pdf.optimize(_files(rows, one))
    told = done.select("doc_id", "images_recompressed", (F.col("compressed_size_bytes") < F.col("original_size_bytes") / 4).alias("smaller"))
    x = pdf.facts(done.select("doc_id", "content")).select("doc_id", F.explode("images").alias("x"))
    return x.select("doc_id", "x.width", "x.height", F.array_join("x.filters", ",").alias("filters")).join(told, "doc_id").select("doc_id", "images_recompressed", "width", "height", "filters", "smaller")


@_query("""
WITH l AS (
  SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents
), p AS (
  SELECT doc_id, greatest(ceil(len(lines) / 50.0), 1)::BIGINT AS pages, lines FROM l
), i AS (
  SELECT doc_id, pages, k, lines[k * 50 + 1 : k * 50 + 50] AS own FROM (SELECT doc_id, pages, lines, unnest(range(0, pages)) AS k FROM p)
), m AS (
  SELECT doc_id, pages, k, 25 + coalesce(list_sum(list_transform(own, lambda x: 15 + 2 * length(x))), 0)::BIGINT AS size, coalesce(list_sum(list_transform(own, lambda x: length(regexp_replace(x, '[ \t\n\r]', '', 'g')))), 0)::BIGINT AS chars FROM i
), s AS (
  SELECT *, pages <= 24 OR k IN (SELECT round(j * (m.pages - 1) / 23.0) FROM range(0, 24) AS r(j)) AS seen FROM m
), g AS (
  SELECT doc_id, pages, count(*) FILTER (seen) AS looked, sum(chars) FILTER (seen)::DOUBLE AS chars,
         -- the header, three objects, the list of pages, pages with their contents, the trailer
         (9 + 46 + 81 + 66 + length(pages::VARCHAR) + (pages - 1) + sum(length((4 + 2 * k)::VARCHAR) + 4)
          + sum(80 + length((4 + 2 * k)::VARCHAR) + length((5 + 2 * k)::VARCHAR)) + sum(45 + length((5 + 2 * k)::VARCHAR) + length(size::VARCHAR) + size)
          + 47 + length((4 + 2 * pages)::VARCHAR))::BIGINT AS bytes
  FROM s GROUP BY doc_id, pages
), c AS (
  SELECT *, bytes::DOUBLE / pages AS bpp, chars / looked AS tpp FROM g
), v AS (
  SELECT *, least(greatest(least(bpp, 180000.0::DOUBLE) / 180000.0::DOUBLE * 45 - 10, 8.0::DOUBLE), 99.0::DOUBLE) AS cov,
         least(greatest((140 - least(tpp, 140.0::DOUBLE)) / 140 * 45 + least(bpp, 240000.0::DOUBLE) / 240000.0::DOUBLE * 25 - 30, 5.0::DOUBLE), 99.0::DOUBLE) AS conf FROM c
), w AS (
  SELECT *, CASE WHEN conf >= 80 THEN 'maximum' WHEN conf >= 48 THEN 'balanced' ELSE 'conservative' END AS preset FROM v
)
SELECT doc_id::VARCHAR AS doc_id, bytes::DOUBLE AS file_size_bytes, pages::INTEGER AS page_count, round(conf, 6) AS scanned_confidence, round(cov, 6) AS image_coverage, preset AS recommended_preset, 5.0::DOUBLE AS estimated_savings_percent,
       (CASE preset WHEN 'maximum' THEN 1700 WHEN 'balanced' THEN 2200 ELSE 2700 END)::INTEGER AS recommended_max_image_size_px, (CASE preset WHEN 'maximum' THEN 46 WHEN 'balanced' THEN 60 ELSE 72 END)::INTEGER AS recommended_image_quality
FROM w
""")
def pdf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, analysed: sizes, scores and recommended settings."""
    a = pdf.analyze(_made(spark, sf_dir))
    return a.select(
        "doc_id", "file_size_bytes", "page_count", F.round("scanned_confidence", 6).alias("scanned_confidence"), F.round("image_coverage", 6).alias("image_coverage"), "recommended_preset",
        F.round("estimated_savings_percent", 6).alias("estimated_savings_percent"), "recommended_max_image_size_px", "recommended_image_quality",
    )


@_query("""
WITH f AS (SELECT p_partkey, 6 + p_size % 20 AS n, p_partkey % 2 AS kind, p_partkey % 5 = 0 AS unsafe FROM part), g AS (SELECT *, 1 + p_partkey % (n - 1) AS glyph FROM f)
SELECT p_partkey, n::INTEGER AS glyphs, CASE WHEN unsafe THEN 0 ELSE 1 END AS subsetted, (CASE WHEN unsafe THEN n WHEN kind = 0 AND glyph = n - 1 THEN 3 ELSE 2 END)::INTEGER AS kept FROM g
""")
def font_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded fonts of PDF files without the glyphs that nothing shows; a composed glyph keeps its part."""
    from leafmill.functions import fonts
    from leafmill.operators import pdf_rewrite
    from leafmill.sources.pdf_model import Document

    def one(key: int, _: str, size: int) -> tuple:
        n = 6 + size % 20
        glyph = 1 + key % (n - 1)
        more = {b"Annots": [{b"AP": {}}]} if key % 5 == 0 else None
        if key % 2 == 0:
            data = pdf_make.font_file(pdf_make.truetype(n), b"CIDFontType2", b"FontFile2", glyph.to_bytes(2, "big"), more)
        else:
            data = pdf_make.font_file(pdf_make.cff(n), b"CIDFontType0", b"FontFile3", (9 + glyph).to_bytes(2, "big"), more)
        doc = Document(data)
        done, _ = pdf_rewrite.subset_fonts(doc)
        found = decoded(doc.objects[Ref(8)])
        if key % 2 == 0:
            places, _, _ = fonts._outlines(found)
            kept = sum(b > a for a, b in zip(places, places[1:]))
        else:
            kept = sum(set(found[a:b]) != {14} for a, b in fonts.Cff(found).glyphs)
        return key, n, done, kept

    return _each(_parts(spark, sf_dir), one, "p_partkey long, glyphs int, subsetted int, kept int")


# ---- codecs


@_query("""
SELECT p_partkey, length(p_name)::INTEGER AS height, (list_sum(list_transform(range(1, length(p_name) + 1), lambda i: bit_count(ascii(p_name[i])))))::INTEGER AS black, true AS same, sha256(p_name) AS digest FROM part
""")
def fax_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as planes of eight columns, fax coded and decoded."""

    def one(key: int, name: str, _: int) -> tuple:
        plane = np.unpackbits(np.frombuffer(name.encode("latin-1", "replace"), np.uint8)).reshape(-1, 8).astype(bool)
        again = fax.decode_g4(fax.encode_g4(plane), 8, len(plane))
        return key, len(again), int(again.sum()), bool((again == plane).all()), hashlib.sha256(np.packbits(again).tobytes()).hexdigest()

    return _each(_parts(spark, sf_dir), one, "p_partkey long, height int, black int, same boolean, digest string")


@_query("""
SELECT p_partkey, length(p_name)::INTEGER AS height, (list_sum(list_transform(range(1, length(p_name) + 1), lambda i: bit_count(ascii(p_name[i])))))::INTEGER AS black, (p_partkey % 3)::INTEGER AS form, sha256(p_name) AS digest FROM part
""")
def fax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as planes, coded row by row in the three forms of one-dimensional fax data, and decoded."""

    def one(key: int, name: str, _: int) -> tuple:
        plane = np.unpackbits(np.frombuffer(name.encode("latin-1", "replace"), np.uint8)).reshape(-1, 8).astype(bool)
        marks, aligned = key % 3 == 1, key % 3 == 2
        again = fax.decode_g3(pdf_make.fax_lines(plane, marks, aligned), 8, len(plane), marks, aligned)
        return key, len(again), int(again.sum()), key % 3, hashlib.sha256(np.packbits(again).tobytes()).hexdigest()

    return _each(_parts(spark, sf_dir), one, "p_partkey long, height int, black int, form int, digest string")


#: Small images of 16 by 12 samples, as a JPEG 2000 codestream and as JBIG2 segments.
_JPX = (
    "ff4fff5100290000000000100000000c0000000000000000000000100000000c00000000000000000001070101ff52000c00000001000201010001ff5c000a4058585858585858"
    "ff90000a00000000003e0001ff93c3f00e06aff4e9f5b3e67286ff53cc088fc07ce1203e70801bf4ff7f0cbd800cc01f08700f9030369cf9408dc35e077fffd9"
)
_JBIG2 = "0000000030000100000013000000100000000c00000000000000000000000000000126000100000024000000100000000c0000000000000000000602fff5fddff983576f37132730ab163fffac"


@_query("""
SELECT r_regionkey, y::INTEGER AS y, x::INTEGER AS x, CASE WHEN r_regionkey % 2 = 0 THEN (x * 7 + y * 13) % 256 ELSE CASE WHEN (x // 3 + y // 2) % 3 = 0 THEN 0 ELSE 255 END END::INTEGER AS value
FROM region, range(0, 12) AS a(y), range(0, 16) AS b(x)
""")
def coded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small coded images in PDF files, decoded sample by sample."""
    from leafmill.operators import pdf_rewrite
    from leafmill.sources.pdf_model import Document

    def one(key: int) -> tuple:
        data, name = (bytes.fromhex(_JPX), b"JPXDecode") if key % 2 == 0 else (bytes.fromhex(_JBIG2), b"JBIG2Decode")
        doc = Document(pdf_make.assembled(pdf_make.page_of([pdf_make.image(16, 12, data, [name], _GRAY)])))
        space = pdf_rewrite.colour_space(doc, _GRAY, {})
        plane = pdf_rewrite.plane_of(doc, doc.objects[Ref(10)], pdf_rewrite.image_facts(doc, Ref(10), {}, {}), space)
        return key, plane.astype(int).tolist()

    d = _each(_read(spark, sf_dir, "region").select("r_regionkey"), one, "r_regionkey int, rows array<array<int>>")
    d = d.select("r_regionkey", F.posexplode("rows").alias("y", "row")).select("r_regionkey", "y", F.posexplode("row").alias("x", "value"))
    return d.select("r_regionkey", "y", "x", "value")


@_query("""
SELECT p_partkey, (8 + p_partkey % 24)::INTEGER AS width, 16 AS height, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END AS channels, ((p_size * 5) % 256)::INTEGER AS low, ((p_size * 5) % 256)::INTEGER AS high FROM part
""")
def jpeg_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain planes, JPEG coded and decoded: sizes as in their headers, values as they were."""

    def one(key: int, _: str, size: int) -> tuple:
        shape = (16, 8 + key % 24) + ((3,) if key % 2 else ())
        data = jpeg.encode(np.full(shape, size * 5 % 256, np.uint8), 75)
        w, h = jpeg.header_size(data)
        p = jpeg.decode(data)
        return key, w, h, 1 if p.ndim == 2 else p.shape[2], int(p.min()), int(p.max())

    return _each(_parts(spark, sf_dir), one, "p_partkey long, width int, height int, channels int, low int, high int")


@_query("""
SELECT doc_id, (doc_id % 6)::INTEGER AS chain, sha256(text) AS digest FROM documents WHERE text IS NOT NULL
""")
def stream_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as streams in chains of filters, decoded again."""

    def one(key: int | None, data: bytes, chain: int | None) -> tuple:
        # the limit is against files of others; these are known to be whole texts
        found = decoded(pdf_make.filtered(data, (chain or 0) % pdf_make.FILTERS), max(MAX_STREAM, 2 * len(data)))
        # rows of a predictor are filled up with zeros
        return key, chain, hashlib.sha256(found[: len(data)] if not any(found[len(data) :]) else found).hexdigest()

    # the remainder is SQL's: negative of a negative id, null of none
    chain = F.expr(f"doc_id % {pdf_make.FILTERS}").cast("int")
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary"), chain)
    return _each(docs, one, "doc_id long, chain int, digest string")


@_query("""
SELECT p_partkey, sha256(p_name) AS aes, sha256(p_name) AS rc4, length(p_name) // 16 * 16 + 16 AS size FROM part
""")
def ciphers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encrypted and decrypted by the ciphers of PDF files."""

    def one(key: int, name: str, size: int) -> tuple:
        secret, start = hashlib.md5(b"%d" % key).digest(), bytes(range(16))
        data = name.encode("latin-1", "replace")
        padded = data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
        locked = aes.encrypt_cbc(secret, start, padded)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return key, digest(aes.decrypt_cbc(secret, start, locked)), digest(rc4(secret, rc4(secret, data))), len(locked)

    return _each(_parts(spark, sf_dir), one, "p_partkey long, aes string, rc4 string, size long")


@_query("""
WITH i AS (SELECT p_partkey, (p_partkey * 37 % 256)::INTEGER AS a, (p_size * 5 % 256)::INTEGER AS b, (p_partkey * 11 % 256)::INTEGER AS c, (p_size * 3 % 256)::INTEGER AS d FROM part)
SELECT p_partkey, ((255 - a) * (255 - d) + 127) // 255 AS naive_red, (2126 * a + 7152 * b + 722 * c) // 10000 AS luma,
       floor(least(greatest(a + 1.402::DOUBLE * (c - 128), 0), 255) + 0.5)::INTEGER AS red, 255 - floor(least(greatest(a + 1.772::DOUBLE * (b - 128), 0), 255) + 0.5)::INTEGER AS yellow,
       a // 16 AS high_nibble, a % 16 AS low_nibble, a & 1 AS last_bit, (a % 4) * 9 AS looked_up, d AS resized,
       CASE WHEN a = b THEN 'Infinity'::DOUBLE ELSE round(10 * log10(65025.0::DOUBLE / ((a - b) * (a - b))), 6) END AS psnr,
       CASE WHEN a + 100 <= floor(300 * 1.08) THEN a + 100 ELSE greatest(round_even((a + 100) * 300.0::DOUBLE / greatest(a + 100, b + 50), 0), 1)::INTEGER END AS width,
       a = b AND b = c AS colourless
FROM i
""")
def plane_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, samples, palettes, sizes and differences of small planes."""

    def one(key: int, _: str, size: int) -> tuple:
        a, b, c, d = key * 37 % 256, size * 5 % 256, key * 11 % 256, size * 3 % 256
        px = lambda *x: np.array([[x]], np.uint8)
        flat = lambda x: np.full((4, 6), x, np.uint8)
        samples = planes.unpack(bytes([a]), 2, 1, 4)[0]
        palette = bytes(x for k in range(4) for x in (k * 9, k, k))
        told = planes.psnr(flat(a), flat(b))
        width = planes.target_size(a + 100, min(b + 50, a + 100), 300)[0]
        return (
            key, int(planes.naive_cmyk(px(a, b, c, d))[0, 0, 0]), int(planes.luma(px(a, b, c))[0, 0]), int(planes.from_ycc(*(np.array([[x]]) for x in (a, b, c)))[0, 0, 0]),
            int(planes.ycck_to_cmyk(px(a, b, c, d))[0, 0, 2]), int(samples[0]), int(samples[1]), int(planes.unpack(bytes([a]), 8, 1, 1)[0, 7]),
            int(planes.looked_up(np.array([[a % 4]]), palette, 3)[0, 0, 0]), int(planes.resized(flat(d), 3, 9)[4, 1]), round(told, 6), width, planes.colourless(px(a, b, c)),
        )

    schema = "p_partkey long, naive_red int, luma int, red int, yellow int, high_nibble int, low_nibble int, last_bit int, looked_up int, resized int, psnr double, width int, colourless boolean"
    return _each(_parts(spark, sf_dir), one, schema)


_CORNERS = ", ".join(f"({c}, {m}, {y}, {k}, {int(np.float64(r) * 255)}, {int(np.float64(g) * 255)}, {int(np.float64(b) * 255)})" for (c, m, y, k), (r, g, b) in planes.CMYK_TERMS)


@_query(f"""
SELECT p_partkey, r, g, b FROM part JOIN (VALUES {_CORNERS}) AS v(c, m, y, k, r, g, b) ON p_partkey % 2 = c AND p_partkey // 2 % 2 = m AND p_partkey // 4 % 2 = y AND p_partkey // 8 % 2 = k
""")
def ink_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full inks in every combination, as colours."""

    def one(key: int, _: str, size: int) -> tuple:
        p = planes.calibrated_cmyk(np.array([[[255 * (key >> i & 1) for i in range(4)]]], np.uint8))[0, 0]
        return (key, *(int(x) for x in p))

    return _each(_parts(spark, sf_dir), one, "p_partkey long, r int, g int, b int")


_PLANE = "SELECT vec_id, list_transform(embedding, lambda x: least(greatest(round_even(x::DOUBLE * 1000 + 128, 0), 0), 255)::INTEGER) AS v FROM embeddings"


def _square(embedding: list[float]) -> np.ndarray:
    """64 values as a plane of eight by eight."""
    return np.clip(np.rint(np.array(embedding, np.float64) * 1000 + 128), 0, 255).astype(np.uint8)[:64].reshape(8, 8)


@_query(f"""
SELECT vec_id, len(list_filter(v, lambda x: x > 24 AND x < 231)) <= 64 * 0.05 AS near_bilevel FROM ({_PLANE})
""")
def near_bilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of which at most a twentieth is neither near black nor near white."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _each(e, lambda key, v: (key, planes.near_bilevel(_square(v))), "vec_id long, near_bilevel boolean")


@_query(f"""
WITH d AS (
  SELECT vec_id, list_sum(list_transform([1, 5, 33, 37], lambda i: abs(v[i] - v[i + 1]) + abs(v[i] - v[i + 8])))::DOUBLE / 8 AS s FROM ({_PLANE})
)
SELECT vec_id, s AS detail, least(greatest(60 + CASE WHEN s < 8 THEN -12 WHEN s > 25 THEN 6 ELSE 0 END, 10), 100)::INTEGER AS round_quality FROM d
""")
def detail_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean step between neighbours of a plane, and the quality that it asks for."""
    from leafmill.functions import scalars

    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = _each(e, lambda key, v: (key, planes.detail(_square(v))), "vec_id long, detail double")
    return d.withColumn("round_quality", scalars.round_quality(F.lit(60), F.col("detail")).cast("int"))
