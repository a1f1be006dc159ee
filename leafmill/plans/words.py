"""Queries that put functions of texts, numbers, settings and runs to the supplied tables.

Where a function reads texts as people write them, a list of such texts is dealt over the rows
of a table; its SQL twin states what each has to give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import cli, messages, presets, records, scalars
from leafmill.operators import batch, images, search
from leafmill.plans.registry import _IMAGES_SQL, _image_lines, _query, _read


def _sql_text(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def _dealt_texts(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    """o_orderkey and text: the first of each case, dealt over the orders."""
    texts = F.array(*[F.lit(c[0]).cast("string") for c in cases])
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % len(cases)).cast("int")).alias("text"))


def _dealt_sql(cases: list[tuple], *columns: str) -> str:
    """The cases' other values as columns ('name type'), joined to the orders."""
    names = [c.split(" ", 1) for c in columns]
    rows = ", ".join(f"({i}, {', '.join(map(_sql_text, c[1:]))})" for i, c in enumerate(cases))
    picked = ", ".join(f"v.{n}::{k} AS {n}" for n, k in names)
    return f"SELECT o_orderkey, {picked} FROM orders JOIN (VALUES {rows}) AS v(i, {', '.join(n for n, _ in names)}) ON i = o_orderkey % {len(cases)}"


_LABELS = [
    ("Maximum", "maximum", "maximum", "mixed"), (" light touch ", "conservative", "conservative", "mixed"), ("AGGRESSIVE", "maximum", "maximum", "mixed"),
    ("Gentle", "balanced", "conservative", "mixed"), ("strong", "balanced", "maximum", "mixed"), (None, "balanced", "balanced", "mixed"),
    ("a scan", "balanced", "balanced", "scan-heavy"), ("Text", "balanced", "balanced", "text-native"), ("conservative", "conservative", "conservative", "mixed"), ("", "balanced", "balanced", "mixed"),
]


@_query(_dealt_sql(_LABELS, "preset VARCHAR", "label VARCHAR", "kind VARCHAR"))
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets and kinds of documents by what people call them."""
    d = _dealt_texts(spark, sf_dir, _LABELS)
    return d.select("o_orderkey", presets.preset_of("text").alias("preset"), presets.preset_of_label("text").alias("label"), presets.kind_of_label("text").alias("kind"))


_CODECS = [("g4", "g4", False), ("CCITT fax", "g4", False), ("jpeg", "jpeg", True), ("JPG", "jpeg", True), ("png", "g4", False), (None, "g4", False), ("jpeg or g4", "g4", False), (" jpg ", "jpeg", True)]


@_query(_dealt_sql(_CODECS, "codec VARCHAR", "dropped BOOLEAN"))
def bilevel_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bilevel codec that a text names, and whether an old configuration's choice of it is dropped."""
    d = _dealt_texts(spark, sf_dir, _CODECS)
    kept = presets.migrated_bilevel(F.lit(2), F.col("text"))
    old = F.coalesce(F.lower(F.trim("text")).isin("jpeg", "jpg"), F.lit(False))
    return d.select("o_orderkey", presets.bilevel_of("text").alias("codec"), (old & kept.isNull()).alias("dropped"))


_PHASES = [
    ("loading", "analyzing", "info", False), ("analyzing", "analyzing", "info", False), ("compressing", "compressing", "info", False), ("done", "completed", "info", False),
    ("cancelled", "cancelled", "info", True), ("warning", "compressing", "warning", False), ("error.Cancelled", "compressing", "info", True), ("success", "compressing", "success", False), ("complete", "completed", "info", False),
]


@_query(_dealt_sql(_PHASES, "status VARCHAR", "tone VARCHAR", "cancelled BOOLEAN"))
def progress_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a phase, a level and a code of the engine stand for in a user interface."""
    d, t = _dealt_texts(spark, sf_dir, _PHASES), F.col("text")
    return d.select("o_orderkey", records.workflow_status(t).alias("status"), records.tone(t).alias("tone"), records.is_cancellation(t, F.lit("")).alias("cancelled"))


_NUMBERS = [("12.5", 12.5, 12.5), ("-3", 0.0, None), ("250", 100.0, 250.0), ("99999", 100.0, 2048.0), ("0.01", 0.01, 0.1), ("x", 0.0, None), (None, 0.0, None), ("0", 0.0, None)]


@_query(_dealt_sql(_NUMBERS, "percent DOUBLE", "target DOUBLE"))
def numbers_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages and target sizes as they are taken over."""
    d = _dealt_texts(spark, sf_dir, _NUMBERS)
    return d.select("o_orderkey", records.percent(F.col("text").try_cast("double")).alias("percent"), records.target_megabytes(F.col("text")).alias("target"))


_PATHS = [("/a/b/c.pdf", "c.pdf", True), ("C:\\x\\y.PDF ", "y.PDF ", True), ("/a/b/", "/a/b/", False), ("plain.txt", "plain.txt", False), ("a\\b/c.Pdf", "c.Pdf", True), ("pdf", "pdf", False), (".pdf", ".pdf", True)]


@_query(_dealt_sql(_PATHS, "name VARCHAR", "pdf BOOLEAN"))
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files, and which of them are PDF files."""
    d, t = _dealt_texts(spark, sf_dir, _PATHS), F.col("text")
    return d.select("o_orderkey", scalars.file_name(t).alias("name"), scalars.is_pdf_path(t).alias("pdf"))


_LINES = [
    ("compress a.pdf --quality 50 --grayscale", "compress", "a.pdf", None, 50, None, None, True, None, "a.pdf", None),
    ("compress a.pdf --quality=500", "compress", "a.pdf", None, None, None, None, None, None, "a.pdf", "--quality got an invalid value: 500"),
    ("compress a.pdf --max-edge --grayscale", "compress", "a.pdf", None, None, None, None, True, None, "a.pdf", "--max-edge requires a value, but the next argument looks like a flag: --grayscale"),
    ("quick b.pdf --password --x c.pdf", "quick", None, None, None, None, None, None, None, "b.pdf,c.pdf", None),
    ("compress a.pdf --bilevel png", "compress", "a.pdf", None, None, None, "g4", None, None, "a.pdf", "--bilevel got an invalid value: png (expected g4 or jpeg)"),
    ("compress a.pdf --bilevel=jpeg --max-edge 1600 --convert-cmyk --no-convert-cmyk", "compress", "a.pdf", None, None, 1600, "jpeg", None, False, "a.pdf", None),
    ("quick a.pdf --preset", "quick", None, None, None, None, None, None, None, "a.pdf", "--preset requires a value"),
    ("analyze", None, None, "missing input path", None, None, None, None, None, "", None),
    ("draw a.pdf", None, "a.pdf", "unknown command: draw", None, None, None, None, None, "a.pdf", None),
    ("compress - --stdout --output-dir d", None, "-", "--stdout writes to stdout; --output-dir is not combinable with it", None, None, None, None, None, "-", None),
    ("compress -", None, "-", "compress - reads the PDF from stdin; add --stdout", None, None, None, None, None, "-", None),
    ("analyze a.pdf --help", "help", None, None, None, None, None, None, None, "a.pdf", None),
]


@_query(_dealt_sql(_LINES, "command VARCHAR", "input VARCHAR", "refused VARCHAR", "quality INTEGER", "edge INTEGER", "codec VARCHAR", "gray BOOLEAN", "cmyk BOOLEAN", "inputs VARCHAR", "error VARCHAR"))
def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What command lines ask for: commands, inputs, settings that they override, errors."""
    d = _dealt_texts(spark, sf_dir, _LINES).withColumn("args", F.split("text", " "))
    args = F.col("args")
    asked, (found, error) = cli.command(args), cli.overrides(args)
    return d.select(
        "o_orderkey", asked["command"].alias("command"), asked["input"].alias("input"), asked["error"].alias("refused"), found["image_quality"].alias("quality"), found["max_image_size_px"].alias("edge"),
        found["bilevel_codec"].alias("codec"), found["grayscale"].alias("gray"), found["cmyk_conversion"].alias("cmyk"), F.array_join(cli.inputs(F.slice(args, 2, 99))["inputs"], ",").alias("inputs"), error.alias("error"),
    )


_SIZES = [("compress a --target-size 5MB --password x", 5242880, None, "x"), ("compress a --target-size=1.5K", 1536, None, None), ("compress a --target-size many", None, "--target-size got an invalid value: many", None), ("compress a --password=--y", None, None, "--y")]


@_query(_dealt_sql(_SIZES, "target BIGINT", "error VARCHAR", "password VARCHAR"))
def size_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target sizes and passwords of command lines."""
    d = _dealt_texts(spark, sf_dir, _SIZES)
    args = F.split("text", " ")
    size = cli.size_flag(args)
    return d.select("o_orderkey", size["value"].alias("target"), size["error"].alias("error"), cli.password(args)["value"].alias("password"))


_QUEUES = [
    ('{"version":1,"entries":[{"sourcePath":"/a.pdf"},{"sourcePath":" "},{"sourcePath":"/b.pdf"}]}', "/a.pdf,/b.pdf", 2), ('[{"sourcePath":"/c.pdf"}]', "/c.pdf", 1), ('{"version":2,"entries":[{"sourcePath":"/a.pdf"}]}', "", 0),
    ("not json", "", 0), (None, "", 0), ('{"version":1}', "", 0),
]


@_query(_dealt_sql(_QUEUES, "paths VARCHAR", "entries INTEGER"))
def stored_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues as they were stored, read, written and read again."""
    again = records.stored_queue(records.queue_text(records.stored_queue(F.col("text"))))
    d = _dealt_texts(spark, sf_dir, _QUEUES).withColumn("q", again)
    return d.select("o_orderkey", F.array_join(F.transform("q", lambda e: e["sourcePath"]), ",").alias("paths"), F.size("q").alias("entries"))


@_query("""
SELECT event_id, user_id::VARCHAR AS id, event_id * 7 AS time, event_type || '/x' AS name, NULL::VARCHAR AS broken FROM events
""")
def queue_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a job store as lines, written and read again; what is no such line is none."""
    e = _read(spark, sf_dir, "events")
    line = records.encoded_meta(F.col("user_id").cast("string"), F.col("event_id") * 7, F.concat("event_type", F.lit("|x")))
    found = records.decoded_meta(line)
    return e.select("event_id", found["id"].alias("id"), found["time"].alias("time"), found["name"].alias("name"), records.decoded_meta(F.concat(F.lit("x|"), F.col("event_type")))["id"].alias("broken"))


@_query("""
WITH b AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT * (CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 8192 WHEN 2 THEN 40000 ELSE 0 END) + 2 * (o_orderkey % 512) + 1 AS n, o_totalprice / 10000.0 AS p FROM orders), s AS (
  SELECT *, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b
), v AS (
  SELECT *, n::DOUBLE / pow(1024, k) AS x, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' ELSE 'GB' END AS unit FROM s
)
SELECT o_orderkey, CASE WHEN k = 0 THEN n || 'B' ELSE printf('%.2f', x) || unit END AS short,
       CASE WHEN k = 0 THEN n || ' B' WHEN x >= 100 THEN printf('%.0f ', x) || unit WHEN x >= 10 THEN printf('%.1f ', x) || unit ELSE printf('%.2f ', x) || unit END AS long,
       CASE WHEN n % 3 = 0 THEN '--' WHEN floor(p) + 0.3 >= 10 THEN printf('%.0f%%', floor(p) + 0.3) ELSE printf('%.1f%%', floor(p) + 0.3) END AS share
FROM v
""")
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and percentages as different places show them."""
    k = F.col("o_orderkey")
    n = F.col("o_totalprice").cast("long") * F.when(k % 4 == 0, 2).when(k % 4 == 1, 8192).when(k % 4 == 2, 40000).otherwise(0) + 2 * (k % 512) + 1
    share = F.when(F.col("n") % 3 != 0, F.floor(F.col("o_totalprice") / 10000.0) + 0.3)
    d = _read(spark, sf_dir, "orders").withColumn("n", n)
    return d.select("o_orderkey", scalars.human_bytes(F.col("n")).alias("short"), scalars.format_bytes(F.col("n")).alias("long"), scalars.format_percent(share.cast("double")).alias("share"))


@_query("""
WITH i AS (
  SELECT l_orderkey, l_linenumber, trunc(l_quantity * 40)::INTEGER - 100 AS w, l_linenumber * 9000 AS h, trunc(l_extendedprice)::BIGINT AS size, (l_suppkey % 100 + 1)::INTEGER AS low, 100 AS high, (l_partkey % 3)::INTEGER AS nth FROM lineitem
)
SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 THEN greatest(w, h) END AS edge, CASE WHEN w > 0 THEN w::BIGINT * h END AS pixels, w BETWEEN 1 AND 65535 AND h BETWEEN 1 AND 65535 AND w::BIGINT * h <= 100000000 AS fits,
       least(greatest(coalesce(CASE WHEN w > 0 THEN greatest(w, h) END, 400), 400), 65535) AS start, greatest((h * 3) // 4, 400)::INTEGER AS shrunk,
       least(greatest(CASE WHEN nth = 0 THEN high ELSE (low + high) // 2 END, 15), 100)::INTEGER AS quality,
       CASE WHEN w <= 0 THEN size * 12 WHEN nth = 1 THEN w::BIGINT * h * 19 WHEN nth = 2 THEN w::BIGINT * h * 7 ELSE w::BIGINT * h * 3 END AS decoded,
       size >= 30000 AND h <= 18000 AS not_smaller,
       CASE WHEN nth = 0 THEN least(greatest(round(greatest(h, 1)::DOUBLE * low / 100.0 / 100.0) * 100.0, 100.0), 8000.0)::INTEGER ELSE 1600 END AS cap
FROM i
""")
def image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides, budgets, estimates and probes of images."""
    d = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).cast("int").alias("w0"), (F.col("l_linenumber") * 9000).alias("h"), F.col("l_extendedprice").cast("long").alias("size"),
        (F.col("l_suppkey") % 100 + 1).cast("int").alias("low"), F.lit(100).alias("high"), (F.col("l_partkey") % 3).cast("int").alias("nth"),
    ).withColumn("w", F.col("w0") - 100)
    w, h, size, nth = F.col("w"), F.col("h"), F.col("size"), F.col("nth")
    pixels = scalars.pixel_count(w, h)
    return d.select(
        "l_orderkey", "l_linenumber", scalars.longest_edge(w, h).alias("edge"), pixels.alias("pixels"), scalars.dims_in_budget(w, h).alias("fits"), search.start_edge(scalars.longest_edge(w, h)).alias("start"),
        search.shrunk_edge(h).alias("shrunk"), search.next_quality(nth, F.col("low"), F.col("high")).alias("quality"), images.decoded_estimate(pixels, size, nth == 1, nth == 2).alias("decoded"),
        images.not_smaller(size, F.lit(30_000), h, F.lit(18_000)).alias("not_smaller"), presets.document_cap(F.lit(1600), F.when(nth == 0, F.col("low")), h).alias("cap"),
    )


@_query(f"""
WITH {_IMAGES_SQL}, f AS (
  SELECT *, num % 7 = 0 AS is_mask, supp % 11 = 0 AS keyed, supp % 13 = 0 AS lost, supp % 17 = 0 AS matte FROM img
)
SELECT doc, num, mask, size, CASE WHEN is_mask THEN 'image mask' WHEN keyed THEN 'colour key mask' WHEN lost THEN 'soft mask not found' WHEN matte THEN 'soft mask with matte' WHEN NOT supported THEN 'unsupported filter'
       WHEN jpeg AND size <= 6144 THEN 'tiny image' WHEN pixels <= 10000 THEN 'trivial image' WHEN jpeg AND edge <= 1600 AND pixels <= 250000 THEN 'already near the requested target dimensions'
       WHEN jpeg AND edge <= 1728 AND size <= small / 2.0 THEN 'already compact for the target' WHEN edge <= 1600 AND (size <= small AND NOT bilevel OR jpeg AND pixels <= 250000) THEN 'already below target'
       WHEN cmyk THEN 'CMYK stays as it is' END AS gate
FROM f
""")
def image_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that each image fails."""
    from pyspark.sql import Window

    rows = _image_lines(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    c = F.col
    facts = {
        "is_mask": c("num") % 7 == 0, "color_key": c("supp") % 11 == 0, "mask_unresolved": c("supp") % 13 == 0, "matte": c("supp") % 17 == 0, "supported": c("supported"), "jpeg": c("jpeg"), "size": c("size"),
        "pixels": c("pixels"), "edge": c("edge"), "header_edge": c("edge"), "header_pixels": c("pixels"), "bilevel": c("bilevel"), "g4": F.lit(True), "cmyk": c("cmyk"), "converts_cmyk": F.lit(False),
    }
    return rows.select("doc", "num", "mask", "size", images.gates(facts, F.lit(1600), images.small_floor(c("n"))).alias("gate"))


@_query("""
SELECT event_id, 'file ' || user_id || ' of ' || event_type || ' {gone}' AS filled, 'note.' || (event_id % 3) AS code, CASE WHEN event_id % 3 = 0 THEN 'Known ' || user_id ELSE 'The plain text.' END AS text,
       CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 ELSE 3 END AS told FROM events
""")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled in, codes told in words, repeated notices left out."""
    e = _read(spark, sf_dir, "events").withColumn("values", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")))
    k = F.col("event_id")
    note = lambda c, t: F.struct(c.alias("code"), F.lit("info").alias("level"), F.col("values"), F.lit(t).alias("fallback"))
    notices = F.array(note(F.lit("a"), "x"), note(F.when(k % 4 == 1, "a").otherwise("b"), "x"), note(F.when(k % 4 == 0, "b").when(k % 4 == 1, "a").otherwise("c"), "x"), note(F.lit("a"), "x"))
    d = e.withColumns({"code": F.concat(F.lit("note."), (k % 3).cast("string")), "fallback": F.lit("The plain text."), "told": F.size(messages.messages(notices))})
    texts = spark.createDataFrame([("note.0", "Known {user}")], "code string, template string")
    found = records.localized(d, texts)
    return found.select("event_id", scalars.fill_template(F.lit("file {user} of {kind} {gone}"), F.col("values")).alias("filled"), "code", scalars.fill_template(F.col("text"), F.col("values")).alias("text"), "told")


@_query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'error.io' WHEN event_id % 3 = 1 THEN 'backend.unknown' ELSE 'own' END AS code, CASE WHEN event_id % 2 = 0 THEN 'warning' ELSE 'info' END AS level,
       CASE WHEN event_id % 3 = 0 THEN 'Disk ' || event_type WHEN event_id % 3 = 1 THEN 'The engine gave no reason.' ELSE 'plain' END AS body FROM events
""")
def engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and errors brought into the shape that is shown."""
    e, k = _read(spark, sf_dir, "events"), F.col("event_id")
    values = F.create_map(F.lit("what"), F.col("event_type"), F.lit("none"), F.lit(None).cast("string"))
    told = messages.message(F.when(k % 3 == 0, "error.io").when(k % 3 == 1, "").otherwise("own"), F.when(k % 2 == 0, "warning").otherwise("odd"), values, F.lit("plain"))
    error = F.struct(F.when(k % 3 == 0, "error.io").otherwise("error.x").alias("code"), values.alias("values"), F.when(k % 3 == 2, "plain").alias("fallback"))
    shown = messages.error_message(error, F.create_map(F.lit("error.io"), F.lit("Disk {what}")))
    return e.select("event_id", told["code"].alias("code"), told["level"].alias("level"), shown["body"].alias("body"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'built-in' END AS balanced, 2 AS n, o_orderkey % 2 = 0 AS same, CASE WHEN o_orderkey % 2 = 0 THEN 60 ELSE 46 END AS quality, '/out' AS folder,
       CASE WHEN o_orderkey % 5 <> 0 THEN 1600 END AS px, CASE WHEN o_orderkey % 5 = 0 THEN 'scanned' ELSE 'standard' END AS route FROM orders
""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles merged, compared, adopted, and turned into overrides."""
    k = F.col("o_orderkey")
    kind = "map<string,string>"
    built_in = F.create_map(F.lit("balanced"), F.lit("built-in"), F.lit("maximum"), F.lit("built-in"))
    own = F.when(k % 3 == 0, F.create_map(F.lit("balanced"), F.lit("own"), F.lit("unknown"), F.lit("own"))).otherwise(F.create_map().cast(kind))
    merged = records.merged_profiles(built_in, own)
    now = {"image_quality": F.lit(60), "grayscale": F.lit(None).cast("boolean"), "output_dir": F.lit("/out")}
    then = {"image_quality": F.when(k % 2 == 0, 60).otherwise(46), "grayscale": F.lit(None).cast("boolean"), "output_dir": F.lit("/other")}
    taken = records.adopted(now, {"image_quality": then["image_quality"], "output_dir": F.lit("/other")})
    over = presets.profile_overrides({"max_image_size_px": F.lit(1600), "max_image_size_percent": F.when(k % 5 == 0, 50), "output_dir": F.lit("/x")})
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", merged["balanced"].alias("balanced"), F.size(merged).alias("n"), records.same_settings(now, then).alias("same"), taken["image_quality"].alias("quality"), taken["output_dir"].alias("folder"),
        over["max_image_size_px"].alias("px"), records.route(F.when(k % 5 == 0, "scan-heavy").otherwise("mixed")).alias("route"),
    )


@_query("""
SELECT e.event_id, e.user_id, lag(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS after, CASE WHEN count(*) OVER (PARTITION BY e.user_id) <= 1 THEN 1 ELSE 2 END AS at_once
FROM events e WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_acctbal > 0)
""")
def job_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the users that are still there, each after the one before, and how many run at once."""
    live = _read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    e = records.retained(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), live, "user_id")
    e = records.allowed(e, live.withColumnRenamed("user_id", "u"), "user_id", "u")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return records.chained(e, "user_id", ["ts", "event_id"], "event_id").join(n, "user_id").select("event_id", "user_id", "after", records.concurrency(F.col("n"), F.lit(8)).alias("at_once"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of rewriting."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    size = F.col("o_totalprice").cast("long")
    error = F.when(status == "P", F.struct(F.lit("error.io").alias("code"), F.create_map().cast("map<string,string>").alias("values"), F.lit("x").alias("fallback")))
    skips = F.transform(F.sequence(F.lit(1), (k % 9 + 1).cast("int")), lambda i: F.struct(i.cast("int").alias("num"), F.lit("tiny image").alias("reason")))
    return _read(spark, sf_dir, "orders").select(
        k.cast("string").alias("doc_id"), F.col("o_orderpriority").alias("batch"), error.alias("error"), size.alias("original_size_bytes"), F.when(status == "F", (size * 0.6).cast("long")).otherwise(size + 10).alias("compressed_size_bytes"),
        (status == "F").alias("output_was_smaller"), F.when(k % 9 > 0, F.slice(skips, 1, (k % 9).cast("int"))).alias("skips"), (k % 9).cast("int").alias("images_skipped"), (k % 2).cast("int").alias("images_deduplicated"),
        F.lit(0).alias("bilevel_encoded"), (k % 3).cast("int").alias("streams_deduplicated"), F.lit(0).alias("resources_removed"), F.lit(0).alias("fonts_subsetted"), F.lit(0).alias("font_bytes_saved"), (k % 2 == 0).alias("metadata_removed"),
        F.lit(False).alias("was_encrypted"), (k % 5 == 0).alias("target_met"), F.lit(55).alias("quality"),
    )


@_query("""
SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_orderstatus = 'F' THEN trunc(o_totalprice)::BIGINT - trunc(trunc(o_totalprice) * 0.6)::BIGINT WHEN o_orderstatus = 'O' THEN 0 END AS saved_bytes,
       CASE WHEN o_orderstatus <> 'P' THEN 3 + (o_orderstatus = 'O')::INTEGER + least(o_orderkey % 9, 6) + (o_orderkey % 9 > 0)::INTEGER + (o_orderkey % 2 = 1)::INTEGER + (o_orderkey % 3 > 0)::INTEGER + (o_orderkey % 2 = 1)::INTEGER END::INTEGER AS notices,
       CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'targetSizeMet' ELSE 'targetSizeMissed' END WHEN o_orderstatus = 'O' THEN 'outputNotSmaller' END AS first_code
FROM orders
""")
def run_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of each file of a run."""
    found = batch.with_notices(_results(spark, sf_dir), {"preset": "balanced", "image_quality": 60}, 5_000_000)
    return found.select("doc_id", "saved_bytes", F.when(F.col("notices").isNotNull(), F.size("notices")).alias("notices"), F.try_element_at("notices", F.lit(1))["code"].alias("first_code"))


@_query("""
SELECT p_partkey, p_name FROM part WHERE trim(p_name) <> '' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)
""")
def existing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a queue whose file is there."""
    files = _read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("doc_id"))
    return batch.existing(_read(spark, sf_dir, "part").select("p_partkey", "p_name"), files, "p_partkey").select("p_partkey", "p_name")


@_query("""
SELECT * FROM (VALUES ('conservative', 72, 84, 2700, false, false), ('balanced', 60, 68, 2200, true, false), ('maximum', 46, 52, 1700, true, true)) AS v(preset, image_quality, max_image_size_percent, max_image_size_px, strip_metadata, subset_fonts)
""")
def preset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets."""
    return presets.preset_table(spark).drop("image_ratio", "edge_factor").select("preset", "image_quality", "max_image_size_percent", "max_image_size_px", "strip_metadata", "subset_fonts")




@_query("""
SELECT l_orderkey, count(*) AS streams, (CASE WHEN count(*) * 3 < 8 THEN 1 ELSE 7 END)::INTEGER AS workers, least(536870912, (max(l_partkey) * 1000000) // 8)::BIGINT AS most_bytes FROM (SELECT * FROM lineitem WHERE l_orderkey % 3 = 0) GROUP BY l_orderkey
""")
def device_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams at a time, with four for every line of an order, and bytes that a device reads."""
    g = _read(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("streams"), F.max("l_partkey").alias("p"))
    return g.select("l_orderkey", "streams", scalars.stream_workers(F.col("streams") * 3, F.lit(8)).alias("workers"), scalars.mobile_limit(F.col("p") * 1_000_000).alias("most_bytes"))


@_query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 72 END AS quality, CASE WHEN o_orderkey % 3 = 0 THEN 'g4' ELSE 'jpeg' END AS codec, o_orderkey % 5 = 0 AS gray, greatest((o_orderkey % 4)::INTEGER, 1) AS version, 1 AS presets FROM orders
""")
def sanitized_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles with every field filled in, and configurations of known presets."""
    k = F.col("o_orderkey")
    found = presets.sanitized_profile(
        {"image_quality": F.when(k % 2 == 0, 500), "bilevel_codec": F.when(k % 3 == 0, "g4"), "grayscale": F.when(k % 5 == 0, True)}, {"image_quality": F.lit(72)}
    )
    config = presets.sanitized_config((k % 4) + 0.2, F.create_map(F.lit("balanced"), F.lit("x"), F.lit("odd"), F.lit("y")))
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", found["image_quality"].alias("quality"), found["bilevel_codec"].alias("codec"), found["grayscale"].alias("gray"), config["version"].alias("version"), F.size(config["presets"]).alias("presets")
    )


@_query("""
WITH q AS (SELECT n_name AS path, 0 AS turn, n_nationkey AS nth FROM nation WHERE n_nationkey % 2 = 0), p AS (SELECT trim(n_name) AS path, 1 AS turn, n_nationkey + 100 AS nth FROM nation WHERE n_nationkey % 5 <> 1), u AS (SELECT * FROM q UNION ALL SELECT * FROM p)
SELECT path, turn, nth FROM u QUALIFY row_number() OVER (PARTITION BY path ORDER BY turn, nth) = 1
""")
def queue_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added to a queue: blank ones and those that are there already don't come again."""
    n = _read(spark, sf_dir, "nation")
    queue = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("path"), F.col("n_nationkey").alias("nth"))
    new = n.select(F.when(F.col("n_nationkey") % 5 == 1, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("path"), (F.col("n_nationkey") + 100).alias("nth"))
    return records.added(queue, new, order="nth")
