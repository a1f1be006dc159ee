"""Queries over the supplied tables, with their SQL twins.

The tables hold no PDF files, so these put the engine's operators to the tables at hand: a
site is a document and its pages are pages; order lines stand for images of an order; and
so on. Each function takes (spark, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import presets, scalars
from leafmill.operators import batch, graph, images, scoring, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HOST = r"^[a-z]+://([^/?#]+)"
_PRESET_RATIO = "CASE {p} WHEN 'conservative' THEN 0.62 WHEN 'balanced' THEN 0.48 ELSE 0.34 END"


@_query(rf"""
WITH p AS (
  SELECT regexp_extract(url, '{_HOST}', 1) AS site, page_id, octet_length(encode(html)) AS size, html,
         length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x09-\x0D\x20]', '', 'g')) AS text_chars,
         len(regexp_extract_all(html, '<(?:img|script|style)')) AS image_refs,
         contains(html, '<p') AS has_text_ops, contains(html, '<b>') AS has_fonts,
         octet_length(encode(html)) - octet_length(encode(regexp_replace(html, '<[^>]*>', '', 'g'))) AS markup
  FROM pages
), n AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY site) AS t FROM p
), s AS (
  SELECT * FROM n WHERE t <= 24 OR i IN (SELECT round(k * (n.t - 1) / 23.0) FROM range(0, 24) AS r(k))
), g AS (
  SELECT site, count(*)::DOUBLE AS ins, sum(text_chars)::DOUBLE AS tc, count(*) FILTER (text_chars > 0)::DOUBLE AS pt,
         count(*) FILTER (has_text_ops)::DOUBLE AS po, count(*) FILTER (has_fonts)::DOUBLE AS pf,
         count(*) FILTER (image_refs > 0)::DOUBLE AS pi, sum(image_refs)::DOUBLE AS ir FROM s GROUP BY site
), d AS (
  SELECT site, sum(size)::BIGINT AS size, count(*) AS pc, sum(image_refs)::DOUBLE AS io, sum(markup)::BIGINT AS image_bytes FROM p GROUP BY site
), m AS (
  SELECT site, size, pc, image_bytes, size::DOUBLE / pc AS bpp, tc / ins AS tpp,
         CASE WHEN ir > 0 THEN ir / ins ELSE io / pc END AS ipp, greatest(pt, po, pf) / ins AS str, pi / ins AS ipr
  FROM d JOIN g USING (site)
), c AS (
  SELECT *, least(greatest(least(bpp, 180000.0) / 180000.0 * 45 + ipr * 35 + least(ipp, 3.0) / 3 * 20 - str * 10, 8.0), 99.0) AS cov,
         least(greatest((140 - least(tpp, 140.0)) / 140 * 45 + ipr * 25 + least(ipp, 2.5) / 2.5 * 15 + least(bpp, 240000.0) / 240000.0 * 25 - str * 30, 5.0), 99.0) AS conf
  FROM m
), k AS (
  SELECT *, conf >= 60 AND tpp < 110 AND ipr >= 0.35 AND str < 0.75 AS scanned,
         CASE WHEN conf >= 80 THEN 'maximum' WHEN conf >= 48 THEN 'balanced' ELSE 'conservative' END AS preset FROM c
)
SELECT site, size AS file_size_bytes, pc AS page_count, round(cov, 6) AS image_coverage, round(conf, 6) AS scanned_confidence, scanned AS is_likely_scanned,
       CASE WHEN tpp >= 120 AND str >= 0.6 AND ipr < 0.65 AND ipp < 1.25 THEN 'text-native' WHEN scanned THEN 'scan-heavy' ELSE 'mixed' END AS document_kind,
       preset AS recommended_preset,
       round(CASE WHEN size = 0 THEN 5.0 ELSE least(greatest((image_bytes * (1.0 - {_PRESET_RATIO.format(p="preset")}) + greatest(size - image_bytes, 0) * 0.05) / size * 100.0, 3.0), 85.0) END, 6) AS estimated_savings_percent
FROM k
""")
def analyze_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: score and classify each site from a sample of its pages."""
    bare = F.regexp_replace("html", "<[^>]*>", "")
    p = _read(spark, sf_dir, "pages").select(
        F.regexp_extract("url", _HOST, 1).alias("site"), "page_id", F.octet_length("html").alias("size"),
        F.length(F.regexp_replace(bare, r"[\x09-\x0D\x20]", "")).alias("text_chars"), F.regexp_count("html", F.lit("<(?:img|script|style)")).alias("image_refs"),
        F.contains("html", F.lit("<p")).alias("has_text_ops"), F.contains("html", F.lit("<b>")).alias("has_fonts"), F.lit(False).alias("failed"),
        (F.octet_length("html") - F.octet_length(bare)).alias("markup"),
    )
    whole = p.groupBy("site").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("page_count"), F.sum("image_refs").alias("image_objects"), F.sum("markup").alias("image_bytes"))
    signals = scoring.page_signals(scoring.even_sample(p, "site", ["page_id"]), "site")
    d = scoring.scored(whole.join(signals, "site"))
    savings = scoring.estimated_savings(F.col("recommended_preset"), F.col("image_bytes"), F.col("size"))
    return d.select(
        "site", F.col("size").alias("file_size_bytes"), "page_count", F.round("image_coverage", 6).alias("image_coverage"), F.round("scanned_confidence", 6).alias("scanned_confidence"),
        "is_likely_scanned", "document_kind", "recommended_preset", F.round(savings, 6).alias("estimated_savings_percent"),
    )


@_query("""
WITH n AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index, count(*) OVER (PARTITION BY source) AS page_total FROM documents
)
SELECT source, doc_id, page_index, page_total FROM n
WHERE page_total <= 24 OR page_index IN (SELECT round(k * (n.page_total - 1) / 23.0) FROM range(0, 24) AS r(k))
""")
def page_sample_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even sample of each source's documents."""
    docs = _read(spark, sf_dir, "documents").select("source", "doc_id")
    return scoring.even_sample(docs, "source", ["doc_id"])


@_query("""
SELECT doc_id AS duplicate, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS canonical FROM documents) WHERE doc_id <> canonical
""")
def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that equal an earlier one of their language, and that one."""
    docs = _read(spark, sf_dir, "documents")
    return graph.canonical(docs, [], ["lang", "text"], "doc_id")


@_query("""
WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS canonical FROM documents)
SELECT l.quality, c.canonical AS target, count(*) AS refs, sum(CASE WHEN c.canonical <> l.doc_id THEN 1 ELSE 0 END)::BIGINT AS moved
FROM labels l JOIN c ON l.doc_id = c.doc_id GROUP BY 1, 2
""")
def rewrite_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as references to documents, moved to the canonical ones."""
    docs = _read(spark, sf_dir, "documents")
    gone = graph.canonical(docs, [], ["lang", "text"], "doc_id")
    moved = graph.rewritten(_read(spark, sf_dir, "labels"), gone, [], "doc_id")
    changed = F.sum(F.when(F.col("new_target") != F.col("doc_id"), 1).otherwise(0))
    return moved.groupBy("quality", F.col("new_target").alias("target")).agg(F.count(F.lit(1)).alias("refs"), changed.alias("moved"))


@_query("""
SELECT doc_id, lang, n_chars FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang, text) AS canonical FROM documents) WHERE doc_id = canonical
""")
def pruned_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left when duplicates are deleted."""
    docs = _read(spark, sf_dir, "documents")
    return graph.without(docs, graph.canonical(docs, [], ["lang", "text"], "doc_id"), [], "doc_id").select("doc_id", "lang", "n_chars")


@_query("""
WITH s AS (
  SELECT source, list_sort(list(n_chars)) AS e FROM documents GROUP BY source
), b AS (
  SELECT source, e[round((len(e) - 1) * 0.75)::INTEGER + 1] AS base_edge FROM s
)
SELECT source, p.preset, base_edge,
       least(greatest(round(least(greatest(base_edge, 800.0), 3200.0) * p.f / 100.0) * 100.0, 800.0), 3200.0)::INTEGER AS edge_cap
FROM b, (VALUES ('conservative', 1.0), ('balanced', 0.85), ('maximum', 0.7)) AS p(preset, f)
""")
def p75_edge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended cap of each source for each preset, from the 75th percentile by nearest rank."""
    base = scoring.nearest_rank_edges(_read(spark, sf_dir, "documents"), "source", "n_chars")
    d = base.withColumn("preset", F.explode(F.array(*[F.lit(p) for p in presets.PRESETS])))
    return d.select("source", "preset", "base_edge", scoring.edge_cap(F.col("preset"), F.col("base_edge")).alias("edge_cap"))


def _image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as images: price is bytes, quantity and line number make the sides, flags the codec."""
    w, h = (F.col("l_quantity") * 40).cast("int"), (F.col("l_linenumber") * 90).cast("int")
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("num"), F.col("l_partkey").alias("mask"), F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").cast("long").alias("size"), scalars.longest_edge(w, h).alias("edge"), scalars.pixel_count(w, h).alias("pixels"),
        (F.col("l_returnflag") == "R").alias("jpeg"), (F.col("l_linestatus") == "O").alias("supported"), (F.col("l_discount") >= 0.09).alias("cmyk"),
        (F.col("l_tax") >= 0.07).alias("bilevel"),
    )


_IMAGES_SQL = """
img AS (
  SELECT l_orderkey AS doc, l_linenumber AS num, trunc(l_extendedprice)::BIGINT AS size,
         greatest(trunc(l_quantity * 40)::INTEGER, l_linenumber * 90) AS edge, trunc(l_quantity * 40)::BIGINT * (l_linenumber * 90) AS pixels,
         l_returnflag = 'R' AS jpeg, l_linestatus = 'O' AS supported, l_discount >= 0.09 AS cmyk, l_tax >= 0.07 AS bilevel, l_partkey AS mask, l_suppkey AS supp,
         CASE WHEN count(*) OVER (PARTITION BY l_orderkey) >= 24 THEN 6144 ELSE 65536 END AS small
  FROM lineitem
)"""


@_query(f"""
WITH {_IMAGES_SQL}, a AS (
  SELECT *, supported AND NOT cmyk AND NOT pixels <= 10000 AND NOT (jpeg AND size <= 6144)
            AND NOT (edge <= 1600 AND ((size <= small AND NOT bilevel) OR (jpeg AND pixels <= 250000))) AS actionable FROM img
)
SELECT doc, count(*) AS image_count, sum(size)::BIGINT AS image_bytes, sum(CASE WHEN actionable THEN size ELSE 0 END)::BIGINT AS actionable_bytes,
       count(*) FILTER (NOT supported) AS unsupported, max(edge) AS max_edge FROM a GROUP BY doc
""")
def actionable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which images of each order are worth recompressing, summed up."""
    rows = _image_lines(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    floor = images.small_floor(F.col("n"))
    c = F.col
    yes = images.actionable(c("jpeg"), c("supported"), c("size"), c("edge"), c("pixels"), F.lit(1600), floor, c("cmyk"), c("bilevel"))
    return images.summary(rows.withColumn("actionable", yes), "doc")


@_query(f"""
WITH {_IMAGES_SQL}, r AS (
  SELECT *, CASE WHEN edge <= 1600 AND size <= small AND NOT bilevel THEN 'already below target and unlikely to shrink meaningfully'
                 WHEN edge <= 1600 AND jpeg AND pixels <= 250000 THEN 'already near the requested target dimensions' END AS reason FROM img
), n AS (
  SELECT *, row_number() OVER (PARTITION BY supp ORDER BY doc, num, mask, size) AS nth FROM r WHERE reason IS NOT NULL
)
SELECT supp, reason, count(*) FILTER (nth <= 6) AS reported, count(*) FILTER (nth > 6) AS suppressed FROM n GROUP BY supp, reason
""")
def skip_reasons_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why images are skipped: the first six of each supplier are reported, the rest counted."""
    rows = _image_lines(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    c = F.col
    reason = images.skip_reason(c("size"), c("edge"), c("pixels"), F.lit(1600), images.small_floor(c("n")), c("jpeg"), c("bilevel"), F.lit(True))
    skips = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    told = images.reported_skips(skips, "supp", ["doc", "num", "mask", "size"])
    return told.groupBy("supp", "reason").agg(F.count_if("reported").alias("reported"), F.count_if(~F.col("reported")).alias("suppressed"))


@_query("""
SELECT l_orderkey AS doc, l_partkey AS mask, count(*) AS uses, count(*) > 1 AS shared FROM lineitem GROUP BY 1, 2
""")
def shared_mask_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as soft masks: those that several lines use are shared."""
    return images.mask_census(_image_lines(spark, sf_dir), ["doc"], "mask")


@_query(f"""
WITH {_IMAGES_SQL}
SELECT doc, num, mask, size FROM img WHERE NOT EXISTS (SELECT 1 FROM img i WHERE i.doc = img.doc AND i.mask = img.num)
""")
def images_without_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that aren't themselves the mask of an image of their document."""
    rows = _image_lines(spark, sf_dir)
    return images.without_masks(rows, ["doc"], "num", "mask").select("doc", "num", "mask", "size")


@_query("""
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)
""")
def unused_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared parts that no large line uses."""
    used = _read(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return graph.unused(_read(spark, sf_dir, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@_query("""
SELECT c_custkey, coalesce(bool_and(o_orderstatus <> 'P'), false) AS cleanable, count(o_orderkey) AS members
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def group_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers all of whose orders are settled; one that isn't vetoes, so does having none."""
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "P").alias("safe"))
    found = graph.unvetoed(_read(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "safe")
    return found.select("c_custkey", "cleanable", F.coalesce("members", F.lit(0)).alias("members"))


@_query("""
SELECT s_nationkey, min(bal) AS value, count(*) AS uses FROM (SELECT s_nationkey, (s_acctbal >= 0)::VARCHAR AS bal FROM supplier)
GROUP BY s_nationkey HAVING count(DISTINCT bal) = 1
""")
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for one value only; those with several are dropped."""
    s = _read(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") >= 0).cast("string").alias("bal"))
    return graph.unambiguous(s, [], "s_nationkey", "bal")


@_query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS value FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def inherit_up_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's own value, or its region's where it has none."""
    pages = _read(spark, sf_dir, "nation").select(F.lit(0).alias("doc"), "n_nationkey", F.col("n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("value"))
    up = _read(spark, sf_dir, "region").select(F.lit(0).alias("doc"), F.col("r_regionkey").alias("node"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("value"))
    return graph.inherited(pages, up, ["doc"], "n_nationkey").select("n_nationkey", "value")


@_query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_linenumber) % 97 AS dst FROM lineitem
), r(node, depth) AS (
  SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 97
)
SELECT node, min(depth) AS depth FROM r GROUP BY node
""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a root reaches over references, with the fewest hops. There are 97 nodes, so the SQL needn't go farther than that."""
    e = _read(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc"), F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 97).alias("dst")).distinct()
    roots = spark.range(1).select(F.lit(0).alias("doc"), F.lit(1).cast("long").alias("node"))
    return graph.reachable(e, roots, ["doc"]).select("node", "depth")


@_query("""
WITH f AS (
  SELECT o_orderpriority AS batch, CASE o_orderstatus WHEN 'F' THEN 'compressed' WHEN 'O' THEN 'notSmaller' ELSE 'failed' END AS status,
         trunc(o_totalprice)::BIGINT AS original, trunc(trunc(o_totalprice) * 0.6)::BIGINT AS compressed FROM orders
), k AS (
  SELECT *, CASE status WHEN 'compressed' THEN compressed WHEN 'notSmaller' THEN original END AS kept FROM f
)
SELECT batch, count(*) FILTER (status = 'compressed') AS files_compressed, count(*) FILTER (status = 'notSmaller') AS files_not_smaller,
       count(*) FILTER (status = 'failed') AS files_failed, coalesce(sum(original) FILTER (status <> 'failed'), 0)::BIGINT AS original_bytes,
       coalesce(sum(kept), 0)::BIGINT AS compressed_bytes,
       round(100.0 * (sum(original) FILTER (status <> 'failed') - sum(kept)) / sum(original) FILTER (status <> 'failed'), 4) AS savings_percent
FROM k GROUP BY batch
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch run's counts and bytes; failed files don't count in bytes."""
    status = F.when(F.col("o_orderstatus") == "F", "compressed").when(F.col("o_orderstatus") == "O", "notSmaller").otherwise("failed")
    f = _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("batch"), status.alias("status"), F.col("o_totalprice").cast("long").alias("original"), (F.col("o_totalprice").cast("long") * 0.6).cast("long").alias("compressed")
    )
    error = F.when(F.col("status") == "failed", F.lit("error.io"))
    results = f.select("batch", error.alias("error"), (F.col("status") == "compressed").alias("output_was_smaller"), F.col("original").alias("original_size_bytes"), F.col("compressed").alias("compressed_size_bytes"))
    g = batch.summary(results, ["batch"])
    return g.withColumn("savings_percent", F.round("savings_percent", 4)).drop("any_failed")


@_query("""
WITH i AS (
  SELECT o_orderpriority AS asked, CASE WHEN o_orderkey % 3 = 0 THEN 'maximum' WHEN o_orderkey % 3 = 1 THEN 'Light touch' ELSE NULL END AS preset,
         CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 130)::INTEGER END AS quality, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 9000)::INTEGER END AS px,
         CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 120)::INTEGER END AS pct FROM orders
), p AS (
  SELECT *, CASE WHEN preset = 'maximum' THEN 'maximum' WHEN preset IS NOT NULL THEN 'conservative' ELSE 'balanced' END AS name FROM i
), r AS (
  SELECT *, coalesce(CASE WHEN quality IS NOT NULL THEN least(greatest(quality, 10), 100) END, CASE name WHEN 'conservative' THEN 72 WHEN 'balanced' THEN 60 ELSE 46 END) AS image_quality,
         coalesce(CASE WHEN pct IS NOT NULL THEN least(greatest(pct, 5), 100) END, CASE name WHEN 'conservative' THEN 84 WHEN 'balanced' THEN 68 ELSE 52 END) AS percent FROM p
)
SELECT asked, name AS preset, CASE WHEN quality IS NULL THEN image_quality ELSE least(greatest(quality, 10), 100) END AS image_quality,
       CASE WHEN px IS NOT NULL THEN least(greatest(px, 100), 8000) ELSE least(greatest(round(3200.0 * percent / 100.0 / 100.0) * 100.0, 100.0), 8000.0) END::INTEGER AS max_image_size_px,
       name <> 'conservative' AS strip_metadata, name = 'maximum' AS subset_fonts, count(*) AS n
FROM r GROUP BY ALL
""")
def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of three layers resolved, clamped and counted."""
    k = F.col("o_orderkey")
    o = _read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("asked"), F.when(k % 3 == 0, "maximum").when(k % 3 == 1, "Light touch").alias("p"), F.when(k % 4 == 0, k % 130).alias("q"),
        F.when(k % 5 == 0, k % 9000).alias("px"), F.when(k % 2 == 0, k % 120).alias("pct"),
    )
    s = presets.resolve({"image_quality": F.col("q"), "max_image_size_px": F.col("px")}, {"preset": F.col("p"), "max_image_size_percent": F.col("pct")})
    keep = ("preset", "image_quality", "max_image_size_px", "strip_metadata", "subset_fonts")
    return o.select("asked", *[s[x].alias(x) for x in keep]).groupBy("asked", *keep).agg(F.count(F.lit(1)).alias("n"))


@_query("""
WITH e AS (
  SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source) AS total,
         coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM documents
)
SELECT source, count(*) FILTER (total - freed > 50000) AS evicted, (sum(n_chars) FILTER (total - freed <= 50000))::BIGINT AS left_bytes FROM e GROUP BY source
""")
def budget_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves a cache, largest first, until the rest fits the budget."""
    e = graph.evictions(_read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", ["doc_id"], 50_000)
    return e.groupBy("source").agg(F.count_if("evicted").alias("evicted"), F.sum(F.when(~F.col("evicted"), F.col("n_chars"))).alias("left_bytes"))


_SIZES = ("5MB", "500K", "1.5 GiB", "12", "-3MB", "7 parsecs", " 2 kb ", "", "0.5m", "1e3B")


@_query(
    "SELECT o_orderkey, t AS size_text, bytes FROM (SELECT o_orderkey, (o_orderkey % 10)::INTEGER AS k FROM orders) JOIN (VALUES "
    + ", ".join(f"({i}, '{t}', {b})" for i, (t, b) in enumerate(zip(_SIZES, (5242880, 512000, 1610612736, 12, "NULL", "NULL", 2048, "NULL", 524288, 1000))))
    + ") AS v(i, t, bytes) ON i = k"
)
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as people write them, in bytes."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(t) for t in _SIZES]), (F.col("o_orderkey") % 10 + 1).cast("int")).alias("size_text"))
    return o.withColumn("bytes", scalars.parse_size(F.col("size_text")))


@_query("""
WITH b AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT * (CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 4096 ELSE 0 END) + o_orderkey % 1024 AS n FROM orders)
SELECT o_orderkey, n AS bytes,
  CASE WHEN n >= 1073741824 THEN CASE WHEN n / 1073741824.0::DOUBLE < 10 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.0f GB', n / 1073741824.0::DOUBLE) END
       WHEN n >= 1048576 THEN CASE WHEN n / 1048576.0::DOUBLE < 10 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.0f MB', n / 1048576.0::DOUBLE) END
       WHEN n >= 1024 THEN CASE WHEN n / 1024.0::DOUBLE < 10 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.0f KB', n / 1024.0::DOUBLE) END
       ELSE n::VARCHAR || ' B' END AS human
FROM b
""")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as people read them."""
    k = F.col("o_orderkey")
    n = F.col("o_totalprice").cast("long") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 4096).otherwise(0) + k % 1024
    return _read(spark, sf_dir, "orders").select("o_orderkey", n.alias("bytes"), scalars.human_size(n).alias("human"))


@_query("""
WITH RECURSIVE d AS (
  SELECT doc_id, trunc(n_chars / 2)::BIGINT AS target, trunc(n_chars / 10)::BIGINT AS fixed, n_chars AS bytes, n_chars % 3000 + 500 AS max_edge FROM documents
), s AS (
  SELECT *, least(greatest(max_edge, 400), 65535) AS edge, 15 AS low, 100 AS high, 0 AS attempts, NULL::BIGINT AS best, NULL::INTEGER AS best_q, NULL::BIGINT AS best_e, NULL::BIGINT AS least, NULL::INTEGER AS least_q,
         NULL::BIGINT AS least_e, NULL::BIGINT AS last, NULL::BIGINT AS last_e, false AS last_fit FROM d
  UNION ALL
  SELECT doc_id, target, fixed, bytes, max_edge, e, CASE WHEN fits THEN q + 1 ELSE lo END, CASE WHEN blind THEN lo - 1 WHEN fits THEN hi ELSE q - 1 END, attempts + 1,
         CASE WHEN fits THEN n ELSE best END, CASE WHEN fits THEN q ELSE best_q END, CASE WHEN fits THEN e ELSE best_e END, CASE WHEN least IS NULL OR n < least THEN n ELSE least END,
         CASE WHEN least IS NULL OR n < least THEN q ELSE least_q END, CASE WHEN least IS NULL OR n < least THEN e ELSE least_e END, n, e, fits
  FROM (
    SELECT *, n <= target AS fits, coalesce(last_e = e AND last = n, false) AND NOT last_fit AND n > target AS blind FROM (
      SELECT *, fixed + floor(bytes * (0.2::DOUBLE + 0.8::DOUBLE * q / 100.0::DOUBLE) * r * r)::BIGINT AS n FROM (
        SELECT *, CASE WHEN attempts = 0 THEN hi ELSE (lo + hi) // 2 END AS q, least(e::DOUBLE / max_edge, 1.0::DOUBLE) AS r FROM (
          SELECT *, CASE WHEN low > high THEN greatest(edge * 3 // 4, 400) ELSE edge END AS e, CASE WHEN low > high THEN 15 ELSE low END AS lo, CASE WHEN low > high THEN 100 ELSE high END AS hi
          FROM s WHERE attempts < 12 AND NOT (low > high AND (best IS NOT NULL OR edge <= 400))
        )
      )
    )
  )
), last_state AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempts DESC) = 1
)
SELECT doc_id, target, coalesce(best_q, least_q)::INTEGER AS best_quality, coalesce(best_e, least_e)::INTEGER AS best_edge, coalesce(best, least) AS estimate, best IS NOT NULL AS met, attempts::INTEGER AS attempts FROM last_state
""")
def target_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best quality of each document for a budget of half its size, on a size that grows with quality and edge."""
    d = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") / 2).cast("long").alias("target"), (F.col("n_chars") / 10).cast("long").alias("constant"), F.col("n_chars").alias("bytes"), (F.col("n_chars") % 3000 + 500).alias("max_edge")
    )

    def size_at(q, e):
        edge = F.least(e.cast("double") / F.col("max_edge"), F.lit(1.0))
        return F.floor(F.col("bytes") * (0.2 + 0.8 * q / 100.0) * edge * edge)

    return search.bisect(d, "doc_id", size_at)


@_query("""
SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100
""")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest documents, in the order in which they would be worked on."""
    return _read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(*images.largest_first("n_chars", "doc_id")).limit(100)


@_query(r"""
WITH k AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
SELECT path, min(page_id) AS page_id FROM k WHERE trim(path) <> '' GROUP BY path
""")
def queue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue of paths, each at its first place only."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return graph.first_seen(p, "path", ["page_id"]).select("path", "page_id")


@_query("""
WITH f AS (
  SELECT p_partkey, p_type AS folder, p_name AS stem, CASE WHEN p_size % 2 = 0 THEN 'balanced' ELSE 'maximum' END AS preset FROM part
), n AS (
  SELECT *, row_number() OVER (PARTITION BY folder, stem, preset ORDER BY p_partkey) - 1 AS nth FROM f
)
SELECT p_partkey, CASE WHEN nth = 0 THEN stem || '__optimized-' || preset || '.pdf' WHEN nth <= 99 THEN stem || '__optimized-' || preset || '-' || nth || '.pdf' END AS output_name FROM n
""")
def output_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names without clashes."""
    f = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("folder"), F.col("p_name").alias("stem"), F.when(F.col("p_size") % 2 == 0, "balanced").otherwise("maximum").alias("preset"))
    return graph.output_names(f, "folder", "stem", "preset", ["p_partkey"]).select("p_partkey", "output_name")


@_query("""
WITH f AS (
  SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ['DCTDecode'] WHEN 1 THEN ['FlateDecode'] WHEN 2 THEN ['CCITTFaxDecode'] WHEN 3 THEN ['FlateDecode', 'DCTDecode']
                                    WHEN 4 THEN ['FlateDecode', 'JPXDecode'] ELSE ['Crypt'] END AS f, p_size % 6 AS k FROM part
)
SELECT p_partkey, k IN (0, 3) AS jpeg, k = 2 AS ccitt, k = 4 AS jpx, false AS jbig2, k NOT IN (4, 5) AS supported FROM f
""")
def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an image's chain of filters says about its codec."""
    kinds = (["DCTDecode"], ["FlateDecode"], ["CCITTFaxDecode"], ["FlateDecode", "DCTDecode"], ["FlateDecode", "JPXDecode"], ["Crypt"])
    chains = F.array(*[F.array(*[F.lit(x) for x in k]) for k in kinds])
    p = _read(spark, sf_dir, "part").select("p_partkey", F.element_at(chains, (F.col("p_size") % 6 + 1).cast("int")).alias("filters"))
    return p.select("p_partkey", *[v.alias(k) for k, v in images.filter_info(F.col("filters")).items()])


@_query("""
SELECT event_id, CASE WHEN event_id % 3 >= 1 OR v THEN v END AS cmyk_conversion,
       CASE WHEN event_id % 4 = 3 OR NOT coalesce(c IN ('jpeg', 'jpg'), false) THEN c END AS bilevel_codec
FROM (SELECT event_id, value > 10 AS v, CASE WHEN event_id % 5 = 0 THEN 'jpeg' WHEN event_id % 5 = 1 THEN 'g4' END AS c FROM events) t
""")
def config_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration values of old versions, brought up to the current one."""
    k = F.col("event_id")
    e = _read(spark, sf_dir, "events").select("event_id", (k % 3 + 1).alias("va"), (k % 4).alias("vb"), (F.col("value") > 10).alias("v"), F.when(k % 5 == 0, "jpeg").when(k % 5 == 1, "g4").alias("c"))
    return e.select("event_id", presets.migrated_cmyk(F.col("va"), F.col("v")).alias("cmyk_conversion"), presets.migrated_bilevel(F.col("vb"), F.col("c")).alias("bilevel_codec"))


@_query("""
WITH d AS (SELECT event_id, trunc(value * 10000)::BIGINT AS ms FROM events)
SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms / 1000.0::DOUBLE < 60 THEN printf('%.1f s', ms / 1000.0::DOUBLE)
       ELSE printf('%d min %02d s', (ms // 60000)::INTEGER, round(ms / 1000.0::DOUBLE - (ms // 60000) * 60)::INTEGER) END AS took
FROM d
""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds as people read them."""
    return _read(spark, sf_dir, "events").select("event_id", scalars.format_duration((F.col("value") * 10000).cast("long")).alias("took"))


@_query("""
SELECT user_id, event_id, (coalesce(lead(event_id) OVER w, -1) = -1) AS last_of_user, count(*) OVER (PARTITION BY user_id) AS events_of_user
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def job_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in the order of each queue, the last one marked."""
    w = Window.partitionBy("user_id")
    nxt = F.lead("event_id").over(w.orderBy("ts", "event_id"))
    return _read(spark, sf_dir, "events").select("user_id", "event_id", nxt.isNull().alias("last_of_user"), F.count(F.lit(1)).over(w).alias("events_of_user"))


@_query(f"""
WITH {_IMAGES_SQL}
SELECT doc, count(*) AS tasks, max(pixels * 3)::BIGINT AS largest,
       CASE WHEN count(*) < 3 THEN 1 ELSE greatest(least(count(*), 7, 8, greatest(floor(1073741824.0 / greatest(max(pixels * 3), 1)), 1)), 1) END::INTEGER AS workers
FROM img GROUP BY doc
""")
def image_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images of a document to decode at once."""
    size = images.decoded_estimate(F.col("pixels"), F.col("size"), F.lit(False), F.lit(False))
    g = _image_lines(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("tasks"), F.max(size).alias("largest"))
    return g.withColumn("workers", scalars.worker_count(F.col("tasks"), F.lit(8), F.col("largest")))


@_query("""
WITH RECURSIVE e AS (
  SELECT user_id, ts, event_id, row_number() OVER w AS nth, row_number() OVER w * 100.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), r AS (
  SELECT user_id, ts, event_id, nth, percent, percent >= 3 OR percent >= 100 AS told, CASE WHEN percent >= 3 OR percent >= 100 THEN percent ELSE 0.0::DOUBLE END AS last FROM e WHERE nth = 1
  UNION ALL
  SELECT e.user_id, e.ts, e.event_id, e.nth, e.percent, e.percent - r.last >= 3 OR e.percent >= 100, CASE WHEN e.percent - r.last >= 3 OR e.percent >= 100 THEN e.percent ELSE r.last END
  FROM r JOIN e ON e.user_id = r.user_id AND e.nth = r.nth + 1
)
SELECT user_id, ts, event_id, percent FROM r WHERE told
""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's progress only steps of three points or more since the last reported one."""
    from leafmill.streaming.progress import throttled

    w = Window.partitionBy("user_id")
    e = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.row_number().over(w.orderBy("ts", "event_id")) * 100.0 / F.count(F.lit(1)).over(w)).alias("percent"))
    return throttled(e, "user_id", ["ts", "event_id"], "percent")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.sources import pdf_make

    # parsing is by far dearer than moving the texts: deal them to every core
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").repartition(2 * spark.sparkContext.defaultParallelism, "doc_id")
    return pdf_make.from_texts(docs, "doc_id", "text")


@_query(r"""
SELECT doc_id::VARCHAR AS doc_id, greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1)::INTEGER AS page_count,
       length(regexp_replace(text, '[ \n\r\t]', '', 'g'))::BIGINT AS text_chars
FROM documents
""")
def pdf_text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, parsed again: pages, and characters shown on all of them."""
    from leafmill.sources import pdf

    return pdf.facts(_made(spark, sf_dir), pages=None).select("doc_id", "page_count", "text_chars")


@_query(None)
def pdf_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, analysed."""
    from leafmill.sources import pdf

    return pdf.analyze(_made(spark, sf_dir))


@_query(None)
def pdf_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, rewritten: never larger than before."""
    from leafmill.sources import pdf

    return pdf.optimize(_made(spark, sf_dir)).drop("content", "skips", "notices")


@_query(r"""
SELECT doc_id::VARCHAR AS doc_id, (3 + 2 * greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1))::BIGINT AS objects,
       greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1)::BIGINT AS streams, (2 + 3 * greatest(ceil(len(string_split(text, chr(10))) / 50.0), 1))::BIGINT AS refs
FROM documents
""")
def pdf_object_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, as tables of objects and references, counted."""
    from leafmill.sources import pdf

    o = pdf.objects(_made(spark, sf_dir))
    return o.groupBy("doc_id").agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("kind") == "stream").alias("streams"), F.sum(F.size("refs")).alias("refs"))


from leafmill.plans import files, words  # noqa: E402, F401  these register their queries as well
