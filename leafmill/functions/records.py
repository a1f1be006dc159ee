"""Stored queues, messages and settings of user interfaces, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.presets import PRESETS, clamp

#: What builds of the engine can do, and which of it this one does.
FEATURES = {"cmykCms": True, "jpxDecode": True, "jbig2Decode": True, "fontSubset": True}
_ENTRY = "struct<sourcePath: string, settings: map<string, string>>"


def features(spark: SparkSession) -> DataFrame:
    """One row: the features of this build."""
    return spark.createDataFrame([tuple(FEATURES.values())], ", ".join(f"{k} boolean" for k in FEATURES))


# ---- queues


def stored_queue(text: Column) -> Column:
    """Entries of a queue that was stored as {"version": 1, "entries": [...]} or as a bare array;
    entries without a path are dropped, and what can't be read is an empty queue."""
    wrapped = F.from_json(text, f"struct<version: int, entries: array<{_ENTRY}>>", {"mode": "PERMISSIVE"})
    bare = F.from_json(text, f"array<{_ENTRY}>", {"mode": "PERMISSIVE"})
    found = F.when(F.ltrim(text).startswith("["), bare).when(wrapped["version"] == 1, wrapped["entries"])
    clean = F.filter(found, lambda e: F.coalesce(F.trim(e["sourcePath"]) != "", F.lit(False)))
    return F.coalesce(clean, F.array().cast(f"array<{_ENTRY}>"))


def queue_text(entries: Column) -> Column:
    """The text that stored_queue() reads."""
    return F.to_json(F.struct(F.lit(1).alias("version"), entries.alias("entries")))


def added(queue: DataFrame, paths: DataFrame, path: str = "path", order: str = "at") -> DataFrame:
    """queue (path, at) with paths behind it: trimmed, blank ones dropped, each path at its first place only."""
    clean = paths.select(F.trim(path).alias(path), order).where(F.col(path) != "")
    both = queue.select(path, F.lit(0).alias("turn"), order).unionByName(clean.withColumn("turn", F.lit(1)))
    first = both.groupBy(path).agg(F.min(F.struct("turn", order)).alias("first"))
    return first.select(path, F.col("first.turn").alias("turn"), F.col(f"first.{order}").alias(order))


def encoded_meta(ident: Column, time: Column, name: Column) -> Column:
    """'id|time|name'; bars in the name are replaced."""
    return F.concat_ws("|", ident, time.cast("string"), F.replace(name, F.lit("|"), F.lit("/")))


def decoded_meta(line: Column) -> Column:
    """id, time and name of such a line; null if it isn't one."""
    p = F.split(line, r"\|", 3)
    time = F.try_element_at(p, F.lit(2)).try_cast("bigint")
    ok = (F.size(p) == 3) & time.isNotNull() & (p[0] != "")
    return F.when(ok, F.struct(p[0].alias("id"), time.alias("time"), F.try_element_at(p, F.lit(3)).alias("name")))


# ---- messages


def distinct_notices(notices: Column) -> Column:
    """Notices without later ones of the same level, code and text, in order."""
    key = lambda n: F.struct(n["level"], n["code"], n["fallback"])
    keys = F.transform(notices, key)
    return F.filter(notices, lambda n, i: F.array_position(keys, key(n)) == i + 1)


def localized(notices: DataFrame, texts: DataFrame, code: str = "code", fallback: str = "fallback") -> DataFrame:
    """notices with text: that of texts (code, template) for its code, else the fallback."""
    t = texts.select(F.col("code").alias(code), "template")
    return notices.join(t, code, "left").withColumn("text", F.coalesce("template", fallback)).drop("template")


def is_cancellation(code: Column, text: Column) -> Column:
    return F.coalesce(F.contains(F.lower(code), F.lit("cancel")), F.lit(False)) | F.coalesce(F.contains(F.lower(text), F.lit("cancel")), F.lit(False))


def tone(level: Column, default: str = "info") -> Column:
    return F.when(level.isin("info", "success", "warning", "error"), level).otherwise(default)


def workflow_status(phase: Column) -> Column:
    """The state of a job that its progress phase stands for."""
    return F.when(phase.isin("loading", "analyzing"), "analyzing").when(phase.isin("done", "complete", "completed"), "completed").when(phase == "cancelled", "cancelled").otherwise("compressing")


def percent(x: Column) -> Column:
    """Progress between 0 and 100; 0 for what isn't a number."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), 0.0).otherwise(clamp(x.cast("double"), 0.0, 100.0))


# ---- settings


def target_megabytes(x: Column) -> Column:
    """A target size between 0.1 and 2,048; null for none, nothing or less."""
    v = x.try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), clamp(v, 0.1, 2048.0))


def same_settings(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two sets of settings are the same but for the output folder; unset equals unset."""
    out = F.lit(True)
    for k in sorted((a.keys() | b.keys()) - {"output_dir"}):
        out = out & a.get(k, F.lit(None)).eqNullSafe(b.get(k, F.lit(None)))
    return out


def merged_profiles(built_in: Column, own: Column) -> Column:
    """Maps of profiles by preset, the user's over the built-in ones; unknown presets go."""
    known = F.map_filter(own, lambda k, _: k.isin(*PRESETS))
    keep = F.map_filter(built_in, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(known), k), F.lit(False)))
    return F.coalesce(F.map_concat(keep, known), built_in)


def adopted(current: dict[str, Column], recommended: dict[str, Column]) -> dict[str, Column]:
    """Current settings with the recommended ones; folder and target size stay."""
    keep = ("output_dir", "target_size")
    return {k: current[k] if k in keep or k not in recommended else F.coalesce(recommended[k], current[k]) for k in current}


def route(kind: Column) -> Column:
    """How a job is run: scans always have images and streams worked on."""
    return F.when(kind == "scan-heavy", "scanned").otherwise("standard")


def concurrency(jobs: Column, cores: Column) -> Column:
    """How many jobs of a queue run at a time: one for one, else two where there are four cores or more."""
    return F.when(jobs <= 1, 1).otherwise(F.least(F.lit(2), F.greatest(F.lit(1), F.floor(cores / 2)))).cast("int")


def allowed(paths: DataFrame, written: DataFrame, path: str = "path", known: str = "output_path") -> DataFrame:
    """Paths that a run of this session wrote: those that may be opened or shown."""
    return paths.join(written.select(F.col(known).alias(path)), path, "left_semi")


def retained(metas: DataFrame, live: DataFrame, ident: str = "id") -> DataFrame:
    """Stored entries of jobs that are still alive."""
    return metas.join(live.select(ident), ident, "left_semi")


def chained(jobs: DataFrame, queue: str, order: list[str], ident: str = "id") -> DataFrame:
    """jobs with after: the job that has to end before, null for the first of a queue. A job runs even
    if the one before it failed."""
    before = F.lag(ident).over(Window.partitionBy(queue).orderBy(*order))
    return jobs.withColumn("after", before)
