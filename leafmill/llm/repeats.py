"""Removal of long repeated byte strings, exact, over the whole corpus.

Every stretch of LENGTH bytes holds anchors: the least of the hashes of its GRAM-byte
strings. Equal stretches have equal anchors at equal places, so a stretch is repeated if
and only if one of its anchors stands elsewhere with the same bytes around it.

1. Anchors' hashes are counted. Those of one occurrence, most of them, are dropped.
2. The others' occurrences are put together with a hash of their context, the bytes that
   stretches over the anchor can reach. A context that occurs twice is repeated as a whole.
3. Contexts that occur once are compared with the other contexts of their anchor, each
   context once: for each offset, stretches with the same two hashes are the same. Anchors
   with more than LARGE contexts are compared by a distributed aggregation, others within
   a task, which so has at most LARGE contexts of an anchor.
4. Each document's repeated stretches are merged, and its other bytes kept.

Steps 2 to 4 read the documents again and shuffle only what a Bloom filter lets through.
Counts, contexts and stretches are combined before they are shuffled, so a passage that a
third of all documents share is no task's burden. See the README for what equal hashes
are worth, and for why the column-wise construction of suffix_bcr is not what runs here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bloom import bloom, maybe
from ._common import quoted, small_batches, stored, text_of
from ._windows import Moving, Rolling, U, anchors, mixed

LENGTH, GRAM = 200, 64
#: Anchors with more contexts than this are compared by aggregation.
LARGE = 100_000
#: Bytes of documents that are hashed at a time.
CHUNK = 1 << 20
_NO_ID = -(1 << 63)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _pieces(texts: list[bytes], length: int, gram: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Chunks of pieces of documents: (number of the document, bytes [lo, hi), grams [begin, end) that the
    piece is asked for). Long documents are cut; a piece reaches as far beyond as its anchors see."""
    reach, chunk, size = length - gram, [], 0
    for k, t in enumerate(texts):
        grams = len(t) - gram + 1
        for begin in range(0, grams, CHUNK) if len(t) >= length else ():
            end = min(begin + CHUNK, grams)
            lo, hi = max(0, begin - reach), min(len(t), end + reach + gram)
            if chunk and size + hi - lo > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((k, lo, hi, begin, end))
            size += hi - lo
    if chunk:
        yield chunk


def _anchored(texts: list[bytes], length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of documents, a chunk of them at a time: number of the document, place in it, hash,
    context hash, bytes of the context before and after, and the context's begin in raw."""
    reach = length - gram
    for pieces in _pieces(texts, length, gram):
        raw = np.frombuffer(b"".join(texts[k][lo:hi] for k, lo, hi, _, _ in pieces), np.uint8)
        roll = Rolling(raw)
        grams = roll.windows(gram)
        number, place, base, rest, at = [], [], [], [], 0
        for k, lo, hi, first, last in pieces:
            a = anchors(grams[at : at + hi - lo - gram + 1], reach + 1)
            a = a[(a >= first - lo) & (a < last - lo)]
            number.append(np.full(len(a), k))
            base.append(at + a)
            place.append(lo + a)
            rest.append(len(texts[k]) - gram - lo - a)
            at += hi - lo
        number, place, base, rest = (np.concatenate(x) for x in (number, place, base, rest))
        before, after = np.minimum(place, reach), np.minimum(rest, reach)
        begin = base - before
        context = mixed(roll.between(begin, begin + before + gram + after) + (before * (reach + 1) + after).astype(U))
        yield {"number": number, "place": place, "anchor": grams[base], "context": context, "before": before, "after": after, "begin": begin, "raw": raw}


def _identity(ids: list[int | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What a row of documents is known by: its id, and a hash of its text."""
    own = np.array([_NO_ID if x is None else x for x in ids], np.int64)
    return own, np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def repeated_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor: hashes of anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _anchored(_texts(b), length, gram):
                kinds, n = np.unique(x["anchor"], return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(kinds), pa.array(n, pa.int64())], ["anchor", "n"])

    return rows.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


_OCCURRENCE = "anchor long, context long, own long, text_hash long, place long, before int, after int"


def occurrences(rows: DataFrame, words, length: int, gram: int) -> DataFrame:
    """Occurrences of anchors that the filter (a broadcast one) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b)
            own, text_hash = _identity(b.column(0).to_pylist(), texts)
            for x in _anchored(texts, length, gram):
                ok = maybe(words.value, x["anchor"])
                number = x["number"][ok]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(x["anchor"][ok]), _signed(x["context"][ok]), pa.array(own[number], pa.int64()), _signed(text_hash[number]),
                        pa.array(x["place"][ok], pa.int64()), pa.array(x["before"][ok], pa.int32()), pa.array(x["after"][ok], pa.int32()),
                    ],
                    ["anchor", "context", "own", "text_hash", "place", "before", "after"],
                )

    return rows.mapInArrow(run, _OCCURRENCE)


_CONTEXT = "anchor long, context long, before int, after int, bytes binary"


def context_bytes(rows: DataFrame, words, large_words, large: bool, length: int, gram: int) -> DataFrame:
    """The bytes of contexts of the anchors that a filter lets through; of equal ones in a chunk, one.

    What the filter lets through too much is compared as well, which changes nothing: stretches
    that are found equal are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _anchored(_texts(b), length, gram):
                of_large = maybe(large_words.value, x["anchor"]) if large_words else False
                some = np.flatnonzero(maybe(words.value, x["anchor"]) & (of_large if large else ~np.asarray(of_large)))
                _, first = np.unique(x["context"][some], return_index=True)
                some = some[first]
                begin, size = x["begin"][some], x["before"][some] + gram + x["after"][some]
                data = x["raw"].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(x["anchor"][some]), _signed(x["context"][some]), pa.array(x["before"][some], pa.int32()), pa.array(x["after"][some], pa.int32()),
                        pa.array([data[a : a + n] for a, n in zip(begin.tolist(), size.tolist())], pa.binary()),
                    ],
                    ["anchor", "context", "before", "after", "bytes"],
                )

    return rows.mapInArrow(run, _CONTEXT)


def once_each(contexts: DataFrame) -> DataFrame:
    """One row of each context of an anchor, combined before it is shuffled."""
    return contexts.groupBy("anchor", "context").agg(*[F.first(c).alias(c) for c in ("before", "after", "bytes")])


def _offset_hashes(table: pa.Table, length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each offset, bytes by which a stretch begins before the anchor: rows in which such a
    stretch is whole, and two hashes of (anchor, offset, stretch).

    Contexts stand below each other with their anchors in a column, and the stretch moves on by
    one column at a time, so there is never more than a few numbers a row.
    """
    reach = length - gram
    before, after = (table.column(c).to_numpy().astype(np.int64) for c in ("before", "after"))
    anchor = table.column("anchor").to_numpy().view(np.uint64)
    rows = zip(before.tolist(), after.tolist(), table.column("bytes").to_pylist())
    flat = b"".join(bytes(reach - b) + x + bytes(reach - a) for b, a, x in rows)
    columns = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(len(before), 2 * reach + gram).T)
    moving = [Moving(columns, length, lane) for lane in (0, 1)]
    for d in range(reach, -1, -1):
        some = np.flatnonzero((before >= d) & (after >= reach - d))
        yield d, some, mixed(moving[0].hashes()[some] ^ mixed(anchor[some] + U(d))), moving[1].hashes()[some]
        if d:
            for m in moving:
                m.move()


_FOUND = "anchor long, context long, offset int"


def _compared(table: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """(anchor, context, offset) of stretches of which another context has an equal one."""
    rows, offsets = [], []
    for d, at, value, check in _offset_hashes(table, length, gram):
        order = np.argsort(value)
        same = value[order[1:]] == value[order[:-1]]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(some):
            continue
        # the few that agree in one hash are told apart by both
        order = order[some]
        order = order[np.lexsort((check[order], value[order]))]
        check = check[order]
        same = (value[order[1:]] == value[order[:-1]]) & (check[1:] == check[:-1])
        hit = at[order[np.append(same, False) | np.append(False, same)]]
        rows.append(hit)
        offsets.append(np.full(len(hit), d, np.int32))
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(table.column(c).to_numpy()[rows], pa.int64()) for c in ("anchor", "context")] + [pa.array(offsets, pa.int32())], ["anchor", "context", "offset"]
    )


def _runs_of_offsets(found: pa.RecordBatch) -> pa.RecordBatch:
    """Offsets of each context as runs: one row per run, [low, high]."""
    anchor, context, offset = (found.column(k).to_numpy() for k in range(3))
    order = np.lexsort((offset, context, anchor))
    anchor, context, offset = anchor[order], context[order], offset[order].astype(np.int64)
    new = np.ones(len(offset), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(offset))[: len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[first]), pa.array(context[first]), pa.array(offset[first], pa.int32()), pa.array(offset[last], pa.int32())], ["anchor", "context", "low", "high"]
    )


_RUN = "anchor long, context long, low int, high int"
#: Contexts compared at a time; whole anchors, so a large one may be more.
_AT_ONCE = 4_000


def _within_tasks(contexts: DataFrame, single_words, length: int, gram: int) -> DataFrame:
    def compared(t: pa.Table) -> pa.RecordBatch:
        found = _compared(t, length, gram)
        return _runs_of_offsets(found.filter(pa.array(maybe(single_words.value, found.column(1).to_numpy().view(np.uint64)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            if sum(x.num_rows for x in rest) < _AT_ONCE:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            anchor = t.column("anchor").to_numpy()
            cut = np.flatnonzero(anchor[1:] != anchor[:-1])
            if len(cut):
                yield compared(t.slice(0, int(cut[-1]) + 1))
                t = t.slice(int(cut[-1]) + 1)
            rest = t.to_batches()
        if rest:
            yield compared(pa.Table.from_batches(rest))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RUN)


def _by_aggregation(contexts: DataFrame, single_words, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts: each stretch's hash is a row, counted everywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            anchor, context = (t.column(c).to_numpy() for c in ("anchor", "context"))
            for d, rows, value, check in _offset_hashes(t, length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[rows], pa.int64()), pa.array(context[rows], pa.int64()), pa.array(np.full(len(rows), d), pa.int32()), _signed(value), _signed(check)],
                    ["anchor", "context", "offset", "value", "check"],
                )

    same = ["anchor", "offset", "value", "check"]
    rows = stored(contexts.mapInArrow(run, "anchor long, context long, offset int, value long, check long"), "stretches")
    twice = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hit = rows.join(stored(twice, "stretches-twice"), same, "left_semi")
    hit = hit.select("anchor", "context", "offset").repartition("anchor", "context")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _runs_of_offsets(b.filter(pa.array(maybe(single_words.value, b.column(1).to_numpy().view(np.uint64)))))

    return hit.sortWithinPartitions("anchor", "context", "offset").mapInArrow(merged, _RUN)


def covered(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE
) -> DataFrame:
    """own, text_hash, begin, end: byte ranges of repeated stretches, overlapping as they come, each once
    (rows repeated with their id and text have the same ones)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, id_col, text_col)
    again = stored(repeated_anchors(rows, length, gram), "repeated-anchors")
    words = spark.sparkContext.broadcast(bloom(again, "anchor"))
    found = stored(occurrences(rows, words, length, gram), "occurrences")
    words.unpersist()
    kinds = stored(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n")), "contexts")
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.count_if(F.col("n") == 1).alias("single"))
    asked = stored(per.where("contexts > 1 AND single > 0").select("anchor", "contexts"), "to-compare")
    share = spark.sparkContext.broadcast
    words, single = share(bloom(asked, "anchor")), share(bloom(kinds.where("n = 1"), "context"))
    most = asked.where(F.col("contexts") > large)
    large_words = None if most.isEmpty() else share(bloom(most, "anchor"))
    runs = _within_tasks(once_each(context_bytes(rows, words, large_words, False, length, gram)), single, length, gram)
    if large_words:
        runs = runs.unionByName(_by_aggregation(once_each(context_bytes(rows, words, large_words, True, length, gram)), single, length, gram))
    reach = length - gram
    none = F.lit(None).cast("int")
    status = stored(runs.unionByName(kinds.where("n > 1").select("anchor", "context", none.alias("low"), none.alias("high"))), "runs")
    part = found.join(status, ["anchor", "context"])
    whole = F.col("low").isNull()
    part = part.where(~whole | (F.col("before") + F.col("after") >= reach))
    begin = F.when(whole, F.col("place") - F.col("before")).otherwise(F.col("place") - F.col("high"))
    end = F.when(whole, F.col("place") + gram + F.col("after")).otherwise(F.col("place") - F.col("low") + length)
    return part.select("own", "text_hash", begin.alias("begin"), end.alias("end")).distinct()


_REMOVED = "doc_id long, n_bytes long, runs array<array<long>>, kept binary, kept_sha256 string"


def _union(begins: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """The union of ranges: begins and ends of what they cover, in order. Ranges that touch are one."""
    order = np.argsort(begins)
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.append(True, begins[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([begins[first], reach[np.append(first[1:], len(reach)) - 1]], axis=1).tolist()


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, large: int = LARGE, keep_text: bool = True
) -> DataFrame:
    """doc_id, n_bytes, runs, kept, kept_sha256: one row per row of docs.

    runs: the [begin, end) byte ranges removed, which are those covered by any length bytes that
    also start anywhere else, in the same document or another; kept: the other bytes (they may
    begin or end inside a character; None unless keep_text). Null texts are empty. Rows repeated
    with their id are repeats of each other like any others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spans = covered(docs, id_col, text_col, length, gram, large)
    spans = spans.groupBy("own", "text_hash").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    spans = stored(spans.select(F.col("own").alias("s_own"), F.col("text_hash").alias("s_hash"), "begins", "ends"), "spans")
    words = spark.sparkContext.broadcast(bloom(spans, "s_hash"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = _texts(b)
            own, text_hash = _identity(b.column(0).to_pylist(), texts)
            some = maybe(words.value, text_hash)
            if keep_text:
                some[:] = True
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(own, pa.int64()), _signed(text_hash), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([press.compress(t) if ok else None for t, ok in zip(texts, some)], pa.binary()),
                    pa.array([None if ok else hashlib.sha256(t).hexdigest() for t, ok in zip(texts, some)], pa.string()),
                ],
                ["doc_id", "own", "text_hash", "n_bytes", "packed", "sha256"],
            )

    texts = _rows(docs, id_col, text_col).mapInArrow(packed, "doc_id long, own long, text_hash long, n_bytes long, packed binary, sha256 string")
    both = texts.join(spans, (F.col("own") == F.col("s_own")) & (F.col("text_hash") == F.col("s_hash")), "left")
    both = both.select("doc_id", "n_bytes", "packed", "sha256", "begins", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out_runs, kept, sha = [], [], []
            for data, digest, begins, ends in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                runs = _union(begins.values.to_numpy(), ends.values.to_numpy()) if begins.is_valid else []
                out_runs.append(runs)
                if data is None:
                    kept.append(None)
                    sha.append(digest)
                    continue
                text, at, left = press.decompress(data), 0, []
                for a, z in runs:
                    left.append(text[at:a])
                    at = z
                left.append(text[at:])
                rest = b"".join(left)
                kept.append(rest if keep_text else None)
                sha.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out_runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "runs", "kept", "kept_sha256"],
            )

    return both.mapInArrow(cut, _REMOVED)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, from remove_repeats()."""
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r[1] - r[0])
    return found.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), "kept_sha256")
