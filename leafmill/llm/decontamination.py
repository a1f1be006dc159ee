"""Benchmark decontamination by a distributed positional inverted index.

The corpus is cut into segments of bounded size. A segment is one stored row: its
documents, its dictionary of terms and, for each term, the sorted list of positions
where it stands. Positions count words through the whole segment, with a gap between
documents, so that no phrase reaches from one into the next. Only terms of the test
items get lists, since no query reads others.

A query is answered segment by segment: of its terms the rarest there comes first, its
list shifted by the term's place in the phrase gives the candidates, and each further
list, shifted likewise, thins them out. What is left after the last is an exact phrase.
Test items come as broadcast blocks of at most block_bytes of text; there may be any
number of blocks. Nothing is shuffled but, with several blocks, a short row a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bloom import drop_rows
from ._common import quoted, small_batches, stored, text_of

WINDOW = 13
#: Words of a segment, after which the next begins. One longer document is one segment.
SEGMENT_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20
#: With more distinct terms in the test items than this, every term of the corpus is indexed.
MAX_TERMS = 2_000_000
SLOP = 6

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms array<binary>, ends array<int>, positions binary"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, letters and non-ASCII characters, A-Z lowered."""
    return text.translate(_FOLD).split()


class _Writer:
    """Collects documents of a segment."""

    def __init__(self, number: int, vocabulary: dict[bytes, int] | None, gap: int):
        self.number, self.known, self.gap = number, vocabulary, gap
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.own: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.next = 0

    def add(self, ident: int | None, text: bytes | None) -> None:
        found = words(text) if text else []
        self.ids.append(ident)
        self.counts.append(len(found))
        if self.known is None:
            own = self.own
            codes = np.fromiter((own.setdefault(w, len(own)) for w in found), np.int32, len(found))
            here = np.arange(len(found), dtype=np.int32)
        else:
            get = self.known.get
            codes = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
            here = np.flatnonzero(codes >= 0).astype(np.int32)
            codes = codes[here]
        self.terms.append(codes)
        self.at.append(here + self.next)
        self.next += len(found) + self.gap

    def row(self) -> dict:
        codes = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int32)
        at = np.concatenate(self.at) if self.at else codes
        order = np.argsort(codes, kind="stable")
        codes, at = codes[order], at[order]
        present, first = np.unique(codes, return_index=True)
        names = list(self.own) if self.known is None else list(self.known)
        return {
            "segment": self.number, "doc_ids": self.ids, "n_words": self.counts, "terms": [names[i] for i in present.tolist()],
            "ends": np.append(first[1:], len(codes)).astype(np.int32).tolist() if len(present) else [], "positions": at.astype(np.int32).tobytes(),
        }


_INDEX_ARROW = pa.schema(
    [
        ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("positions", pa.binary()),
    ]
)


def build_index(
    docs: DataFrame, terms: Iterable[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text",
    segment_words: int = SEGMENT_WORDS, gap: int = WINDOW + SLOP + 1,
) -> DataFrame:
    """The stored index: one row per segment. terms: those to keep lists of, all if None.

    Null texts have no words, null ids stay null, repeated rows are documents of their own. An empty
    table gives an empty index. An index of all terms answers any items; which are asked for is
    told by Queries.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(None if terms is None else {t: i for i, t in enumerate(sorted(set(terms)))})

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        done = 0
        now = _Writer(part, shared.value, gap)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                now.add(ident, text)
                if now.next >= segment_words:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_INDEX_ARROW)
                    done += 1
                    now = _Writer(part + done, shared.value, gap)
        if now.ids:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_INDEX_ARROW)

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return stored(rows.mapInArrow(segments, INDEX), "positions")


class Queries:
    """The windows of a block of test items, by length, as numbers of the block's terms."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        wanted: dict[tuple[int, ...], set[str]] = {}
        for ident, text in items:
            w = [self.terms.setdefault(t, len(self.terms)) for t in words(text)]
            for i in range(max(1, len(w) - window + 1)) if w else ():
                wanted.setdefault(tuple(w[i : i + window]), set()).add(ident)
        by: dict[int, list[tuple[int, ...]]] = {}
        for k in wanted:
            by.setdefault(len(k), []).append(k)
        self.groups = {n: (np.array(k, np.int32), [sorted(wanted[x]) for x in k]) for n, k in by.items()}


class Segment:
    """A stored segment, opened for queries."""

    def __init__(self, row: dict, queries: Queries):
        self.ids, self.counts = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.at = np.frombuffer(row["positions"], np.int32)
        ends = row["ends"]
        self.lo, self.hi = [0, *ends[:-1]], ends
        self.place = np.full(len(queries.terms) + 1, -1, np.int64)
        for i, t in enumerate(row["terms"]):
            if (q := queries.terms.get(t)) is not None:
                self.place[q] = i
        self.size = np.array([b - a for a, b in zip(self.lo, self.hi)], np.int64)
        self.queries = queries

    def starts_of_documents(self, gap: int) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts + gap)[:-1]]) if len(self.counts) else np.zeros(0, np.int64)

    def list_of(self, term: int) -> np.ndarray:
        i = self.place[term]
        return self.at[self.lo[i] : self.hi[i]]

    def phrase(self, query: np.ndarray) -> np.ndarray:
        """Positions where the phrase begins; lists are met from the rarest on."""
        order = np.argsort(self.size[self.place[query]], kind="stable")
        left = self.list_of(query[order[0]]) - order[0]
        for k in order[1:]:
            if not len(left):
                break
            own = self.list_of(query[k])
            i = np.searchsorted(own, left + k)
            left = left[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] == left + k)]
        return left.astype(np.int64)

    def near(self, query: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term around which, within span words either way, all others stand."""
        order = np.argsort(self.size[self.place[query]], kind="stable")
        left = self.list_of(query[order[0]]).astype(np.int64)
        for k in order[1:]:
            if not len(left):
                break
            own = self.list_of(query[k])
            i = np.searchsorted(own, left - span)
            left = left[(i < len(own)) & (own[np.minimum(i, len(own) - 1)] <= left + span)]
        return left

    def found(self, span: int | None = None) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """(length, item ids, begins of exact matches, anchors of near ones) per window with any."""
        none = np.zeros(0, np.int64)
        for n, (table, owners) in self.queries.groups.items():
            for i in np.flatnonzero((self.place[table] >= 0).all(axis=1)).tolist():
                exact = self.phrase(table[i])
                close = self.near(table[i], span) if span is not None else none
                if len(exact) or len(close):
                    yield n, owners[i], exact, close


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The test items, as (id as text, text), in blocks of at most block_bytes (or one item)."""
    block, size = [], 0
    for r in items.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")), text_of(text_col)).toLocalIterator():
        text = r[1].encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


def _vocabulary(items: DataFrame, id_col: str, text_col: str, block_bytes: int, most: int) -> set[bytes] | None:
    seen: set[bytes] = set()
    for block in item_blocks(items, id_col, text_col, block_bytes):
        for _, text in block:
            seen.update(words(text))
        if len(seen) > most:
            return None
    return seen


_FOUND = "segment long, nth int, doc_id long, n_words long, runs array<array<long>>, items array<string>"
_MATCH = "doc_id long, item_id string, kind string, begin long, end long"


def _summary(index: DataFrame, block, gap: int) -> DataFrame:
    """Per document: the runs of words inside matches, and the items with any."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*block.value)
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row, queries)
                first = seg.starts_of_documents(gap)
                length = int(first[-1] + seg.counts[-1] + 1) if len(first) else 0
                edge = np.zeros(length + 1, np.int32)
                items: dict[int, set[str]] = {}
                for n, owners, exact, _ in seg.found():
                    np.add.at(edge, exact, 1)
                    np.add.at(edge, exact + n, -1)
                    for d in np.unique(np.searchsorted(first, exact, "right") - 1).tolist():
                        items.setdefault(d, set()).update(owners)
                turns = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]]))
                begins, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
                runs: dict[int, list[list[int]]] = {}
                for d, a, b in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), stops.tolist()):
                    runs.setdefault(d, []).append([a - int(first[d]), b - int(first[d])])
                out = range(len(seg.ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(out), pa.int64()), pa.array(out, pa.int32()), pa.array(seg.ids, pa.int64()), pa.array(seg.counts, pa.int64()),
                        pa.array([runs.get(d, []) for d in out], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(items.get(d, ())) for d in out], pa.list_(pa.string())),
                    ],
                    ["segment", "nth", "doc_id", "n_words", "runs", "items"],
                )

    return index.mapInArrow(answer, _FOUND)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, max_terms: int = MAX_TERMS,
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """doc_id, n_words, runs, items: one row per row of docs.

    runs: [begin, end) word ranges inside any occurrence of a window of an item, merged and
    in order; items: sorted ids (as text) of items with such a window. A window is that many
    consecutive words, or the whole of a shorter item. Null texts have no words; null item ids
    are written as the empty text; items that are repeated, or share an id, count once. Empty
    tables give no rows, or rows without matches.
    """
    spark = docs.sparkSession
    gap = window + SLOP + 1
    index = build_index(docs, _vocabulary(items, item_id_col, item_text_col, block_bytes, max_terms), id_col, text_col, segment_words, gap)
    out, n = None, 0
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        if n == 1:
            out = stored(out, "block")
        shared = spark.sparkContext.broadcast((block, window))
        part = _summary(index, shared, gap)
        n += 1
        if n > 1:
            part = stored(part, "block")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _summary(index, spark.sparkContext.broadcast(([], window)), gap)
    if n > 1:
        out = out.groupBy("segment", "nth").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                runs = pa.array([merged(sorted(r)) for r in b.column(2).to_pylist()], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), runs, b.column(3)], ["doc_id", "n_words", "runs", "items"])

        out = out.select("doc_id", "n_words", "runs", "items").mapInArrow(merge, "doc_id long, n_words long, runs array<array<long>>, items array<string>")
    return out.select("doc_id", "n_words", "runs", "items")


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Sorted runs without overlaps."""
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """doc_id, item_id, kind, begin, end: every match, in words of the document.

    kind 'phrase': a window of the item stands at [begin, end). kind 'near': all words of a
    window stand within window + slop words around its rarest one, at begin, in any order, and
    no phrase match of the item covers that word. Edge cases are those of contamination().
    """
    spark = docs.sparkSession
    gap = 2 * (window + slop) + 1
    index = build_index(docs, _vocabulary(items, item_id_col, item_text_col, block_bytes, max_terms), id_col, text_col, SEGMENT_WORDS, gap)
    out = spark.createDataFrame([], _MATCH)
    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast((block, window))

        def answer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = Queries(*shared.value)
            for batch in batches:
                for row in batch.to_pylist():
                    seg = Segment(row, queries)
                    first = seg.starts_of_documents(gap)
                    exact: dict[tuple[int, str], set[tuple[int, int]]] = {}
                    near: dict[tuple[int, str], set[int]] = {}
                    for n, owners, begins, close in seg.found(window + slop):
                        for d, a in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist()):
                            for o in owners:
                                exact.setdefault((d, o), set()).add((a - int(first[d]), a - int(first[d]) + n))
                        for d, a in zip((np.searchsorted(first, close, "right") - 1).tolist(), close.tolist()):
                            for o in owners:
                                near.setdefault((d, o), set()).add(a - int(first[d]))
                    rows = [(d, o, "phrase", a, b) for (d, o), s in exact.items() for a, b in sorted(s)]
                    for (d, o), s in near.items():
                        rows += [(d, o, "near", a, a + 1) for a in sorted(s) if not any(x <= a < y for x, y in exact.get((d, o), ()))]
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": seg.ids[d], "item_id": o, "kind": k, "begin": a, "end": b} for d, o, k, a, b in rows],
                        schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]),
                    )

        out = out.unionByName(index.mapInArrow(answer, _MATCH))
    return out


def _n_hit() -> Column:
    return F.aggregate("runs", F.lit(0).cast("long"), lambda total, r: total + r[1] - r[0])


def _contaminated(n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated, from contamination()."""
    return found.withColumn("n_hit", _n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit")).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """The rows of docs without passages of the items, with all their columns and nothing else.

    A row goes if window words or more of it in a row are inside matches, however long its text
    is, or if it is contaminated as digest() says (which matters for items of fewer words).
    Rows go by a hash of id and text, so that rows which share an id are judged each by its text.
    """
    key = F.xxhash64(quoted(id_col), text_of(text_col))
    rows = docs.select(key.alias("doc_id"), text_of(text_col).alias("text"))
    found = contamination(rows, items, item_id_col=item_id_col, item_text_col=item_text_col, window=window)
    passage = F.exists("runs", lambda r: r[1] - r[0] >= window)
    bad = found.where(passage | _contaminated(_n_hit())).select("doc_id")
    return drop_rows(docs, key, stored(bad, "contaminated"), "doc_id")
