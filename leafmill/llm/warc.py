"""WARC archives: writing, and reading with segment reassembly.

Writing is DataFrame functions and Spark's own text sink: a row is a record, the line
separator is the blank lines between records, and the sink's commit protocol makes the
files appear whole or not at all, in whatever store the path names. Long records are
split into segments, which also bounds the size of a file.

Reading streams records out of an archive by their lengths; what is damaged is a row with a
status, and reading goes on with the next record. Continuation records are grouped by the
id of the record that they continue and put in the order of their segment numbers; the
total length is verified, and the chunked transfer framing is decoded.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import quoted, scratch_path, small_batches, stored, text_of

CRLF = "\r\n"
#: Characters (not bytes: a text sink can't cut a character) of a segment and of a chunk.
SEGMENT_CHARS = 16_384
CHUNK_CHARS = 4_096
FILE_RECORDS = 2_048
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _field(name: str, value: Column) -> Column:
    """A header line, nothing for null. Control characters can't break out of it."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


#: Bytes of a record's header, and of its block; with more it is damaged.
HEADER_BYTES, BLOCK_BYTES = 1 << 20, (1 << 31) - 1
#: Bytes that are read of an archive at a time.
READ_BYTES = 1 << 20


def _record_id(page_id: Column, digest: Column, row: Column) -> Column:
    """An id of its own for each row: repeated rows are records of their own."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.substring(digest, 1, 32), F.lit(":"), row.cast("string"), F.lit(">"))


def _pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS, revisit_bytes: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """value: the text of one WARC record per row, without the blank lines that end it.

    The payload is the html in UTF-8, null counting as empty. Of records with equal payloads of
    revisit_bytes or more, that with the smallest id is a response, others revisit it; smaller
    ones are all responses. Null ids come last; rows that repeat an id with its payload are records
    of their own, of the same type. An empty table gives an empty result.
    """
    p = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    p = p.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html"), "row": F.monotonically_increasing_id()})
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))
    # payloads that stand once are no one's: what is left is small, and often joined without a shuffle of the pages
    first = p.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first.select(F.col("digest").alias("of"), F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row")), "warc-firsts")
    again = (F.col("bytes") >= revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    p = p.join(first, F.col("digest") == F.col("of"), "left").withColumn("again", F.coalesce(again, F.lit(False)))
    chunks = F.transform(
        _pieces(F.col("html"), chunk_chars),
        lambda c: F.concat(F.lower(F.hex(F.octet_length(c).cast("long"))), F.lit(CRLF), c, F.lit(CRLF)),
    )
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    whole = F.concat(F.lit(head + f"Transfer-Encoding: chunked{CRLF}{CRLF}"), F.array_join(chunks, ""), F.lit(f"0{CRLF}{CRLF}"))
    p = p.withColumn("block", F.when(F.col("again"), F.lit(head + CRLF)).otherwise(whole))
    p = p.select(
        "page_id", "url", "digest", "first", "first_row", "again", _record_id(F.col("page_id"), F.col("digest"), F.col("row")).alias("id"),
        F.octet_length("block").alias("total"), _pieces(F.col("block"), segment_chars).alias("segments"),
    ).withColumn("n", F.size("segments"))
    p = p.select("*", F.posexplode("segments").alias("at", "segment")).drop("segments")
    opens, split, last = F.col("at") == 0, F.col("n") > 1, F.col("at") + 1 == F.col("n")
    kind = F.when(~opens, "continuation").when(F.col("again"), "revisit").otherwise("response")
    ident = F.when(opens, F.col("id")).otherwise(F.concat(F.regexp_replace("id", ">$", ":"), F.col("at") + 1, F.lit(">")))
    return p.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            _field("WARC-Type", kind), _field("WARC-Record-ID", ident), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
            _field("WARC-Page-ID", F.col("page_id")),
            _field("WARC-Payload-Digest", F.when(opens, F.concat(F.lit("sha256:"), F.col("digest")))),
            _field("WARC-Profile", F.when(opens & F.col("again"), F.lit(_PROFILE))),
            _field("WARC-Refers-To", F.when(opens & F.col("again"), _record_id(F.col("first"), F.col("digest"), F.col("first_row")))),
            _field("WARC-Segment-Number", F.when(split, F.col("at") + 1)),
            _field("WARC-Segment-Origin-ID", F.when(~opens, F.col("id"))),
            _field("WARC-Segment-Total-Length", F.when(split & last, F.col("total"))),
            F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
            _field("Content-Length", F.octet_length("segment")), F.lit(CRLF), F.col("segment"),
        ).alias("value")
    )


def write(found: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write records() as gzipped archives below path, which mustn't exist; no records give an empty folder."""
    found.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


class _Bytes:
    """A stream of pieces; None among them marks a break, beyond which nothing belongs together."""

    def __init__(self, pieces: Iterator[bytes | None]):
        self.pieces, self.data, self.at, self.stopped, self.over = pieces, bytearray(), 0, False, False

    def fill(self) -> bool:
        if not self.stopped:
            piece = next(self.pieces, _END)
            self.over = piece is _END
            self.stopped = piece is _END or piece is None
        if self.stopped:
            return False
        if self.at > READ_BYTES:
            del self.data[: self.at]
            self.at = 0
        self.data += piece
        return True

    def has(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.fill():
                return False
        return True

    def find(self, mark: bytes, within: int | None = None) -> int:
        """Bytes up to the next mark, -1 if there is none (within so many)."""
        seen = 0
        while True:
            i = self.data.find(mark, self.at + max(0, seen - len(mark)))
            if i >= 0:
                return i - self.at
            seen = len(self.data) - self.at
            if within is not None and seen > within or not self.fill():
                return -1

    def resume(self) -> bool:
        """Go on at the next beginning of a record, also beyond a break; false if there is none."""
        while True:
            while True:
                i = self.data.find(b"\nWARC/1.", self.at)
                if i >= 0:
                    self.at = i + 1
                    return True
                self.at = max(self.at, len(self.data) - 8)
                if not self.fill():
                    break
            if not self.restart():
                return False
            if self.has(7) and self.data.startswith(b"WARC/1."):
                return True

    def restart(self) -> bool:
        if self.over:
            return False
        self.data, self.at, self.stopped = bytearray(), 0, False
        return True


_END = object()


def _parsed(pieces: Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header, block) of each record; a damaged one has no block, and reading goes on with the next."""
    b = _Bytes(pieces)
    while True:
        while b.has(2) and b.data[b.at : b.at + 2] == b"\r\n":
            b.at += 2
        if not b.has(1):
            if not b.restart():
                return
            continue
        size = b.find(b"\r\n\r\n", HEADER_BYTES)
        head: dict[str, str] = {}
        length = -1
        if 0 <= size <= HEADER_BYTES and b.data.startswith(b"WARC/", b.at):
            for line in b.data[b.at : b.at + size].decode("utf-8", "replace").split(CRLF)[1:]:
                name, _, value = line.partition(":")
                head[name.strip().lower()] = value.strip()
            length = _whole(head.get("content-length"))
            b.at += size + 2  # the blank line is passed with the block: a record may begin right behind it
        if length is None or not 0 <= length <= BLOCK_BYTES or not b.has(2 + length):
            yield head, None
            if not b.resume():
                return
            continue
        yield head, bytes(b.data[b.at + 2 : b.at + 2 + length])
        b.at += 2 + length


def _whole(text: str | None) -> int | None:
    """A number of the header, None if it is none."""
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def dechunked(body: bytes) -> bytes | None:
    """The body of chunked transfer framing, or None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block, None if it is broken."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    lines = head.decode("latin-1").lower().split(CRLF)
    if any(x.startswith("transfer-encoding:") and "chunked" in x for x in lines):
        return dechunked(body)
    return body


def _inflated(raw: Iterator[bytes]) -> Iterator[bytes | None]:
    """The plain bytes of an archive, gzipped (in one or many members) or not, a piece at a time.

    A damaged member is a break, after which the next member is looked for.
    """
    data = more = next(raw, b"")
    while len(data) < 2 and more:
        data += (more := next(raw, b""))
    if data[:2] != b"\x1f\x8b":
        yield data
        yield from raw
        return
    while data:
        d = zlib.decompressobj(31)
        lost = False
        while data:
            try:
                piece = d.decompress(data, READ_BYTES)
            except zlib.error:
                lost = True
                break
            if piece:
                yield piece
            if d.eof:
                data = d.unused_data or next(raw, b"")
                break
            data = d.unconsumed_tail or next(raw, b"")
        if lost or data and not data.startswith(b"\x1f\x8b"[: len(data)]):
            yield None
            data, begun = data[1:] if lost else data, False
            while not begun:
                i = data.find(b"\x1f\x8b\x08")
                begun = i >= 0
                more = b"" if begun else next(raw, b"")
                data = data[i:] if begun else data[-2:] + more if more else b""
                begun |= not data


def _opened(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(READ_BYTES):
            yield piece


_PART = pa.schema(
    [
        ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("stated", pa.string()), ("refers_to_id", pa.string()), ("status", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()),
    ]
)
_PARTS = (
    "origin string, number int, total long, kind string, page_id long, url string, stated string, refers_to_id string,"
    " status string, payload_bytes long, payload_digest string, block binary"
)


def _decoded(block: bytes, total: int | None) -> tuple[str, bytes | None]:
    """The status of a whole block, and its payload where that is ok."""
    if total is not None and total != len(block):
        return "wrong total length", None
    payload = payload_of(block)
    return ("broken block", None) if payload is None else ("ok", payload)


def parts(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record below path, continuation records with the id of their origin.

    Archives on a local or mounted file system are streamed, a record at a time; those that only
    Spark opens come as one value, so each must be below 2 GB, and are inflated as a stream.
    Records that are not segmented are decoded here, and hand on the payload (as block) only if
    it is kept; blocks of segments go on as they are. A record with a header that can't be read, or
    which is cut off, is a row with that status under its own id (null if it has none). An empty
    folder, and archives without records, give no rows.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    streamed = re.match(r"(?:file:)?/", path) is not None
    files = files.select(F.regexp_replace(F.col("path"), "^file:/+", "/").alias("at")) if streamed else files.select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                raw = _opened(x.as_py()) if streamed else iter([x.as_py() or b""])
                rows, size = [], 0
                for h, block in _parsed(_inflated(raw)):
                    rows.append(_row(h, block, keep_payload))
                    size += len(rows[-1]["block"] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PART)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_PART)

    return files.mapInArrow(run, _PARTS)


def _row(h: dict[str, str], block: bytes | None, keep_payload: bool) -> dict:
    """A row of parts()."""
    told = {k: h.get(f"warc-{k}") for k in ("segment-number", "segment-total-length", "page-id")}
    number, total = (_whole(told[k]) for k in ("segment-number", "segment-total-length"))
    page = told["page-id"]
    page_id = int(page) if page and re.fullmatch(r"-?\d{1,18}", page, re.ASCII) else None
    row = {
        "origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "number": number or 1, "total": total, "kind": h.get("warc-type"), "page_id": page_id,
        "url": h.get("warc-target-uri"), "stated": h.get("warc-payload-digest"), "refers_to_id": h.get("warc-refers-to"), "block": block,
    }
    bad = any(told[k] and v is None for k, v in (("segment-number", number), ("segment-total-length", total), ("page-id", page_id))) or number is not None and not 1 <= number < 1 << 31
    if block is None or bad:
        # under its own id, so that it isn't taken for a segment of another record
        whole = {"origin": h.get("warc-record-id"), "number": 1, "total": None, "block": None}
        return row | whole | {"status": "bad header" if bad or _whole(h.get("content-length")) is None else "cut off"}
    if number is None:
        row["status"], block = _decoded(block, None)
        if block is not None:
            row |= {"payload_bytes": len(block), "payload_digest": hashlib.sha256(block).hexdigest()}
        row["block"] = block if keep_payload else None
    return row


_WHOLE = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to_id", pa.string()), ("copies", pa.int32()),
        ("status", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)
_WHOLES = (
    "record_id string, record_type string, page_id long, url string, refers_to_id string, copies int, status string,"
    " payload binary, payload_bytes long, payload_digest string"
)


_FIELDS = ("total", "kind", "page_id", "url", "stated", "refers_to_id", "status", "payload_bytes", "payload_digest", "block")


def reassembled(found: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per record of parts(), its segments put together.

    status: ok, 'segment missing', 'wrong total length', 'broken block', 'no origin', 'bad header' or
    'cut off'; only ok has a payload. A revisit has none either, but the digest it states. A record
    that stands k times in the archives is one row with copies = k; where copies differ, a good one
    counts. Copies are combined before they are shuffled, so a row here holds one record's segments,
    each once. Records without an id that are damaged are one row of their own.
    """
    good = F.coalesce(F.col("status"), F.lit("ok")) == "ok"
    best = F.struct((~good).alias("bad"), F.xxhash64("block", "payload_digest", "total").alias("hash"))
    once = found.groupBy("origin", "number").agg(F.min_by(F.struct(*_FIELDS), best).alias("s"), F.count(F.lit(1)).alias("n"))
    grouped = once.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "n", *[F.col(f"s.{c}").alias(c) for c in _FIELDS]))).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, segments in zip(b.column(0), b.column(1)):
                segments = segments.as_py()
                by = {s["number"]: s for s in segments}
                head, n = by.get(1), len(by)
                top = by[max(by)]
                row = {"record_id": origin.as_py(), "copies": head["n"] if head else 0}
                payload = None
                if head is None:
                    status = "no origin"
                elif head["status"] and (n == 1 or head["status"] in ("bad header", "cut off")):
                    status, payload = head["status"], head["block"]
                    row |= {"payload_bytes": head["payload_bytes"], "payload_digest": head["payload_digest"]}
                elif sorted(by) != list(range(1, n + 1)) or top["total"] is None or any(s["block"] is None for s in by.values()):
                    status = "segment missing"
                else:
                    status, payload = _decoded(b"".join(by[i]["block"] for i in range(1, n + 1)), top["total"])
                    if payload is not None:
                        row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                if head:
                    row |= {"record_type": head["kind"], "page_id": head["page_id"], "url": head["url"], "refers_to_id": head["refers_to_id"]}
                row["status"] = status
                if head and head["kind"] == "revisit":
                    row |= {"payload_bytes": None, "payload_digest": (head["stated"] or "").removeprefix("sha256:") or None}
                else:
                    row["payload"] = payload if keep_payload else None
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)

    return grouped.mapInArrow(run, _WHOLES)


def resolved(whole: DataFrame) -> DataFrame:
    """The records with the size of what a revisit refers to, and the page id of that (refers_to)."""
    whole = stored(whole.drop("payload"), "warc-records")
    told = whole.where("record_type = 'response'").select(F.col("record_id").alias("told_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("told_bytes"))
    r = whole.where("record_type = 'revisit'").join(told, F.col("refers_to_id") == F.col("told_id"), "left")
    r = r.withColumn("payload_bytes", F.col("told_bytes")).drop("told_id", "told_bytes")
    return whole.where("record_type <> 'revisit' OR record_type IS NULL").withColumn("refers_to", F.lit(None).cast("long")).unionByName(r)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Archive pages below path (a scratch folder by default), read them back: one row per row of pages."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(records(pages, id_col, url_col, html_col), path)
    return resolved(reassembled(parts(spark, path, False), False)).drop("copies")
