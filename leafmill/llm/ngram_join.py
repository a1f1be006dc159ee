"""N-gram Jaccard self-join with Bayesian candidate pruning.

Words are runs without white space, shingles SHINGLE consecutive words (all words of a
shorter text), similarity is the Jaccard index of two texts' shingle sets.

1. Texts that are equal word for word become one; each gets SIGNATURE MinHash values.
2. Bands of ROWS values put texts into buckets; similar texts share one but for a chance
   of (1 - t ** ROWS) ** BANDS, below 1e-5 at the threshold t = 0.8 and less above it.
   Of buckets with the same members one is kept. Buckets are counted by their hash alone;
   what is in no shared one is left behind by a Bloom filter of fixed size.
3. In a bucket, pairs' MinHash values are compared a few at a time; a pair is dropped as
   soon as the posterior probability that its similarity reaches t falls below TOLERANCE.
   What is left, as spanning trees, joins texts into clusters.
4. In a cluster, links are counted exactly, from its whole texts.

Large groups are cut into slices, and rows grow with texts, not with pairs:

* A large bucket's slices are compared within themselves and with a few leaders, which stand
  in every slice. That joins most of a bucket into one part; only the texts that are not in it
  meet the others, block by block. Pairs within a part needn't be compared: they are joined.
* A large cluster's texts are written as what sets them apart from a pivot, the shingles that
  most of a sample have: how many of them lack (a), how many are their own (x). As q * a + p * x
  of two texts with t = p / q tell alone how similar they are but for differences that they
  share, most links are counted by two sums; only texts that differ from the pivot by over half
  of what a link allows meet the others, block by block, and share differences.

Blocks of such texts meet in pairs, so where most of a group is unlike its leaders or its
pivot (many different groups chained into one), work and rows are quadratic in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._bloom import bloom, drop_rows, maybe
from ._common import forget, quoted, small_batches, stored, text_of
from ._graph import components

SHINGLE = 5
SIMILAR = Fraction(4, 5)
BANDS, ROWS = 30, 5
SIGNATURE = BANDS * ROWS
#: Values compared between two looks at the posterior.
STEP = 30
TOLERANCE = 1e-6
#: Texts of a slice or block: of signatures, and of whole texts.
BLOCK_SIGNATURES, BLOCK_TEXTS = 512, 128
#: Texts of a block, where blocks meet in pairs: this many times a slice's.
MEET = 4
#: About so many texts of a large bucket stand in all its slices, and of a cluster make its pivot.
LEADERS, PIVOT = 8, 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _multipliers() -> np.ndarray:
    return _mixed(np.arange(1, SIGNATURE + 1, dtype=_U) * _BASE) | _U(1)


def plain_words(text: bytes) -> bytes:
    """The words with one blank between them."""
    return b" ".join(text.split())


def shingle_hashes(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of plain texts, one after another, and the count of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if len(raw) <= 1:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # a word's hash: its bytes as digits of a number to an odd base, by differences of prefix sums
    power = np.ones(len(raw) + 1, _U)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    inverse = np.ones(len(raw) + 1, _U)
    inverse[1:] = _U(pow(int(_BASE), -1, 1 << 64))
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([[_U(0)], np.cumsum((raw.astype(_U) + _U(1)) * power[:-1], dtype=_U)])
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    first = np.searchsorted(starts, begins)
    counts = np.where(sizes > 0, np.diff(np.append(first, len(starts))), 0)
    gram = np.zeros(len(words), _U)
    for k in range(min(n, len(words))):
        gram[: len(words) - k] += words[k:] * _mixed(np.array([k + 1], _U))[0]
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(made.sum())
    at = np.repeat(first, made) + np.arange(total) - np.repeat(np.cumsum(made) - made, made)
    out = _mixed(gram[at])
    place = np.cumsum(made) - made
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():  # the words of a short text
        own = words[first[i] : first[i] + counts[i]]
        value = np.array([counts[i]], _U)
        for w in own:
            value = value * _BASE + w
        out[place[i]] = _mixed(value)[0]
    return out, made


def signatures(texts: list[bytes], chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (16 bits of each least hash) of plain texts, and their shingle counts."""
    out = np.zeros((len(texts), SIGNATURE), np.uint16)
    counts = np.zeros(len(texts), np.int64)
    times = _multipliers()
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < 6 * chunk):
            size += len(texts[j])
            j += 1
        grams, made = shingle_hashes(texts[i:j])
        counts[i:j] = made
        some = np.flatnonzero(made)
        if len(some):
            begin = (np.cumsum(made) - made)[some]
            buffer = np.empty_like(grams)
            for k in range(SIGNATURE):
                np.multiply(grams, times[k], out=buffer)
                least = np.minimum.reduceat(buffer, begin)
                out[i + some, k] = (_mixed(least) >> _U(48)).astype(np.uint16)
        i = j
    return out, counts


def least_matches(t: float, tolerance: float) -> list[int]:
    """Of n compared values, n up to SIGNATURE, how many must agree so that, from an even
    prior, the posterior probability of a similarity of t or more is at least tolerance."""
    out = []
    for n in range(SIGNATURE + 1):
        # the posterior is Beta(m + 1, n - m + 1); its tail above t is P(Binomial(n + 1, t) <= m)
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys; batches come sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        n = t.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in range(n_keys):
            k = t.column(c).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            rest = t
            continue
        yield t.slice(0, int(cuts[-1]))
        rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _starts(t: pa.Table, n_keys: int) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for c in range(n_keys):
        k = t.column(c).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node of its component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            break
    return label


def _surviving(sig: np.ndarray, run: np.ndarray, side: np.ndarray, cross: np.ndarray, part: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one run that the posterior keeps. side: the block of a row; cross: whether
    only pairs across count; part: pairs within a part are left out."""
    left, right = [], []
    d, n = 1, len(run)
    alive = np.arange(n)
    while True:
        i = alive[alive + d < n]
        i = i[run[i] == run[np.minimum(i + d, n - 1)]]
        if not len(i):
            return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))
        alive = i
        a = i[(~cross[i] | (side[i] != side[i + d])) & (part[i] != part[i + d])]
        b, agree = a + d, np.zeros(len(a), np.int64)
        for k in range(0, SIGNATURE, STEP):
            agree += (sig[a, k : k + STEP] == sig[b, k : k + STEP]).sum(axis=1)
            ok = agree >= need[min(k + STEP, SIGNATURE)]
            a, b, agree = a[ok], b[ok], agree[ok]
            if not len(a):
                break
        if len(a):
            left.append(a)
            right.append(b)
        d += 1


def _slice(size: Column, block: int) -> Column:
    """The slice of a row, of as many as a group of that size has."""
    return F.pmod(F.xxhash64("rep"), F.greatest(F.ceil(size / block), F.lit(1))).cast("int")


def _dealt(rows: DataFrame, odd: str, n_odd: str, n_even: str, block: int) -> DataFrame:
    """rows (of groups with n_odd odd rows and n_even others) with bi, bj and side: pairs of blocks
    in which odd rows meet all rows of their group, and others odd ones only.

    Written are n_even * ceil(n_odd / block) + n_odd * (number of blocks) rows.
    """
    odds, evens = (F.ceil(F.col(c) / block).cast("int") for c in (n_odd, n_even))
    own = F.when(F.col(odd), F.pmod(F.xxhash64("rep"), odds)).otherwise(odds + F.pmod(F.xxhash64("rep"), F.greatest(evens, F.lit(1)))).cast("int")
    m = rows.where(F.col(n_odd) > 0).withColumn("side", own)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col(odd), odds + evens).otherwise(odds) - 1)))
    return m.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other")


def text_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n_shingles, sig, mark: stored, one row per row of docs; mark: a hash of id and text."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), _mark(id_col, text_col).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plain_words(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            sig, counts = signatures(texts)
            keys, short = _keys(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), keys, short, pa.array(counts, pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary()), b.column(2)],
                ["doc_id", "key", "short", "n_shingles", "sig", "mark"],
            )

    return stored(rows.mapInArrow(run, "doc_id long, key binary, short long, n_shingles long, sig binary, mark long"), "signatures")


def _mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(quoted(id_col).cast("long"), text_of(text_col))


def _keys(texts: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """SHA-256 of each text, and its first eight bytes as a number."""
    keys = [hashlib.sha256(t).digest() for t in texts]
    return pa.array(keys, pa.binary()), pa.array(np.frombuffer(b"".join(k[:8] for k in keys), np.int64), pa.int64())


def _buckets(sig: list[bytes]) -> np.ndarray:
    """The buckets of each signature: a hash per band."""
    s = np.frombuffer(b"".join(sig), np.uint16).reshape(-1, BANDS, ROWS).astype(_U)
    value = np.zeros(s.shape[:2], _U) + np.arange(1, BANDS + 1, dtype=_U)
    for k in range(ROWS):
        value = _mixed(value * _BASE + s[:, :, k])
    return value


def _candidate_clusters(texts: DataFrame, t: Fraction, tolerance: float, block: int) -> DataFrame:
    """node, root: texts joined by pairs that the pruning keeps."""
    need = least_matches(float(t), tolerance)
    some = texts.where("n_shingles > 0").select("rep", "sig")

    def all_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_buckets(b.column(1).to_pylist()).reshape(-1).view(np.int64))], ["bucket"])

    shared = some.mapInArrow(all_buckets, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    shared = stored(shared, "shared-buckets")
    words = texts.sparkSession.sparkContext.broadcast(bloom(shared, "bucket"))

    def in_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _buckets(b.column(1).to_pylist()).reshape(-1)
            ok = maybe(words.value, found)
            rep = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(found[ok].view(np.int64)), pa.array(rep[ok])], ["bucket", "rep"])

    bands = stored(some.mapInArrow(in_shared, "bucket long, rep long"), "bands")
    full = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    one = stored(full.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("of")).select("of", "n"), "buckets")
    members = stored(bands.join(one, F.col("bucket") == F.col("of")).select("bucket", "n", "rep"), "bucket-members")
    sigs = texts.select(F.col("rep").alias("of"), "sig")
    rows = _with_leaders(members, block).withColumn("part", F.col("rep"))
    edges = stored(_compared(rows, sigs, ["bucket", "slice"], need), "similar-pairs")
    large = members.where(F.col("n") > block)
    found = components(edges)
    if not large.isEmpty():
        known = stored(found, "parts")
        rows = _not_joined(large, known, block)
        more = _compared(rows, sigs, ["bucket", "bi", "bj"], need)
        found = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        forget(known)
    for done in (shared, bands, one, members, edges):
        forget(done)
    return found


def _with_leaders(members: DataFrame, block: int) -> DataFrame:
    """bucket, slice, rep: each member in its slice, the leaders of a bucket of several slices in all of them."""
    slices = F.ceil(F.col("n") / block).cast("int")
    lead = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("n") / LEADERS)) == 0
    leaders = members.where((slices > 1) & lead).select("bucket", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "rep")
    return members.select("bucket", _slice(F.col("n"), block).alias("slice"), "rep").unionByName(leaders)


def _not_joined(large: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """bucket, bi, bj, side, rep, part: members outside of their bucket's largest part, dealt to meet all others."""
    rows = large.join(known, F.col("rep") == F.col("node"), "left").select("bucket", "n", "rep", F.coalesce("root", "rep").alias("part"))
    rows = stored(rows, "bucket-parts")
    main = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    main = main.groupBy(F.col("bucket").alias("of")).agg(F.max(F.struct("m", "part")).alias("main"), F.first("n").alias("all"))
    main = main.select("of", F.col("main.part").alias("main"), F.col("main.m").alias("even"), (F.col("all") - F.col("main.m")).alias("odd")).where("odd > 0")
    rows = rows.join(stored(main, "bucket-mains"), F.col("bucket") == F.col("of")).withColumn("is_odd", F.col("part") != F.col("main"))
    return _dealt(rows, "is_odd", "odd", "even", MEET * block).select("bucket", "bi", "bj", "side", "rep", "part")


def _compared(rows: DataFrame, sigs: DataFrame, keys: list[str], need: list[int]) -> DataFrame:
    """a, b: spanning trees of the pairs that the pruning keeps, within runs of equal keys."""
    meet = keys[-1] == "bj"
    rows = rows.join(sigs, F.col("rep") == F.col("of")).select(*keys, "rep", "part", "sig", *(["side"] if meet else []))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "rep")
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, k):
            run_of = np.zeros(table.num_rows, np.int64)
            run_of[_starts(table, k)] = 1
            run_of = np.cumsum(run_of)
            rep, part = (table.column(c).to_numpy() for c in ("rep", "part"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
            side = table.column("side").to_numpy() if meet else run_of
            cross = table.column("bi").to_numpy() != table.column("bj").to_numpy() if meet else np.zeros(len(rep), bool)
            a, b = _surviving(sig, run_of, side, cross, part, need)
            label = _least_linked(table.num_rows, a, b)
            some = np.flatnonzero(label != np.arange(len(label)))
            pairs = np.unique(np.stack([rep[some], rep[label[some]]], axis=1), axis=0) if len(some) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _numbered(texts: list[bytes], n: int) -> tuple[dict[bytes, int], list[int], np.ndarray]:
    """The words' numbers, the texts' lengths in words, and all texts as numbers, each with n times -1 behind."""
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known)) for w in t.split(b" ")] if t else [], np.int64) for t in texts]
    flat = np.concatenate([np.append(w, np.full(n, -1)) for w in words]) if words else np.zeros(0, np.int64)
    return known, [len(w) for w in words], flat


def _sets(gram: np.ndarray, lengths: list[int], n: int) -> list[np.ndarray]:
    out, at = [], 0
    for size in lengths:
        m = max(1, size - n + 1) if size else 0
        out.append(np.unique(gram[at : at + m]))
        at += size + n
    return out


def exact_grams(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """For each plain text its set of shingles, as sorted numbers that are equal for equal
    shingles only: words are numbered, then pairs of numbers again and again."""
    known, lengths, flat = _numbered(texts, n)
    flat = flat + 1
    gram = flat.copy()
    for k in range(1, n):  # gram: numbers of the (k + 1)-grams that begin here; 0 stands for no word
        nxt = np.append(flat[k:], np.zeros(k, np.int64))
        _, gram = np.unique(gram * (len(known) + 2) + nxt, return_inverse=True)
    return _sets(gram, lengths, n)


def wide_grams(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The same as 128-bit hashes, which mean the same in every task."""
    known, lengths, flat = _numbered(texts, n)
    own = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in known) + bytes(16), _U).reshape(-1, 2)
    lanes = own[flat]  # the last one, of zeros, stands for no word
    gram = lanes.copy()
    for k in range(1, n):
        gram = gram * _BASE
        gram[: len(lanes) - k] += lanes[k:]
        gram = _mixed(gram)
    return _sets(np.ascontiguousarray(gram).view("S16").reshape(-1), lengths, n)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """A matrix of how many members each two sets share."""
    common = np.zeros((len(sets), len(sets)), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return common
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(1, (8 << 20) // max(1, len(sets))))
    for begin in range(0, columns, max(1, width)):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        common += np.rint(part @ part.T).astype(np.int64)
    return common


def _links(texts: list[bytes], t: Fraction) -> np.ndarray:
    """A matrix of which of the texts are similar, exactly."""
    sets = exact_grams(texts)
    sizes = np.array([len(s) for s in sets], np.int64)
    p, q = t.numerator, t.denominator
    return (_common(sets) * (p + q) >= p * (sizes[:, None] + sizes[None, :])) & (sizes[:, None] > 0) & (sizes[None, :] > 0)


_LINKS = "rep long, root long, links long"


def _counted(rep: np.ndarray, link: np.ndarray) -> list[np.ndarray]:
    """rep, root and links of rows whose links are in a matrix."""
    x, y = np.nonzero(np.triu(link))
    return [rep, rep[_least_linked(len(rep), x, y)], link.sum(axis=1)]


def _links_batch(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "root", "links"])


def _verified(docs: DataFrame, texts: DataFrame, clusters: DataFrame, text_col: str, t: Fraction, block: int) -> DataFrame:
    """rep, root, links: rows to be summed up; root is a text that rep is linked to, or itself."""
    size = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    dealt = clusters.join(size, "root").select("root", "n", F.col("node").alias("rep"))
    dealt = stored(dealt.join(texts.select("rep", F.col("key").alias("of"), "short"), "rep"), "cluster-members")
    words = docs.sparkSession.sparkContext.broadcast(bloom(dealt, "short"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            plain = [plain_words(x) for x in b.column(0).cast(pa.binary()).to_pylist()]
            keys, short = _keys(plain)
            ok = np.flatnonzero(maybe(words.value, short.to_numpy().view(_U)))
            own = {keys[i].as_py(): i for i in ok.tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([press.compress(plain[i]) for i in own.values()], pa.binary())], ["key", "packed"])

    # one row of each text, combined before the shuffle: a text may stand in a third of all rows
    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(packed, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    rows = rows.join(dealt, F.col("key") == F.col("of")).select("root", "n", "rep", "packed")
    if dealt.where(F.col("n") > block).isEmpty():
        return stored(_verified_whole(rows, t), "links")
    rows = stored(rows, "cluster-texts")
    return stored(_verified_whole(rows.where(F.col("n") <= block), t).unionByName(_verified_by_pivot(rows.where(F.col("n") > block), t, block)), "links")


def _verified_whole(rows: DataFrame, t: Fraction) -> DataFrame:
    """Each cluster in a task, all its texts with each other."""
    rows = rows.select("root", "rep", "packed").repartition("root").sortWithinPartitions("root", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for table in _runs(batches, 1):
            begins = np.append(_starts(table, 1), table.num_rows)
            rep, texts = table.column("rep").to_numpy(), table.column("packed")
            out = []
            for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
                link = _links([press.decompress(texts[i].as_py()) for i in range(a, z)], t)
                np.fill_diagonal(link, False)
                out.append(_counted(rep[a:z], link))
            yield _links_batch(out)

    return rows.mapInArrow(run, _LINKS)


def _verified_by_pivot(rows: DataFrame, t: Fraction, block: int) -> DataFrame:
    """Large clusters. With P shingles in the pivot, a text that lacks a of them and has x others
    weighs w = q * a + p * x. Two texts that share s differences are similar if and only if
    w + w' - (p + q) * s <= (q - p) * P, their allowance."""
    p, q = t.numerator, t.denominator
    apart = stored(_apart(rows, t, block), "differences")
    # what can be told by weights alone: for each weight in a cluster, how many texts it goes with
    points = apart.where("w <= allowed").groupBy("root", "w").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"), F.first("allowed").alias("allowed"))
    points = stored(points, "weights")
    asked = points.select("root", (F.col("allowed") - F.col("w")).alias("at"), F.lit(0).cast("long").alias("c"), "w", F.lit(None).cast("struct<w: long, rep: long>").alias("least"))
    given = points.select("root", F.col("w").alias("at"), "c", F.lit(None).cast("long").alias("w"), F.struct(F.col("w").alias("w"), F.col("rep").alias("rep")).alias("least"))
    # a row per weight within the allowance, of which there are fewer than shingles in a text
    upto, every = Window.partitionBy("root").orderBy("at").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("root")
    told = asked.unionByName(given).withColumns({"others": F.sum("c").over(upto), "lightest": F.min("least").over(every)}).where("w IS NOT NULL")
    told = stored(told.select(F.col("root").alias("of"), F.col("w").alias("of_w"), "others", "lightest"), "weights-told")
    light = apart.drop("differs").join(told, (F.col("root") == F.col("of")) & (F.col("w") == F.col("of_w")))
    tree = F.when(F.col("w") + F.col("lightest.w") <= F.col("allowed"), F.col("lightest.rep")).otherwise(F.col("rep"))
    light = light.select("rep", tree.alias("root"), (F.col("others") - (2 * F.col("w") <= F.col("allowed")).cast("long")).alias("links"))
    # the others: pairs of which one at least is over half of the allowance
    odd = F.col("is_odd").cast("long")
    apart = apart.withColumn("is_odd", 2 * F.col("w") > F.col("allowed"))
    sizes = stored(apart.groupBy(F.col("root").alias("of")).agg(F.sum(odd).alias("odd"), F.sum(1 - odd).alias("even")).where("odd > 0"), "odd-sizes")
    met = _dealt(apart.join(sizes, F.col("root") == F.col("of")), "is_odd", "odd", "even", MEET * block)
    met = met.select("root", "bi", "bj", "side", "rep", "w", "allowed", "differs").repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            begins = np.append(_starts(table, 3), table.num_rows)
            bi, bj, side, rep, w, allowed = (table.column(k).to_numpy() for k in range(1, 7))
            differs = table.column("differs")
            out = []
            for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
                both = w[a:z, None] + w[None, a:z]
                link = both > allowed[a]
                if bi[a] != bj[a]:
                    link &= side[a:z, None] != side[None, a:z]
                np.fill_diagonal(link, False)
                link &= both - (p + q) * _common([np.frombuffer(differs[i].as_py(), "S16") for i in range(a, z)]) <= allowed[a]
                out.append(_counted(rep[a:z], link))
            yield _links_batch(out)

    return light.unionByName(met.mapInArrow(run, _LINKS))


def _apart(rows: DataFrame, t: Fraction, block: int) -> DataFrame:
    """root, rep, w, allowed, differs: what sets each text of a cluster apart from its pivot.

    The pivot is made of about PIVOT texts; any pivot gives the same links. It is sent to each slice.
    """
    p, q = t.numerator, t.denominator
    slices = F.ceil(F.col("n") / (MEET * block)).cast("int")

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for table in _runs(batches, 1):
            begins = np.append(_starts(table, 1), table.num_rows)
            for a, z in zip(begins[:-1].tolist(), begins[1:].tolist()):
                found: tuple[np.ndarray, np.ndarray] | None = None
                for i in range(a, z):
                    own = wide_grams([press.decompress(table.column("packed")[i].as_py())])[0]
                    if found is None:
                        found = own, np.ones(len(own), np.int64)
                        continue
                    kinds, at = np.unique(np.concatenate([found[0], own]), return_inverse=True)
                    found = kinds, np.bincount(at, np.concatenate([found[1], np.ones(len(own), np.int64)]), len(kinds)).astype(np.int64)
                pivot = found[0][2 * found[1] > z - a]
                yield pa.RecordBatch.from_arrays([table.column(c).slice(a, 1).combine_chunks() for c in ("root", "n")] + [pa.array([pivot.tobytes()], pa.binary())], ["root", "n", "packed"])

    few = rows.where(F.pmod(F.xxhash64("rep", F.lit(2)), F.ceil(F.col("n") / PIVOT)) == 0).select("root", "n", "packed")
    pivot = few.repartition("root").sortWithinPartitions("root").mapInArrow(pivots, "root long, n long, packed binary")
    pivot = pivot.select("root", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(None).cast("long").alias("rep"), "packed")
    both = rows.select("root", _slice(F.col("n"), MEET * block).alias("slice"), "rep", "packed").unionByName(pivot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        last, pivot = None, np.zeros(0, "S16")
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for root, slice_, rep, data in zip(*(c.to_pylist() for c in b.columns)):
                if (root, slice_) != last:
                    last, pivot = (root, slice_), np.zeros(0, "S16")
                if rep is None:
                    pivot = np.frombuffer(data, "S16")
                    continue
                own = wide_grams([press.decompress(data)])[0]
                lacks, adds = pivot[~np.isin(pivot, own)], own[~np.isin(own, pivot)]
                for column, x in zip(out, (root, rep, q * len(lacks) + p * len(adds), (q - p) * len(pivot), lacks.tobytes() + adds.tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (*[pa.int64()] * 4, pa.binary()))], ["root", "rep", "w", "allowed", "differs"])

    both = both.repartition("root", "slice").sortWithinPartitions("root", "slice", F.col("rep").asc_nulls_first())
    return both.mapInArrow(run, "root long, rep long, w long, allowed long, differs binary")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Fraction = SIMILAR, tolerance: float = TOLERANCE,
    block_signatures: int = BLOCK_SIGNATURES, block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """doc_id, text_id, class_id, n_links, n_copies: one row per row of docs.

    text_id: the least id of the rows whose text is the same word for word (n_copies of them);
    n_links: how many different texts are similar to it; class_id: the least text_id that it
    reaches over links. Null and blank texts have no words: they are copies of each other and
    have no links. If all rows of a text have a null id, its text_id is a negative number made
    from the text. Different texts have links of their own even where they share an id.
    """
    rows, named = _named_texts(docs, id_col, text_col, t, tolerance, block_signatures, block_texts)
    return rows.select("doc_id", "key").join(named, F.col("key") == F.col("of")).select("doc_id", "text_id", "class_id", "n_links", "n_copies")


def _named_texts(docs: DataFrame, id_col: str, text_col: str, t: Fraction, tolerance: float, block_signatures: int, block_texts: int) -> tuple[DataFrame, DataFrame]:
    """The rows of text_table; of (a key), text_id, class_id, n_links, n_copies, chosen: a row per text.

    chosen: of the class's texts with the least text_id the one with the least key.
    """
    rows = text_table(docs, id_col, text_col)
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n_shingles").alias("n_shingles"), F.first("short").alias("short"), F.first("sig").alias("sig"))
    made = -F.abs(F.shiftright(F.xxhash64("key"), 1)) - 1
    # ids may be shared by different texts, so nodes have numbers of their own; storing fixes them
    texts = stored(texts.withColumns({"rep": F.monotonically_increasing_id(), "text_id": F.coalesce("first_id", made)}), "texts")
    clusters = stored(_candidate_clusters(texts, t, tolerance, block_signatures), "clusters")
    links = _verified(docs, texts, clusters, text_col, t, block_texts)
    linked = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = stored(components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))), "classes")
    named = (
        texts.select(F.col("key").alias("of"), "rep", "text_id", "n_copies")
        .join(linked.withColumnRenamed("rep", "l"), F.col("rep") == F.col("l"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("of", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root")
    )
    named = stored(named, "linked-texts")
    least = named.where("root IS NOT NULL").groupBy(F.col("root").alias("class")).agg(F.min(F.struct("text_id", "of")).alias("least"))
    named = named.join(least, F.col("root") == F.col("class"), "left").select(
        "of", "text_id", "n_copies", "n_links", F.coalesce("least.text_id", "text_id").alias("class_id"), F.coalesce(F.col("least.of") == F.col("of"), F.lit(True)).alias("chosen")
    )
    return rows, stored(named, "named-texts")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Fraction = SIMILAR) -> DataFrame:
    """The rows of docs whose id and text name their class, with all their columns and nothing else.

    Rows without an id are never dropped. Rows that share id and text stay or go together, so
    those should have been made one before; rows that share only the id are judged each by its text.
    """
    rows, named = _named_texts(docs, id_col, text_col, t, TOLERANCE, BLOCK_SIGNATURES, BLOCK_TEXTS)
    found = rows.select("doc_id", "key", "mark").join(named, F.col("key") == F.col("of")).where("doc_id IS NOT NULL AND NOT (chosen AND doc_id = text_id)")
    return drop_rows(docs, _mark(id_col, text_col), stored(found.select("mark").distinct(), "similar-rows"), "mark")
