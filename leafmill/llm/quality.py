"""Quality classifier by positive-unlabelled learning.

A small network on measures of a text's form is fitted on trusted positives (rows labelled
good) and unlabelled rows of the corpus, without any negative label. It minimises the
non-negative unbiased risk: with prior p, p * (positives' loss as positive) + max(0,
unlabelled rows' loss as negative - p * positives' loss as negative); where the second
term falls below zero, steps go against it. The prior is estimated from the two samples.

Fitting takes a bounded sample, by hash of the id: SAMPLE positives and SAMPLE unlabelled
rows. Scoring covers every row and its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, quoted, small_batches, text_of

#: Rows of either sample that the model is fitted on. More rows leave accuracy as it is.
SAMPLE = 4_000
THRESHOLD = 0.7
HIDDEN, STEPS, RATE, DECAY = 16, 300, 0.01, 1e-3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_PLAIN = b".,;:'\"-()?"
_BANG = b"!"
_ODD = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'\"-()?!")
_ODD_WORD = frozenset(map(chr, _ODD + _BANG))


def measures(text: str) -> list[float]:
    """What the model sees of a text: shares and logarithms of counts, all defined for empty texts."""
    raw = text.encode("utf-8", "replace")
    size = len(raw) + 1.0
    upper, lower, digit, plain, bang, odd = ((len(raw) - len(raw.translate(None, k))) for k in (_UPPER, _LOWER, _DIGIT, _PLAIN, _BANG, _ODD))
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x]
    if n:
        counts = Counter(words)
        top = max(counts.values()) / n
        kinds = len(counts) / n
        again = sum(map(eq, words, words[1:])) / n
        shouted = sum(map(str.isupper, words)) / n
        marked = sum(w[-1] in _ODD_WORD for w in words) / n
        bare = sum(len(w) == 1 and w in _ODD_WORD for w in words) / n
        mean = (len(text) - text.count(" ")) / n
    else:
        top = kinds = again = shouted = marked = bare = mean = 0.0
    return [
        np.log1p(n), np.log1p(len(text)), upper / size, lower / size, digit / size, plain / size, bang / size, odd / size,
        np.log1p(100 * odd / size), np.log1p(100 * bang / size), top, kinds, kinds * np.log1p(n), again, shouted, marked, bare,
        np.log1p(mean), len(lines) / (n + 1.0), len(set(lines)) / (len(lines) + 1.0), float(n == 0), np.sqrt(again), np.sqrt(marked), np.sqrt(bare),
    ]


def held_out(ident: Column) -> Column:
    """Whether labels of the row are for testing only."""
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """A network with one hidden layer on standardised measures."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray], prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def plain(self) -> tuple:
        return self.mean, self.scale, self.weights, self.prior


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def risk(w: list[np.ndarray], zp: np.ndarray, zu: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray], bool]:
    """The non-negative risk of a network on standardised positives and unlabelled rows, what a step
    goes against, and whether that is the risk's own gradient. Where the estimate of the negatives'
    loss falls below zero, which it can't be, it isn't: the step takes the estimate back up.
    Without a prior it is the risk of telling positives from unlabelled rows.
    """
    hp, hu = np.tanh(zp @ w[0] + w[1]), np.tanh(zu @ w[0] + w[1])
    fp, fu = hp @ w[2] + w[3], hu @ w[2] + w[3]
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    own = True
    if prior is None:
        value = _soft(-fp).mean() + _soft(fu).mean()
        gp, gu = (sp - 1) / len(fp), su / len(fu)
    else:
        rest = _soft(fu).mean() - prior * _soft(fp).mean()
        value = prior * _soft(-fp).mean() + max(0.0, rest)
        own = rest >= 0
        gp, gu = ((prior * (sp - 1) - prior * sp) / len(fp), su / len(fu)) if own else (prior * sp / len(fp), -su / len(fu))
    dp, du = np.outer(gp, w[2]) * (1 - hp**2), np.outer(gu, w[2]) * (1 - hu**2)
    return float(value), [zp.T @ dp + zu.T @ du, dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu, np.asarray(gp.sum() + gu.sum())], bool(own)


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = STEPS) -> Model:
    """Adam on the non-negative risk; without a prior, on positives against unlabelled rows."""
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    draw = np.random.default_rng(7)
    w = [draw.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.25, HIDDEN), np.zeros(())]
    m1, m2 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    for step in range(1, steps + 1):
        _, grads, _ = risk(w, zp, zu, prior)
        for i in (0, 2):
            grads[i] = grads[i] + DECAY * w[i]
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior or 0.0)


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows: the least ratio of the tails of both, of a
    score that tells them apart, over thresholds with half of the positives or more above. Where
    no negative scores high, that ratio is the share itself. Each half of the rows is scored by a
    model fitted on the other, since a model tells apart the very rows that it has seen."""
    draw = np.random.default_rng(3)
    half_p, half_u = draw.permutation(len(pos)) % 2, draw.permutation(len(unl)) % 2
    found = []
    for k in (0, 1):
        if not all((h == j).any() for h in (half_p, half_u) for j in (0, 1)):
            return 0.5
        g = _fit(pos[half_p != k], unl[half_u != k], None, 200)
        sp, su = np.sort(g.logits(pos[half_p == k])), np.sort(g.logits(unl[half_u == k]))
        at = np.quantile(sp, np.linspace(0.0, 0.5, 50))
        above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
        above_u = 1 - np.searchsorted(su, at, "left") / len(su)
        found.append(np.min(above_u / above_p))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", sample: int = SAMPLE,
) -> Model:
    """The model. Rows that are held out are in neither sample; conflicting labels don't count.

    Without any positive (or any document) the model scores every text 1, so that nothing is
    thrown away for want of labels.
    """
    spark = docs.sparkSession
    small_batches(spark)
    good = labels.select(quoted(label_id_col).cast("long").alias("id"), quoted(label_col).alias("y")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    good = good.groupBy("id").agg(F.min("y").alias("y")).where("y = 1")
    ids = docs.select(quoted(id_col).cast("long").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    by = F.md5(F.concat(F.lit("s"), F.col("id").cast("string")))
    few = [x.select("id").orderBy(by, "id").limit(sample).select("id", F.lit(k).alias("part")) for k, x in enumerate((good, ids))]
    wanted: dict[int, list[int]] = {}
    for r in few[0].union(few[1]).collect():  # 2 * sample ids at most
        wanted.setdefault(r["id"], []).append(r["part"])
    shared = spark.sparkContext.broadcast(wanted)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for b in batches:
            hit = [i for i, x in enumerate(b.column(0).to_pylist()) if x in parts]
            rows = b.take(pa.array(hit, pa.int64()))
            found = [(p, x, h, m) for x, t, h in zip(*(rows.column(k).to_pylist() for k in range(3))) for m in [measures(t)] for p in parts[x]]
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], ["part", "id", "h", "m"])

    texts = docs.select(quoted(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), F.md5(text_of(text_col)).alias("h"))
    # of the rows of an id, that with the least hash of its text
    rows = texts.mapInArrow(picked, "part int, id long, h string, m array<double>").groupBy("part", "id").agg(F.min(F.struct("h", "m"))["m"].alias("m")).select("part", "m").collect()
    width = len(measures(""))
    pos, unl = (np.array([r["m"] for r in rows if r["part"] == k], float).reshape(-1, width) for k in (0, 1))
    # the order rows arrive in is not fixed; the model must be
    pos, unl = (x[np.lexsort(x.T)] for x in (pos, unl))
    if not len(pos) or not len(unl):
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.asarray(30.0)], 1.0)
    prior = estimate_prior(pos, unl)
    return _fit(pos, unl, prior)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text, between 0 and 1; null counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*shared.value)
        for b in batches:
            x = np.array([measures(t) for t in b.to_pylist()], float)
            yield pa.array(m.scores(x) if len(x) else [], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(run, "double")
    return docs.withColumn(score_col, score(text_of(text_col)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return with_score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns and nothing else."""
    name = free_name(docs, "score_")
    scored = with_score(docs, fit(docs, labels, id_col, text_col), text_col, name)
    return scored.where(quoted(name) >= threshold).drop(name)
