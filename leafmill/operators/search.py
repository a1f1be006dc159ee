"""The search for the best quality that fits a byte budget, for many documents at once.

The state is a row per document; a round probes every open document at its own quality and
edge, sums what its images would take, and moves the bounds. There are at most ROUNDS rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: quality's range, the least edge, and the number of probes.
LOW_QUALITY, HIGH_QUALITY, MIN_EDGE, MAX_EDGE, ROUNDS = 15, 100, 400, 65_535, 12


def start_edge(edge: Column) -> Column:
    return F.least(F.greatest(F.coalesce(edge, F.lit(MIN_EDGE)), F.lit(MIN_EDGE)), F.lit(MAX_EDGE))


def next_quality(attempt: Column, low: Column, high: Column) -> Column:
    """The top at the very first, then the middle."""
    q = F.when(attempt == 0, high).otherwise(F.floor((low + high) / 2))
    return F.least(F.greatest(q, F.lit(LOW_QUALITY)), F.lit(HIGH_QUALITY)).cast("int")


def shrunk_edge(edge: Column) -> Column:
    return F.greatest(F.floor(edge * 3 / 4), F.lit(MIN_EDGE)).cast("int")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body with the value of x, which is worked out once."""
    return F.element_at(F.transform(F.array(x), body), 1)


_PROBE = "struct<estimate:bigint,quality:int,edge:int>"


def bisect(docs: DataFrame, doc: str, size_at: Callable[[Column, Column], Column], rounds: int = ROUNDS) -> DataFrame:
    """docs (doc, target, constant, max_edge, and what size_at needs) with the outcome.

    size_at(quality, edge): a document's image bytes at a probe, as an expression. Outcome: best_quality
    and best_edge (of the last probe that fits, else of the smallest), estimate, met, attempts. A spent
    range without a fit goes on with a smaller edge; two misses in a row of the same edge and size
    spend the range, as quality doesn't matter then. Each round folds into one state a row.
    """
    struct = lambda **x: F.struct(*[v.alias(k) for k, v in x.items()])
    none = F.lit(None)
    begin = struct(
        edge=start_edge(F.col("max_edge")).cast("int"), low=F.lit(LOW_QUALITY), high=F.lit(HIGH_QUALITY), attempts=F.lit(0), done=F.lit(False),
        best=none.cast(_PROBE), least=none.cast(_PROBE), last=none.cast(_PROBE), last_fit=F.lit(False),
    )

    def placed(s: Column) -> Column:
        spent = s["low"] > s["high"]
        over = s["done"] | spent & (s["best"].isNotNull() | (s["edge"] <= MIN_EDGE))
        again = spent & ~over
        pick = lambda x, y: F.when(again, x).otherwise(y)
        return struct(over=over, edge=pick(shrunk_edge(s["edge"]), s["edge"]), low=pick(F.lit(LOW_QUALITY), s["low"]), high=pick(F.lit(HIGH_QUALITY), s["high"]))

    def moved(s: Column, at: Column, p: Column) -> Column:
        fits = p["estimate"] <= F.col("target")
        blind = F.coalesce((s["last"]["edge"] == p["edge"]) & (s["last"]["estimate"] == p["estimate"]), F.lit(False)) & ~s["last_fit"] & ~fits
        smaller = s["least"].isNull() | (p["estimate"] < s["least"]["estimate"])
        high = F.when(blind, at["low"] - 1).when(fits, at["high"]).otherwise(p["quality"] - 1)
        return struct(
            edge=p["edge"], low=F.when(fits, p["quality"] + 1).otherwise(at["low"]), high=high, attempts=s["attempts"] + 1, done=F.lit(False),
            best=F.when(fits, p).otherwise(s["best"]), least=F.when(smaller, p).otherwise(s["least"]), last=p, last_fit=fits,
        )

    def step(s: Column, _: Column) -> Column:
        def probed(at: Column) -> Column:
            quality = next_quality(s["attempts"], at["low"], at["high"])
            return _let(quality, lambda q: struct(estimate=(F.col("constant") + size_at(q, at["edge"])).cast("long"), quality=q, edge=at["edge"]))

        rest = {k: s[k] for k in ("edge", "low", "high", "attempts")} | {"done": F.lit(True)} | {k: s[k] for k in ("best", "least", "last", "last_fit")}
        return _let(placed(s), lambda at: F.when(at["over"], struct(**rest)).otherwise(_let(probed(at), lambda p: moved(s, at, p))))

    end = docs.withColumn("end_", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step))
    chosen = F.coalesce("end_.best", "end_.least")
    return end.select(
        doc, "target", chosen["quality"].alias("best_quality"), chosen["edge"].alias("best_edge"), chosen["estimate"].alias("estimate"),
        F.col("end_.best").isNotNull().alias("met"), F.col("end_.attempts").alias("attempts"),
    )
