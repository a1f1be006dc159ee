import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, mixing

from .conftest import ROWS

WS = re.compile(r"[\x20\x09-\x0D]")


def norm(t):
    return WS.sub("", t or "")


def test_exact_against_brute_force(messy):
    got = exact_dedup.exact_dedup(messy).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want = {k: (min(v)[3], len(v)) for k, v in groups.items()}
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    assert sorted(str(r.keep_id) for r in got if r.kept) == sorted(str(v[0]) for v in want.values())


def test_exact_salts_change_nothing(messy):
    key = lambda d: sorted(map(str, d.collect()))
    assert key(exact_dedup.exact_dedup(messy, salts=1)) == key(exact_dedup.exact_dedup(messy, salts=7))


def test_keep_distinct_rows(messy, nothing):
    kept = exact_dedup.keep_distinct(messy)
    assert kept.columns == messy.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, _ in ROWS})
    assert exact_dedup.keep_distinct(nothing).count() == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0


def sizes():
    return {k: [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, s in ROWS if s == k] for k in {s for *_, s in ROWS}}


def test_mix_targets_and_bounds(messy, nothing):
    got = mixing.mix(messy).collect()
    assert len(got) == len(ROWS)
    per = {k: sum(v) for k, v in sizes().items()}
    total = sum(per.values())
    for r in got:
        assert r.source_size == per[r.source]
        assert 0 <= r.taken <= 3 * r.size
        assert r.target <= 3 * r.source_size + 1e-9
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(total)
    # by code point, null last, weights 1, 2, 3, 1, 2: those below their cap are in proportion
    weight = dict(zip(sorted(k for k in per if k is not None) + [None], (1, 2, 3, 1, 2)))
    level = {k: targets[k] / weight[k] for k in per if targets[k] < 3 * per[k] - 1e-9}
    assert max(level.values()) == pytest.approx(min(level.values()))
    assert sum(r.taken for r in got) <= total
    assert mixing.mix(nothing).count() == 0


def test_mix_is_reproducible_and_near_target(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', case when id % 3 = 0 then 0 else id % 5 end) as source")
    a, b = (sorted(map(tuple, mixing.mix(x).collect())) for x in (d, d.repartition(7)))
    assert a == b
    per = defaultdict(lambda: [0, 0.0])
    for _, source, _, _, target, taken, _ in a:
        per[source][0] += taken
        per[source][1] = target
    assert all(abs(t - x) <= 7 for t, x in per.values())


def test_running_total_at_any_depth(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 1)
    monkeypatch.setattr(mixing, "FAN", 2)
    d = spark.range(300).selectExpr("id % 2 as g", "id as k", "cast(rand(3) * (1L << 60) as long) as p", "id % 5 as v").cache()
    d.count()
    got = mixing.running_total(d, "g", "p", "v", ["k"], "c", 150).orderBy("g", "p").collect()
    sums = defaultdict(int)
    for r in got:
        sums[r.g] += r.v
        assert r.c == sums[r.g]


def test_many_sources(spark, monkeypatch):
    """Ranks and targets of more sources than a leaf holds, against the same sums in plain Python."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 4)
    names = [None, "", "\U0001f600", "é"] + [f"https://host-{i % 7}{'x' * (i % 3)}.example/{i}" for i in range(150)]
    rows = [(i, " ".join("w" * (1 + i * 7 % 40) for _ in range(1)) + " w" * (i * 13 % 29), s) for i, s in enumerate(names)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    sizes = {s: len((t or "").split()) for _, t, s in rows}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, level = sum(sizes.values()), None
    todo = sorted(order, key=lambda s: (3 * sizes[s] / weight[s], order.index(s)))
    for k, s in enumerate(todo):
        level = left / sum(weight[x] for x in todo[k:])
        if level <= 3 * sizes[s] / weight[s]:
            break
        left -= 3 * sizes[s]
    assert len(got) == len(rows)
    assert all(r.target == pytest.approx(min(3 * sizes[r.source], level * weight[r.source])) and r.source_size == sizes[r.source] for r in got)


def test_native_plans(spark, messy):
    for d in (exact_dedup.exact_dedup(messy), mixing.mix(messy)):
        assert "Python" not in d._jdf.queryExecution().toString() and "Arrow" not in d._jdf.queryExecution().toString()
    assert isinstance(mixing.shuffled_position(F.col("doc_id")), type(F.col("x")))
