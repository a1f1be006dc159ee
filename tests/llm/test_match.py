import re
from collections import defaultdict
from fractions import Fraction

import pytest

from leafmill.llm import decontamination as dec
from leafmill.llm import ngram_join as ng

from .conftest import LONG, ROWS

ITEMS = [
    (1, "alpha beta gamma delta"), (2, None), (3, ""), (4, "One!"), (4, "two"), (None, "words enough for shingles"),
    (5, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (6, "straße COÖPERATE"), (7, "straße COöPERATE"),
]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, window=13):
    w, hit, items = words(text), set(), set()
    for ident, t in ITEMS:
        q = words(t)
        for i in range(max(1, len(q) - window + 1)) if q else ():
            p = q[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    items.add("" if ident is None else str(ident))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 30}, {"max_terms": 0}, {"segment_words": 5}])
def test_contamination_against_brute_force(spark, messy, options):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, sum(b - a for a, b in r.runs), list(r["items"])) for r in dec.contamination(messy, items, **options).collect())
    assert got == sorted((str(i), *brute(t)) for i, t, _ in ROWS)


def test_contamination_of_nothing(spark, messy, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dec.contamination(nothing, items).count() == 0
    got = dec.digest(dec.contamination(messy, items.where("false"))).collect()
    assert len(got) == len(ROWS) and not any(r.contaminated for r in got)


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x the quick brown fox y"), (2, "fox z brown quick the end"), (3, "fox only")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "the quick brown fox")], "item_id long, text string")
    got = {(r.doc_id, r.kind) for r in dec.matches(docs, items).collect()}
    assert got == {(1, "phrase"), (2, "near")}


def test_keep_clean(spark, messy):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dec.keep_clean(messy, items)
    assert kept.columns == messy.columns
    clean = [str(i) for i, t, _ in ROWS if not (brute(t)[1] and 20 * brute(t)[1] >= brute(t)[0])]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(clean)


def jaccard_classes(rows, t=Fraction(4, 5)):
    sets, text = {}, defaultdict(list)
    for i, x in rows:
        w = tuple((x or "").encode().split())
        text[w].append(i)
        sets[w] = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
    keys = list(sets)
    links = defaultdict(set)
    for a in keys:
        for b in keys:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                links[a].add(b)
    out = {}
    for w in keys:
        seen, todo = {w}, [w]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[w] = seen
    return text, links, out


def check_classes(got, rows):
    text, links, classes = jaccard_classes(rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for w, ids in text.items():
        known = [i for i in ids if i is not None]
        if not known:
            continue
        r = next(x for x in by[known[0]])
        assert r.text_id == min(known) and r.n_links == len(links[w]) and r.n_copies == len(ids)
        near = [i for v in classes[w] for i in text[v] if i is not None]
        assert r.class_id == min(near)


def test_similar_classes_of_messy_rows(messy, nothing):
    rows = [(i, t) for i, t, _ in ROWS]
    got = ng.similar_classes(messy).collect()
    check_classes(got, rows)
    assert ng.similar_classes(nothing).count() == 0


@pytest.mark.parametrize("blocks", [(512, 128), (4, 3)])
def test_similar_classes_of_a_large_group(spark, blocks):
    import random

    draw = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(draw.randrange(3)):
            w[draw.randrange(60)] = f"x{draw.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"y{draw.randrange(500)}" for _ in range(30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_classes(ng.similar_classes(docs, block_signatures=blocks[0], block_texts=blocks[1]).collect(), rows)


def near_copies(n, words, edits, seed):
    """Texts of that many words that differ from one by up to so many edits; at the ends, some that differ more."""
    import random

    draw = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{k}" for k in range(words)]
        for _ in range(draw.randrange(edits + 1) if i % 10 else draw.randrange(words // 4)):
            w[draw.randrange(words)] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "words", "edits", "block"), [(150, 80, 3, 8), (120, 60, 8, 5), (64, 5, 2, 4)])
def test_large_groups_against_brute_force(spark, monkeypatch, n, words, edits, block):
    monkeypatch.setattr(ng, "MEET", 1)
    monkeypatch.setattr(ng, "LEADERS", 2)
    monkeypatch.setattr(ng, "PIVOT", 3)
    rows = near_copies(n, words, edits, n)
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(5)
    check_classes(ng.similar_classes(docs, block_signatures=block, block_texts=block).collect(), rows + rows[:5])


def test_rows_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    """Rows that are written, on the way, for a group of near copies of twice and four times the size."""
    counts = {}
    for n in (400, 800, 1600):
        total = 0

        def counted(df, label, plain=ng.stored):
            nonlocal total
            out = plain(df, label)
            total += out.count()
            return out

        def dealt(df, odd, n_odd, n_even, block, plain=ng._dealt):
            nonlocal total
            out = plain(df, odd, n_odd, n_even, block)
            total += out.count()
            return out

        monkeypatch.setattr(ng, "stored", counted)
        monkeypatch.setattr(ng, "_dealt", dealt)
        docs = spark.createDataFrame([(i, t) for i, t in near_copies(n, 120, 2, 1) if i % 10], "doc_id long, text string")
        got = ng.similar_classes(docs, block_signatures=32, block_texts=32)
        assert {r.class_id for r in got.collect()} == {1}
        monkeypatch.undo()
        counts[n] = total
    assert counts[800] < 2.3 * counts[400] and counts[1600] < 2.3 * counts[800]


def test_keep_one_of_each(spark, messy):
    kept = ng.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 1 in ids and 8 not in ids and 7 in ids and ids.count(None) == 2


@pytest.mark.parametrize("texts", [["one two"], ["", None], ["a"], ["a b c d e"], ["a b c d e", "a b c d e"]])
def test_tables_of_few_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check_classes(ng.similar_classes(docs).collect(), list(enumerate(texts)))


def test_pruning_bounds():
    need = ng.least_matches(0.8, 1e-6)
    assert need[0] == 0 and need[30] < 24 and need[150] < 120 and need == sorted(need)


def test_signatures_estimate_similarity():
    a = b" ".join(b"w%d" % k for k in range(400))
    b = b" ".join(b"w%d" % k for k in range(40, 440))
    sig, counts = ng.signatures([a, b, b"", b"one two"])
    assert counts.tolist() == [396, 396, 0, 1]
    assert abs((sig[0] == sig[1]).mean() - 356 / 436) < 0.15
    assert len(LONG) > 50_000


def test_texts_that_share_an_id(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda w: " ".join(w[:-1] + ["other"])
    lone = " ".join(f"c{i}" for i in range(60))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (5, near(a)), (5, near(b)), (5, lone), (6, lone + " x"), (7, lone + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text_id, r.class_id, r.n_links, r.n_copies) for r in ng.similar_classes(docs).collect())
    assert got == [(1, 1, 1, 1, 1), (2, 2, 2, 1, 1), (5, 5, 1, 1, 1), (5, 5, 2, 1, 1), (5, 5, 5, 1, 1), (6, 6, 5, 1, 2), (7, 6, 5, 1, 2)]
    assert sorted((r.doc_id, r.text) for r in ng.keep_one_of_each(docs).collect()) == [rows[0], rows[1], rows[4]]
