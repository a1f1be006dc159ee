import re
from collections import defaultdict

import corpus_pipeline
from leafmill.llm import quality

from ..conftest import SF
from .test_match import WORD, jaccard_classes  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    # the classifier's own scores decide; the rest is plain Python
    score = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns
    left = {i for i in rows if score[i] >= 0.7}
    assert {r.doc_id for r in kept.collect()} == left

    good = docs.where(docs.doc_id.isin(list(left)))
    groups = defaultdict(list)
    for i in left:
        groups[re.sub(r"[\x20\x09-\x0D]", "", rows[i].text)].append((-len(rows[i].text), i))
    left = {min(v)[1] for v in groups.values()}
    kept = stages["exact_dedup"](spark, good, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == left

    good = docs.where(docs.doc_id.isin(list(left)))
    text, _, classes = jaccard_classes([(i, rows[i].text) for i in left])
    left = {min(i for v in c for i in text[v]) for c in classes.values()}
    kept = stages["ngram_jaccard"](spark, good, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == left

    good = docs.where(docs.doc_id.isin(list(left)))
    items = [WORD.findall(r.text.translate(LOWER)) for r in bench.collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}
    lengths = {len(w) for w in windows}

    def dirty(t):
        w, hit = WORD.findall(t.translate(LOWER)), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        in_a_row = max((len(run) for run in "".join("x" if i in hit else " " for i in range(len(w))).split()), default=0)
        return in_a_row >= 13 or bool(hit) and 20 * len(hit) >= len(w)

    left = {i for i in left if not dirty(rows[i].text)}
    kept = stages["decontamination"](spark, good, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == left

    good = docs.where(docs.doc_id.isin(list(left)))
    mixed = stages["mixing"](spark, good, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in left}
    assert {r.doc_id for r in mixed} <= left and all(r.taken == r.passes * size[r.doc_id] > 0 for r in mixed)
    per = defaultdict(int)
    for r in mixed:
        per[r.source] += r.taken
    target = {r.source: r.target for r in mixed}
    assert all(abs(per[s] - target[s]) <= max(size.values()) for s in per)

    whole = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {r.doc_id for r in mixed}


def test_a_passage_in_a_long_document_is_found(spark, tmp_path):
    """One planted passage in 2,000 words is far below a twentieth; the document goes all the same."""
    item = " ".join(f"item{i}" for i in range(16))
    words = [f"word{i}" for i in range(2_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:900] + item.split() + words[900:])), (3, " ".join(words + item.split()[:12])), (4, "short words"), (5, "the short words"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item), (2, "short words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6]


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_of_messy_rows(spark, messy, tmp_path):
    """Nulls anywhere, repeated rows, long and empty texts, columns that are named as ours."""
    labels = spark.createDataFrame([(1, 1, None), (7, 1, 1), (8, 1, 0), (9, 0, 0), (None, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (None, None), (2, ""), (2, "no id here but words")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = messy.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, messy, str(tmp_path))
        assert name == "mixing" or got.columns == messy.columns, name
        n = got.count()
        assert 0 < n <= rows, name
        again = sorted(str(r.doc_id) for r in stage(spark, messy.repartition(5), str(tmp_path)).collect())
        assert again == sorted(str(r.doc_id) for r in got.collect()), name
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy, str(tmp_path)).count() > 0, name
