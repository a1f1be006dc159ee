"""Tables of one row or of nothing but nulls, through every operator and stage."""

import pytest

import corpus_pipeline
from leafmill.llm import chat, decontamination, exact_dedup, html_text, mixing, ngram_join, quality, repeats, secrets, warc

TABLES = {
    "one null": [(None, None, None)], "one word": [(1, "x", "a")], "null texts": [(i, None, None) for i in range(5)],
    "one row five times": [(1, "the same words again and again", "a")] * 5, "ids shared": [(1, "one text", "a"), (1, "another text of its own", "b")],
    "huge word": [(1, "y" * 300_000, "a"), (2, "y" * 299_999, "a")], "not ASCII": [(1, "é\U0001f600中 " * 90, "\U0001f600"), (-5, "\u0000 ", "é")],
}


@pytest.mark.parametrize("name", TABLES)
def test_every_operator(spark, tmp_path, name):
    rows = TABLES[name]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    labels = spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "x"), (None, None)], "item_id long, text string")
    pages = docs.selectExpr("doc_id as page_id", "source as url", "text as html")
    turns = docs.selectExpr("doc_id as conv_id", "doc_id as turn", "source as role", "text")
    for found in (
        mixing.mix(docs), exact_dedup.exact_dedup(docs), ngram_join.similar_classes(docs), decontamination.digest(decontamination.contamination(docs, items)),
        html_text.extract(pages), repeats.digest(repeats.remove_repeats(docs)), quality.score_documents(docs, labels), warc.round_trip(pages), secrets.digest(secrets.find_secrets(docs)),
    ):
        assert found.count() == len(rows), found.columns
    assert 0 < chat.format_conversations(turns).count() <= len(rows)
    if name not in ("one null", "ids shared"):
        return
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage_name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, str(tmp_path))
        assert stage_name == "mixing" or kept.columns == docs.columns
        assert kept.count() <= len(rows)
