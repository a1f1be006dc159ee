import pytest

LONG = "lorem ipsum dolor, sit amet " * 2000
#: id, text, source: nulls, empty and blank texts, copies that differ in white space, ties, rows repeated with their id, a very long text
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "b"), (2, "alpha  beta gamma\tdelta epsilon zeta eta theta", "b"),
    (3, "alpha beta gamma delta epsilon zeta eta theta", None), (3, "alpha beta gamma delta epsilon zeta eta theta", None),
    (4, None, "a"), (5, "", "a"), (6, " \n\t ", "a"), (None, "no id here but words enough for shingles of five", "a"), (None, None, None),
    (7, LONG, "hot"), (8, LONG + "x", "hot"), (9, "one", "hot"), (10, "one two", "z"), (11, "été naïve \U0001f600 café straße coöperate", "z"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Awkward documents, with columns whose names the operators use inside."""
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    d = spark.createDataFrame([(i, t, s, "en", len(t or "")) for i, t, s in ROWS], schema)
    clash = ("digest", "key", "rank", "size", "uid", "pos", "target", "n", "rep", "bucket", "spans", "score_", "nth_", "digest_", "key_", "doubt_", "own", "packed", "NTH")
    for c in clash:
        d = d.selectExpr("*", f"'x' as `{c}`")
    return d


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.where("false")
