import math

import pytest
from pyspark.sql import functions as F

from leafmill.functions import config, presets, scalars
from leafmill.operators import graph, images, scoring, search
from leafmill.sources.pdf_model import PdfError
from leafmill.streaming import progress


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_presets_and_settings(spark):
    got = {r.preset: r for r in presets.preset_table(spark).collect()}
    assert {k: (r.image_quality, r.max_image_size_px, r.strip_metadata, r.subset_fonts) for k, r in got.items()} == {
        "conservative": (72, 2700, False, False), "balanced": (60, 2200, True, False), "maximum": (46, 1700, True, True),
    }
    assert [r[0] for r in values(spark, [("LIGHT",), ("aggressive",), ("x",), (None,)], "p string", presets.preset_of("p"))] == ["conservative", "maximum", "balanced", "balanced"]
    assert [r[0] for r in values(spark, [("CCITT G4",), ("jpg",), (None,), ("x",)], "p string", presets.bilevel_of("p"))] == ["g4", "jpeg", "g4", "g4"]
    s = presets.resolve({"image_quality": F.col("q")}, {"image_quality": F.lit(33), "max_image_size_percent": F.lit(1)})
    assert values(spark, [(200,), (None,)], "q int", s["image_quality"], s["max_image_size_px"], s["size_percent"]) == [(100, 200, 5), (33, 200, 5)]
    cap = presets.document_cap(F.lit(1000), F.col("p"), F.col("e"))
    assert [r[0] for r in values(spark, [(50, 5000), (None, 5000), (50, 0), (100, 90000)], "p int, e int", cap)] == [2500, 1000, 1600, 8000]


def test_migrations(spark):
    got = values(spark, [(1, False, "jpeg"), (1, True, "JPG"), (2, False, "g4"), (None, False, "jpeg"), (3, None, None)], "v int, c boolean, b string",
                 presets.migrated_cmyk(F.col("v"), F.col("c")), presets.migrated_bilevel(F.col("v"), F.col("b")))
    assert got == [(None, None), (True, None), (False, "g4"), (False, "jpeg"), (None, None)]


def test_config_files(tmp_path):
    p = str(tmp_path / "a" / "profile.json")
    assert set(config.read_profile(p).values()) == {None}
    config.write_profile(p, {"preset": "maximum", "bilevel_codec": "jpeg", "other": 1})
    assert config.read_profile(p)["bilevel_codec"] == "jpeg"
    (tmp_path / "old.json").write_text('{"version": 1, "cmyk_conversion": false, "bilevel_codec": "jpg", "image_quality": 50}')
    old = config.read_profile(str(tmp_path / "old.json"))
    assert (old["cmyk_conversion"], old["bilevel_codec"], old["image_quality"]) == (None, None, 50)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(PdfError):
        config.read_profile(str(tmp_path / "bad.json"))
    config.write_presets(p, {"balanced": {"image_quality": 9}, "nope": {}})
    assert set(config.read_presets(p)) == {"balanced"}
    config.clear_presets(p)
    config.clear_presets(p)


def test_sizes_and_times(spark):
    sizes = ["5MB", "500K", "1.5 GiB", "0", "-1", "inf", "1 lightyear", None]
    assert [r[0] for r in values(spark, [(s,) for s in sizes], "s string", scalars.parse_size(F.col("s")))] == [5 << 20, 512000, 3 << 29, 0, None, None, None, None]
    n = F.col("n")
    got = values(spark, [(0,), (1536,), (10240,), (5 << 20,), (None,)], "n long", scalars.human_size(n), scalars.human_bytes(n), scalars.format_bytes(n))
    assert got == [("0 B", "0B", "0 B"), ("1.5 KB", "1.50KB", "1.50 KB"), ("10 KB", "10.00KB", "10.0 KB"), ("5.0 MB", "5.00MB", "5.00 MB"), got[-1]] and got[-1][2] == "--"
    assert [r[0] for r in values(spark, [(830,), (4200,), (125000,), (-1,), (None,)], "n long", scalars.format_duration(n))] == ["830 ms", "4.2 s", "2 min 05 s", "--", "--"]
    assert [r[0] for r in values(spark, [("a/b\\c.pdf",), ("x/",)], "p string", scalars.file_name(F.col("p")))] == ["c.pdf", "x/"]
    filled = scalars.fill_template(F.lit("{a} and {b} {c}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    assert values(spark, [(1,)], "n int", filled) == [("1 and 2 {c}",)]


def test_even_sample(spark):
    for n in (1, 5, 24, 25, 47, 200, 1001):
        got = [r.page_index for r in scoring.even_sample(spark.range(n).selectExpr("0 as d", "id"), "d", ["id"]).collect()]
        want = range(n) if n <= 24 else sorted({math.floor(k * (n - 1) / 23 + 0.5) for k in range(24)})
        assert sorted(got) == list(want), n


def test_recommended_edge(spark):
    e = F.col("e")
    rows = [([100, 2000, 3000, 9000],), ([],), ([900],)]
    got = values(spark, rows, "e array<int>", *[scoring.recommended_edge(F.lit(p), e) for p in presets.PRESETS])
    assert got == [(3000, 2600, 2100), (2700, 2200, 1700), (900, 800, 800)]
    flat = spark.createDataFrame([(0, x) for x in (100, 2000, 3000, 9000)], "d int, e int")
    assert scoring.nearest_rank_edges(flat, "d", "e").collect() == [(0, 3000)]


def test_savings_bounds(spark):
    s = scoring.estimated_savings(F.col("p"), F.col("i"), F.col("n"))
    rows = [("balanced", 0, 0), ("maximum", 100, 100), ("balanced", 0, 1000), ("balanced", 500, 1000)]
    assert [r[0] for r in values(spark, rows, "p string, i long, n long", s)] == pytest.approx([5.0, 66.0, 5.0, 28.5])


def test_actionable_and_reasons(spark):
    c = F.col
    rows = [(False, True, 100_000, 3000, 9_000_000, False, False), (True, True, 6144, 3000, 9_000_000, False, False), (False, False, 100_000, 3000, 9_000_000, False, False),
            (False, True, 100_000, 90, 8100, False, False), (False, True, 60_000, 1000, 900_000, False, False), (False, True, 60_000, 1000, 900_000, False, True),
            (True, True, 90_000, 500, 250_000, False, False), (False, True, 100_000, None, None, False, False), (False, True, 100_000, 3000, 9_000_000, True, False)]
    yes = images.actionable(c("j"), c("s"), c("b"), c("e"), c("p"), F.lit(1600), F.lit(65_536), c("k"), c("g"))
    assert [r[0] for r in values(spark, rows, "j boolean, s boolean, b long, e long, p long, k boolean, g boolean", yes)] == [True, False, False, False, False, True, False, True, False]


def test_graph_operators(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 9, 1)], "doc int, src int, dst int")
    roots = spark.createDataFrame([(0, 1)], "doc int, node int")
    assert sorted(tuple(r) for r in graph.reachable(edges, roots, ["doc"]).collect()) == [(0, 1, 0), (0, 2, 1), (0, 3, 2)]
    pages = spark.createDataFrame([(0, 5, 4, None), (0, 6, 3, "own"), (0, 7, 8, None)], "doc int, node int, parent int, value string")
    up = spark.createDataFrame([(0, 4, 3, None), (0, 3, None, "top")], "doc int, node int, parent int, value string")
    assert sorted(tuple(r) for r in graph.inherited(pages, up, ["doc"]).collect()) == [(0, 5, "top"), (0, 6, "own"), (0, 7, None)]
    e = spark.createDataFrame([(0, i, s) for i, s in enumerate((50, 40, 30, 20))], "g int, i int, s int")
    assert [r.i for r in graph.evictions(e, "g", "s", ["i"], 60).where("evicted").collect()] == [0, 1]


def test_bisection_against_a_loop(spark):
    def size(q, e, m):
        return int(m * (0.2 + 0.8 * q / 100) * min(e / 3000, 1) ** 2)

    def search_one(target, m):
        edge, low, high, best, least, last, n_tried = 3000, 15, 100, None, None, None, 0
        for attempt in range(12):
            if low > high:
                if best or edge <= 400:
                    break
                edge, low, high = max(edge * 3 // 4, 400), 15, 100
            q = (low + high) // 2 if attempt else 100  # the top at the very first only
            n, n_tried = size(q, edge, m), n_tried + 1
            if least is None or n < least[0]:
                least = (n, q, edge)
            if n <= target:
                best, low = (n, q, edge), q + 1
            else:
                high = low - 1 if last == (edge, n, False) else q - 1
            last = (edge, n, n <= target)
        return (best or least)[1:], best is not None, n_tried

    rows = [(i, t, 0, 3000, 100_000) for i, t in enumerate((200_000, 100_000, 99_000, 50_000, 30_000, 20_000, 5_000, 10))]
    d = spark.createDataFrame(rows, "doc int, target long, constant long, max_edge int, m long")
    at = lambda q, e: F.floor(F.col("m") * (0.2 + 0.8 * q / 100.0) * F.pow(F.least(e.cast("double") / 3000, F.lit(1.0)), 2))
    got = {r.doc: ((r.best_quality, r.best_edge), r.met, r.attempts) for r in search.bisect(d, "doc", at).collect()}
    assert got == {i: search_one(t, 100_000) for i, t, *_ in rows}
    # where quality changes nothing, two misses spend a range
    size = lambda q, e, m: int(m * min(e / 3000, 1) ** 2)
    at = lambda q, e: F.floor(F.col("m") * F.pow(F.least(e.cast("double") / 3000, F.lit(1.0)), 2))
    got = {r.doc: ((r.best_quality, r.best_edge), r.met, r.attempts) for r in search.bisect(d, "doc", at).collect()}
    assert got == {i: search_one(t, 100_000) for i, t, *_ in rows}


def test_throttled_progress(spark):
    rows = [(t, k, float(p)) for t in (1, 2) for k, p in enumerate((1, 3, 4, 6, 6.5, 50, 51, 99, 100))]
    d = spark.createDataFrame(rows, "task int, k int, percent double")
    got = sorted((r.task, r.percent) for r in progress.throttled(d, "task", ["k"], "percent").collect())
    assert got == [(t, float(p)) for t in (1, 2) for p in (3, 6, 50, 99, 100)]


def test_throttled_stream(spark, tmp_path):
    rows = [(1, float(p)) for p in (1, 3, 4, 6, 100)]
    spark.createDataFrame(rows, "task int, percent double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task int, percent double").parquet(str(tmp_path / "in"))
    q = progress.throttled_stream(stream, "task", "percent").writeStream.format("memory").queryName("told").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.percent for r in spark.table("told").collect()) == [3.0, 6.0, 100.0]


def test_stored_queues(spark):
    from leafmill.functions import records

    rows = [('{"version":1,"entries":[{"sourcePath":"a.pdf","settings":{"preset":"maximum"}},{"sourcePath":" "},{}]}',), ('[{"sourcePath":"b.pdf"}]',), ("nonsense",), (None,), ('{"version":2,"entries":[]}',)]
    q = records.stored_queue(F.col("t"))
    d = spark.createDataFrame(rows, "t string").select(q.alias("q"))
    assert [[e.sourcePath for e in r.q] for r in d.collect()] == [["a.pdf"], ["b.pdf"], [], [], []]
    again = d.select(records.stored_queue(records.queue_text(F.col("q"))).alias("q")).collect()
    assert [r.q for r in again] == [r.q for r in d.collect()]
    line = records.encoded_meta(F.lit("7"), F.lit(12), F.lit("a|b"))
    assert values(spark, [(1,)], "n int", line, records.decoded_meta(line)["name"]) == [("7|12|a/b", "a/b")]
    assert [r[0] for r in values(spark, [("x|y|z",), ("1|2",), ("",)], "t string", records.decoded_meta(F.col("t")))] == [None] * 3


def test_messages_and_ui_settings(spark):
    from leafmill.functions import records

    n = F.array(*[scalars.notice(c, "info", c) for c in ("a", "b", "a", "c", "b")])
    assert [x.code for x in values(spark, [(1,)], "n int", records.distinct_notices(n))[0][0]] == ["a", "b", "c"]
    told = records.localized(spark.createDataFrame([("a", "A?"), ("z", "Z!")], "code string, fallback string"), spark.createDataFrame([("a", "Ah")], "code string, template string"))
    assert {r.code: r.text for r in told.collect()} == {"a": "Ah", "z": "Z!"}
    x = F.col("x")
    assert values(spark, [(None,), (-1.0,), (float("nan"),), (5000.0,)], "x double", records.target_megabytes(x), records.percent(x)) == [(None, 0.0), (None, 0.0), (None, 0.0), (2048.0, 100.0)]
    same = records.same_settings({"a": F.lit(1), "output_dir": F.lit("x")}, {"a": F.lit(1), "b": F.lit(None).cast("int")})
    built, own = (F.create_map(*[F.lit(v) for v in kv]) for kv in (("balanced", 1, "maximum", 2), ("maximum", 9, "nope", 7)))
    assert values(spark, [(1,)], "n int", same, records.merged_profiles(built, own)) == [(True, {"balanced": 1, "maximum": 9})]
    assert records.features(spark).first().fontSubset


def test_runs_can_be_called_off(spark):
    import threading
    import time

    from leafmill.operators.runs import Runs

    runs, found = Runs(spark), []
    slow = F.udf(lambda x: time.sleep(30) or x, "long")

    def work():
        try:
            runs.run("one", lambda: spark.range(4).select(slow("id")).collect())
        except PdfError as e:
            found.append(e.code)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        if "one" in runs.under_way():
            break
        time.sleep(0.1)
    time.sleep(3)
    with pytest.raises(PdfError):
        runs.run("one", lambda: 1)
    assert runs.cancel("one") and not runs.cancel("two")
    t.join(25)
    assert found == ["cancelled"] and runs.run("one", lambda: 5) == 5 and not runs.under_way()


def test_reachable_goes_on_until_nothing_is_new(spark, tmp_path):
    from leafmill.plans import registry

    chain = [1]
    while len(chain) < 10:
        chain.append((7 * chain[-1] + 1) % 97)
    spark.createDataFrame([(x, 1) for x in chain[:-1]], "l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted((r.depth, r.node) for r in registry.reachable_objects(spark, str(tmp_path)).collect()) == list(enumerate(chain))


def test_command_line_and_runs(spark, tmp_path, capsysbinary, monkeypatch):
    import io
    import json
    import sys

    from leafmill.__main__ import main
    from leafmill.operators.runs import PendingOpens, Runs
    from leafmill.sources import pdf, pdf_make
    from leafmill.sources.pdf_model import PdfError
    from leafmill.streaming.progress import Progress

    data = pdf_make.text_pdf("some text that is long enough to shrink " * 40)
    (tmp_path / "a.pdf").write_bytes(data)
    (tmp_path / "b.PDF").write_bytes(b"no pdf")
    assert main(["--help"], spark) == 0 and main(["analyze"], spark) == 1 and main(["compress", str(tmp_path / "gone.pdf")], spark) == 1
    capsysbinary.readouterr()
    assert main(["analyze", str(tmp_path / "a.pdf")], spark) == 0
    assert json.loads(capsysbinary.readouterr().out)["page_count"] == 1
    assert main(["quick", str(tmp_path), "--preset", "maximum", "--output-dir", str(tmp_path / "out")], spark) == 1  # b.PDF fails
    lines = capsysbinary.readouterr().out.splitlines()
    assert len(lines) == 3 and json.loads(lines[-1])["files_compressed"] == 1 and (tmp_path / "out" / "a__optimized-maximum.pdf").exists()
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(data)))
    assert main(["compress", "-", "--stdout"], spark) == 0
    piped = capsysbinary.readouterr()
    assert piped.out.startswith(b"%PDF") and len(piped.out) < len(data) and json.loads(piped.err)["output_was_smaller"]
    try:
        pdf.read_limited(io.BytesIO(b"12345"), 4)
        raise AssertionError
    except PdfError as e:
        assert e.code == "inputTooLarge" and pdf.read_limited(io.BytesIO(b"1234"), 4) == b"1234"

    files = spark.createDataFrame([("/x/a.pdf", bytearray(data)), ("/x/b.pdf", bytearray(b"no pdf"))], "doc_id string, content binary")
    runs = Runs(spark)
    assert {r.page_count for r in runs.analyze("one", files)} == {1, None}
    got = runs.scanned("two", files, pdf.default_settings(), str(tmp_path / "runs"))
    assert len(got) == 1 and runs.may_open(got[0].output_path) and not runs.may_open(str(tmp_path / "a.pdf")) and not runs.cancel("two")
    assert sorted((r.doc_id, r.error is None) for r in pdf.optimize_recommended(files).collect()) == [("/x/a.pdf", True), ("/x/b.pdf", False)]

    opens = PendingOpens()
    assert opens.stage(["a"]) is None and opens.stage(["b"]) is None and opens.ready() == ["a", "b"] and opens.stage(["c"]) == ["c"] and opens.ready() == []
    told = []
    with Progress(spark, 40, lambda *x: told.append(x), every=0.01) as p:
        assert p.counted(spark.range(40).repartition(4)).count() == 40
    assert told[0] == ("loading", 0.0) and told[-1] == ("done", 100.0) and [x for _, x in told] == sorted(x for _, x in told) and p.rows.value == 40


def test_profile_paths_and_languages():
    from leafmill.functions import cli, config

    assert config.default_profile_path({"HOME": "/h"}, "linux").startswith("/h/.config/") and config.default_profile_path({"XDG_CONFIG_HOME": "/c", "HOME": "/h"}, "linux").startswith("/c/")
    assert "Application Support" in config.default_profile_path({"HOME": "/h"}, "darwin") and config.default_profile_path({"APPDATA": "/d"}, "win32").startswith("/d")
    assert [cli.language(e) for e in ({"LANG": "zh_CN.UTF-8"}, {"LC_ALL": "ZH"}, {"LANG": "C", "LC_ALL": "zh"}, {})] == ["zh", "zh", "en", "en"]
