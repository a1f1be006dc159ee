import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import chat, html_text, quality, repeats, secrets, suffix_bcr, warc

from ..conftest import SF
from .conftest import ROWS

# ---- HTML


def test_article_without_what_surrounds_it():
    page = """<!doctype html><html><head><title>T &amp; x</title><style>p{a:b}</style><script>var a="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, really, a lot of them, ok.</div>
    <div id=main><aside>Related things, many, many, many of them.</aside><article><h1>Title&nbsp;one</h1><p>First  paragraph,
    with <b>bold</b> text, and <a href=x>a link</a>.<p>Second &lt;b&gt; paragraph<br>after a break, unclosed.
    <div class="ad">Buy, buy, buy now, cheap.</div><ul><li>item one<li>item two</ul><form><input>Subscribe here, please, now.</form></article>
    <section class="comments"><p>A reader's comment, long enough to matter, with commas, and more, and more.</p></section></div>
    <div class=sidebar>Side, side, side bar text that is long enough to count as one.</div><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == (
        "Title one\nFirst paragraph, with bold text, and a link.\nSecond <b> paragraph after a break, unclosed.\nitem one\nitem two"
    )


def test_best_container_without_an_article_element():
    para = "Running text, with commas, that goes on for a while, so that it scores. " * 3
    links = "".join(f"<p><a href=/{k}>A headline that links, to some other page, number {k}</a></p>" for k in range(9))
    page = f"<body><div id=x>{links}</div><div class=c1><p>{para}</p><p>{para}</p><p>Short.</p></div><div>foot</div></body>"
    assert html_text.main_text(page).split("\n") == [para.strip(), para.strip(), "Short."]


def test_names_of_containers():
    keep = "Kept text, of the article, long enough, with commas, to count. " * 2
    drop = "Dropped text, of other things, long enough, with commas, to count."
    inner = "".join(
        f"<div {a}>{drop}</div>"
        for a in ('class="post-comments"', "id=article-sidebar", 'class="ad-content"', 'role="navigation"', "hidden", 'style="display: none"', 'class="shareBar"', 'class="related posts"')
    )
    title = '<div class="post-header"><h1>Title</h1></div>'
    page = f'<body class="no-sidebar"><div class="content-with-sidebar"><div id=entry title="hidden gem" data-class="comments">{title}<p>{keep}</p>{inner}<p>{keep}</p></div></div>'
    assert html_text.main_text(page) == "\n".join(["Title", keep.strip(), keep.strip()])


@pytest.mark.parametrize("page", ["", None, "<", "<p", "</p></div>", "<script>x", "<!-- open", "<div " * 50, "&#xD800;&bad;", "a<b>c" * 1000, "<div>" * 3000 + "x"])
def test_broken_pages_dont_fail(page):
    assert isinstance(html_text.main_text(page), str)


def test_content_of_the_article_is_kept():
    page = "<article><p>Text, really. <label>kept</label> <math><mi>x</mi></math> <object>shown</object> <noscript>plain</noscript> end.</p>"
    page += '<p class="copyright-history">It is a history.</p><table class="tags"><tr><td>one</td></tr></table><p class="note print">Noted.</p><label>Last</label><p class="ad">Buy.</p></article>'
    assert html_text.main_text(page) == "Text, really. kept x shown plain end.\nIt is a history.\none\nNoted.\nLast"
    long = "Running text, with commas, that goes on for a while, so that it scores. " * 4
    page = f"<body><div id=wrap><div><p>{long}</p><p>{long}</p></div><div><p>A short one.</p></div><div>© 2024 Us. All rights reserved.</div><div><a href=x>Read more.</a></div></div></body>"
    assert html_text.main_text(page) == "\n".join([long.strip(), long.strip(), "A short one."])


def plain_scores(root):
    """Scores of containers by the rules as stated, each subtree walked anew."""

    def below(n, link=False):
        for k in n.kids:
            if isinstance(k, str):
                yield k, link
            elif not html_text._is_unlikely(k):
                yield from below(k, link or k.name == "a")

    def elements(n):
        yield n
        for k in n.kids:
            if not isinstance(k, str) and not html_text._is_unlikely(k):
                yield from elements(k)

    def inline(n):
        for k in n.kids:
            if isinstance(k, str):
                yield k
            elif k.name not in html_text.BLOCK and not html_text._is_unlikely(k):
                yield from inline(k)

    squeezed = lambda t: len(re.sub(r"\s+", " ", t).strip())
    score, nodes = {}, {}
    for n in elements(root):
        own = list(inline(n)) if html_text._is_paragraph(n) else []
        size, commas = sum(map(squeezed, own)), sum(len(re.findall("[,،、，]", t)) for t in own)
        if not size:
            continue
        points = 1 + commas + min(size / 100, 3) if size >= 25 else size / 100
        for up, part in ((n.parent, 1), (n.parent.parent if n.parent else None, 0.5)):
            if up is not None:
                nodes[id(up)] = up
                score[id(up)] = score.get(id(up), html_text._start(up)) + points * part
    out = []
    for k, n in nodes.items():
        told = list(below(n, n.name == "a"))
        size, linked = sum(squeezed(t) for t, _ in told), sum(squeezed(t) for t, link in told if link)
        out.append((n, score[k] * (1 - linked / size if size else 0)))
    return out


def test_scores_against_plain_walks():
    draw = random.Random(6)
    words = lambda: " ".join(draw.choice(["one", "two,", "three", "four.", "fifth"]) for _ in range(draw.randrange(12)))

    def piece(depth):
        name = draw.choice(["div", "div", "p", "section", "td", "ul", "li", "span", "b", "a", "aside", "blockquote", "h2", "article"])
        mark = draw.choice(["", "", ' class="content"', ' class="sidebar"', ' id="post-text"', ' class="notice"', " hidden"])
        inside = "".join(piece(depth - 1) for _ in range(draw.randrange(4))) if depth else ""
        return f"<{name}{mark}>{words()}{inside}{words()}</{name}>{draw.choice(['', words()])}"

    told = 0
    for _ in range(150):
        root = html_text.parse("".join(piece(4) for _ in range(2)))
        want = plain_scores(root)
        found = html_text.best_containers(root)
        for n, x in want:
            assert n.score == pytest.approx(x)
        if want:
            best = max(x for _, x in want)
            tops = [n for n, x in want if x == pytest.approx(best)]
            up = [m for n in tops for m in [n, *html_text._up(n)]]
            assert any(f in up or f.parent in [t.parent for t in tops] for f in found)
            told += 1
    assert told > 100


LINEAR = ["<div>text<p>text</p>", "<div><p>a, b, c, ", "<a ", '<a "', "<a '\"x", "</a ", "<!--", "<script ", "<script></script ", "<ul><li>x", "<b>x", "<header><p>hello</p>", "<td>some text here, and more of it", "<article><p>x, y</p>", "&#"]


@pytest.mark.parametrize("piece", LINEAR)
def test_a_megabyte_of_open_markup_is_read_in_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8  # some 1 to 2 s; quadratic time would be minutes


def test_extract_keeps_every_row(spark):
    d = spark.createDataFrame([(1, "u", "<p>Some text here, enough of it.</p>", 1), (1, None, None, 2), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(d).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", "Some text here, enough of it.", 29), (1, None, "", 0), (None, "u", "", 0)]
    assert html_text.extract(d.where("false")).count() == 0


def test_pages_of_the_test_data(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    import html

    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = [html.unescape(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r.html) == "\n".join(x for x in parts if x)


# ---- repeats


def brute_repeats(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        runs = []
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append(runs)
    return out


def repeat_texts():
    draw = random.Random(2)
    passage = bytes(draw.choice(b"abcd ") for _ in range(90))
    texts = [bytes(draw.choice(b"abcdefgh ") for _ in range(draw.randrange(150))) for _ in range(12)]
    for i in (1, 3, 4, 8):
        cut = draw.randrange(20)
        texts[i] = texts[i][:20] + passage[cut : cut + 70] + texts[i][20:]
    return [*texts, b"", b"ab" * 80, texts[3], "é😀ß".encode() * 25, b"x" * 39, b"x" * 40]


@pytest.mark.parametrize("large", [100_000, 1])
def test_repeats_against_brute_force(spark, large):
    texts = repeat_texts()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, length=40, gram=16, large=large).collect()}
    want = brute_repeats(texts, 40)
    assert [got[i].runs for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        kept = bytearray(t)
        for a, b in reversed(want[i]):
            del kept[a:b]
        assert bytes(got[i].kept) == bytes(kept) and got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and got[i].n_bytes == len(t)


@pytest.mark.parametrize("large", [100_000, 2])
def test_a_passage_in_a_third_of_all_documents(spark, large):
    """At full length, with odd copies of it beside, rows repeated with their ids and null ids."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(2, 9)))
    passage = " ".join(word() for _ in range(110))
    rows = []
    for i in range(48):
        text = " ".join(word() for _ in range(draw.randrange(70)))
        if i % 3 == 0:
            own = list(passage)
            if i % 12 == 0:
                own[draw.randrange(len(own))] = "Z"
            text = text + "".join(own)[draw.randrange(60) :] + " " + text[:80]
        rows.append((i, text))
    rows += [rows[3]] * 4 + [(None, passage[:230])] * 3 + [(3, "x" * 500), (3, rows[6][1] + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((str(r.doc_id), r.n_bytes, [list(x) for x in r.runs]) for r in repeats.remove_repeats(docs, large=large).collect())
    want = brute_repeats([t.encode() for _, t in rows], 200)
    assert got == sorted((str(i), len(t), runs) for (i, t), runs in zip(rows, want))


@pytest.mark.parametrize("chunk", [1, 50, 333])
def test_long_documents_are_cut_without_a_trace(monkeypatch, chunk):
    draw = random.Random(8)
    texts = [bytes(draw.choice(b"abcd") for _ in range(n)) for n in (39, 40, 41, 700, 90, 2_000)]
    seen = lambda: sorted(
        (int(k), int(p), int(a), int(c), x["raw"][b : b + bf + 16 + af].tobytes())
        for x in repeats._anchored(texts, 40, 16)
        for k, p, a, c, b, bf, af in zip(x["number"], x["place"], x["anchor"], x["context"], x["begin"], x["before"], x["after"])
    )
    want = seen()
    assert all(texts[k][max(0, p - 24) : p + 40] == t for k, p, _, _, t in want)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    assert seen() == want


def test_one_row_of_each_context(spark):
    """What is compared has a row a context, however many parts of the corpus it stands in."""
    passage = " ".join(f"word{i}" for i in range(90))
    counts = []
    for n in (10, 40):
        docs = spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(n)], "doc_id long, text string").repartition(n)
        words = spark.sparkContext.broadcast(np.full(1 << 21, 2**64 - 1, np.uint64))
        rows = repeats._rows(docs, "doc_id", "text")
        every = repeats.context_bytes(rows, words, None, False, 200, 64)
        once = repeats.once_each(every)
        assert once.count() == every.select("anchor", "context").distinct().count()
        inside = once.where("before = 136 AND after = 136").groupBy("anchor").count().agg(F.min("count")).first()[0]
        counts.append(inside)
    assert counts == [1, 1]


def test_column_wise_construction():
    texts = repeat_texts()[:9] + [b"", b"ab" * 30]
    found = suffix_bcr.transform(texts)
    # ends come by document and before all bytes; suffixes that are equal come by document
    order = sorted((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t) + 1))
    assert [(d, p) for _, d, p, _ in found] == [(d, i) for _, d, i in order]
    for (before, d, p, common), (_, d0, p0, _) in zip(found[1:], found):
        a, b = texts[d0][p0:], texts[d][p:]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common == n and before == (texts[d][p - 1] + 1 if p else 0)
    assert suffix_bcr.repeated(texts, 40) == brute_repeats(texts, 40)


def test_repeats_of_messy_rows(messy, nothing):
    got = repeats.digest(repeats.remove_repeats(messy)).collect()
    assert len(got) == len(ROWS)
    want = brute_repeats([(t or "").encode() for _, t, _ in ROWS if len(t or "") < 1000], 200)
    assert not any(want)
    assert {r.doc_id: r.n_removed == r.n_bytes for r in got if r.doc_id in (7, 8)} == {7: True, 8: False}  # the last byte of 8 is its own
    assert all(r.n_removed == 0 for r in got if r.doc_id not in (7, 8))
    assert repeats.remove_repeats(nothing).count() == 0


# ---- quality


def test_quality_on_labels_not_seen(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(test) > 50 and np.mean([r.predicted == r.quality for r in test]) > 0.95
    again = quality.score_documents(docs.repartition(5), labels).collect()
    assert {r.doc_id: r.score for r in again} == pytest.approx({r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()})


def test_quality_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 1), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.score_documents(messy, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.keep_good(messy, labels.where("false")).count() == len(ROWS)
    assert quality.keep_good(messy, labels).columns == messy.columns
    assert quality.score_documents(nothing, labels).count() == 0


def test_quality_fit_of_repeated_ids(spark):
    once = [(i, f"text number {i} " + "with some more words " * (i % 9)) for i in range(200)]
    docs = spark.createDataFrame(once, "doc_id long, text string")
    many = spark.createDataFrame(once + once[:40] * 25, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int")
    want, got = (quality.fit(d, labels, sample=60).plain() for d in (docs, many))
    assert str(want) == str(got)


@pytest.mark.parametrize(("prior", "shift"), [(0.4, 0.0), (0.9, 4.0), (None, 0.0)])
def test_risk_and_its_gradient_by_brute_force(prior, shift):
    """The risk row by row in plain Python, its gradient by differences; below zero only the negatives' part counts."""
    import math

    draw = np.random.default_rng(2)
    zp, zu = draw.normal(shift, 1, (9, 3)), draw.normal(0, 1, (14, 3))
    w = [draw.normal(0, 1, (3, 4)), draw.normal(0, 1, 4), np.abs(draw.normal(0, 1, 4)), np.array(0.1)]
    w[0] = np.abs(w[0]) if shift else w[0]

    def parts(w):
        logit = lambda z: float(w[3]) + sum(float(w[2][j]) * math.tanh(float(w[1][j]) + sum(float(z[i]) * float(w[0][i, j]) for i in range(3))) for j in range(4))
        loss = lambda f, good: math.log(1 + math.exp(-f if good else f))
        mean = lambda rows, good: sum(loss(logit(z), good) for z in rows) / len(rows)
        if prior is None:
            return mean(zp, True), mean(zu, False)
        return prior * mean(zp, True), mean(zu, False) - prior * mean(zp, False)

    value, grads, own = quality.risk(w, zp, zu, prior)
    good, rest = parts(w)
    assert value == pytest.approx(good + max(0.0, rest)) and own == (rest >= 0 or prior is None)
    assert own == (prior != 0.9)
    for k, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            up, down = ([x.copy() for x in w] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            a, b = parts(up), parts(down)
            want = (sum(a) - sum(b)) / 2e-5 if own else -(a[1] - b[1]) / 2e-5
            assert g[at] == pytest.approx(want, abs=1e-6)


def test_prior_estimate():
    draw = np.random.default_rng(1)
    pos = draw.normal(2, 1, (2000, 24))
    unl = np.concatenate([draw.normal(2, 1, (1400, 24)), draw.normal(-2, 1, (600, 24))])
    assert abs(quality.estimate_prior(pos, unl) - 0.7) < 0.06


# ---- WARC

PAGES = [
    (1, "http://a/", "<p>" + "x" * 200), (2, "http://b/\r\nWARC-Type: evil", "<p>" + "x" * 200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", "<p>" + "x" * 200),
    (6, "u", "é😀\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3000), (7, "u", "0\r\n\r\n" * 30), (7, "u", "0\r\n\r\n" * 30), (8, "u", "é😀\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3000),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write(warc.records(pages, segment_chars=500, chunk_chars=64), str(tmp_path / "w"))
    got = warc.reassembled(warc.parts(spark, str(tmp_path / "w"))).collect()
    assert all(r.status == "ok" for r in got)
    for r in got:
        html = next(h for i, _, h in PAGES if i == r.page_id) or ""
        if r.record_type == "response":
            assert bytes(r.payload) == html.encode() and r.payload_bytes == len(html.encode())
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
    kind = {(r.page_id, r.record_type) for r in warc.round_trip(pages).collect()}
    assert kind == {(1, "response"), (2, "revisit"), (3, "response"), (4, "response"), (5, "response"), (None, "revisit"), (6, "response"), (7, "response"), (8, "revisit")}
    rows = {(r.page_id, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert (2, 1, 203) in rows and (8, 6, len(PAGES[-1][2].encode())) in rows and (5, None, 0) in rows
    assert warc.round_trip(pages).count() == len(PAGES) and warc.round_trip(pages.where("false")).count() == 0


def test_warc_damage(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"

    def record(ident, data, **more):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return f"WARC/1.1\r\nWARC-Type: {more.pop('kind', 'response')}\r\nWARC-Record-ID: <{ident}>\r\n{head}Content-Length: {len(data)}\r\n\r\n".encode() + data + b"\r\n\r\n"

    cont = lambda origin, n, data, **m: record(f"{origin}-{n}", data, WARC_Segment_Origin_ID=f"<{origin}>", WARC_Segment_Number=n, **m)
    data = record("plain", block) + record("chunk", block[:-9] + b"zz\r\n")
    data += cont("split", 2, block[20:], WARC_Segment_Total_Length=len(block)) + record("split", block[:20], WARC_Segment_Number=1)
    data += record("short", block[:20], WARC_Segment_Number=1) + cont("short", 2, block[20:], WARC_Segment_Total_Length=len(block) + 1)
    data += record("gap", block[:20], WARC_Segment_Number=1) + cont("gap", 3, block[20:], WARC_Segment_Total_Length=len(block))
    data += cont("lost", 2, block[20:], WARC_Segment_Total_Length=len(block)) + b"WARC/1.1\r\nWARC-Record-ID: <cut>\r\nContent-Length: 99\r\n\r\nabc"
    (tmp_path / "a.warc").write_bytes(data)
    got = {r.record_id: r for r in warc.reassembled(warc.parts(spark, str(tmp_path))).collect()}
    assert {k.strip("<>"): r.status for k, r in got.items()} == {
        "plain": "ok", "chunk": "broken block", "split": "ok", "short": "wrong total length", "gap": "segment missing", "lost": "no origin", "cut": "cut off",
    }
    assert bytes(got["<split>"].payload) == b"hello" == bytes(got["<plain>"].payload)


def test_warc_reading_goes_on_after_damage(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1 in the middle\r\n\r\nWARC/9 and more"
    record = lambda i, n=None, more="": f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\n{more}Content-Length: {len(block) if n is None else n}\r\n\r\n".encode() + block + b"\r\n\r\n"
    bad = {
        "b1": record("b1", more="WARC-Segment-Number: x\r\n"), "b2": record("b2", more="WARC-Page-ID: 1.5\r\n"), "b3": record("b3", "none"), "b4": record("b4", 10**15),
        "b5": record("b5", more="WARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: y\r\nWARC-Segment-Origin-ID: <g0>\r\n"), None: b"junk\r\n\r\nnot a record\r\n",
    }
    data, good = record("g0"), {"g0"}
    for k, b in bad.items():
        data += b + record(f"g-{k}")
        good.add(f"g-{k}")
    (tmp_path / "a.warc").write_bytes(data + record("end", 9999))
    members = [gzip.compress(record(f"z{k}")) for k in range(4)]
    members[1] = members[1][:40] + b"\0" * 9 + members[1][49:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(record("g0") * 3)[:-12])
    got = {(r.record_id or "none").strip("<>"): r for r in warc.reassembled(warc.parts(spark, str(tmp_path))).collect()}
    assert {k for k, r in got.items() if r.status == "ok"} == good | {"z0", "z2", "z3"}
    assert all(bytes(r.payload) == block.partition(b"\r\n\r\n")[2] for r in got.values() if r.status == "ok")
    assert {k: got[k].status for k in ("b1", "b2", "b3", "b4", "b5", "none", "end")} == dict.fromkeys(("b1", "b2", "b3", "b5", "none"), "bad header") | {"b4": "cut off", "end": "cut off"}
    assert got["g0"].copies >= 2


def test_warc_repeated_rows_are_records_of_their_own(spark):
    rows = [(1, "u", "x" * 200)] * 40 + [(None, "u", "x" * 200)] * 40 + [(2, None, "y" * 20)] * 3 + [(None, None, None)] * 3
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).groupBy("page_id", "record_type", "refers_to", "payload_bytes").count().collect()
    assert {tuple(r) for r in got} == {(1, "response", None, 200, 40), (None, "revisit", 1, 200, 40), (2, "response", None, 20, 3), (None, "response", None, 0, 3)}


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_archives_are_read_a_piece_at_a_time(monkeypatch, size):
    import gzip

    monkeypatch.setattr(warc, "READ_BYTES", size)
    record = lambda i: f"WARC/1.1\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {i}\r\n\r\n".encode() + b"\r\n" * (i // 2) + b"x" * (i % 2) + b"\r\n\r\n"
    plain = b"".join(record(i) for i in range(9))
    cut = lambda data: iter([data[i : i + size] for i in range(0, len(data), size)])
    for data in (plain, gzip.compress(plain), b"".join(gzip.compress(record(i)) for i in range(9))):
        got = list(warc._parsed(warc._inflated(cut(data))))
        assert [(h["warc-record-id"], len(b)) for h, b in got] == [(f"<{i}>", i) for i in range(9)]


# ---- chat


def chat_model():
    turns = np.array([[0.05, 0.85, 0.05, 0.05], [0.02, 0.08, 0.8, 0.1], [0.02, 0.8, 0.08, 0.1], [0.1, 0.2, 0.6, 0.1]])
    shapes = np.random.default_rng(3).dirichlet(np.ones(10), (4, 2))
    return chat.Model(np.array([0.1, 0.7, 0.1, 0.1]), turns, shapes, np.array([0.5, 0.4, 0.2, 0.3]))


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    m = chat_model()
    lines = chat.transcript_lines("User: hi?\nthere\n\nsomething longer that is said\nAssistant: yes")
    score = lambda s: m.start[s[0]] + sum(m.emission(*x)[k] for x, k in zip(lines, s)) + sum(m.step[a, b] for a, b in zip(s, s[1:]))
    best = max(product(range(6), repeat=len(lines)), key=score)
    assert score(m.states(lines)) == score(best)
    rows = [(None, "You know\nhow?"), (3, "42"), (None, ""), (None, "Assistant: yes\n\nit is"), (1, "User: no"), (None, "x" * 200)]
    both = m.seen(rows)
    for e, free in zip(both, (False, True)):
        score = lambda s: m.turn_start[s[0]] + sum(e[i, k] for i, k in enumerate(s)) + sum(m.turn_step[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
        allowed = [[r] if r is not None and not free else range(3) for r, _ in rows]
        assert score(chat.best_paths([e], m.turn_start, m.turn_step)[0].tolist()) == max(map(score, product(*allowed)))
    many = [both[0][:k] for k in (3, 0, 6, 1)] + [both[1]]
    for e, got in zip(many, chat.best_paths(many, m.turn_start, m.turn_step)):
        assert len(got) == len(e) and (not len(e) or (got == chat.paths(e, None, m.turn_start, m.turn_step)[2][chat.paths(e, None, m.turn_start, m.turn_step)[0].argmax()]).all())


def test_stated_roles_and_texts_are_kept(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    by = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    assert {k: r.rendered for k, r in got.items()} == {k: chat.render(v) for k, v in by.items()}
    assert all(r.n_recovered == 0 and r.roles == ",".join(x for x, _ in by[k]) and len(r.unseen_roles.split(",")) == r.n_turns for k, r in got.items())
    # what a text says of speakers doesn't change who said it, and roles that have no name here stay
    rows = [(1, 0, "user", "What is 2+2?\n\n\n  "), (1, 1, "assistant", "Let me see.\nAnswer: 4\nContext: sums\n"), (1, 2, "tool", "User: 42"), (1, 3, "a, b\n<|im_end|>", "x")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.roles == "user,assistant,tool,a  b\n<|im_end|>" and got.n_turns == 4
    assert got.rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in [*((r, t) for *_, r, t in rows[:3]), ("a, b <| im_end |>", "x")])


@pytest.mark.parametrize(("hidden", "least"), [(0, 1.0), (10, 0.95), (50, 0.95), (100, 0.95)])
def test_roles_that_are_hidden_are_recovered(spark, hidden, least):
    """A model fitted on half of the conversations; of the others so many roles in a hundred are hidden, and no text has a marker."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(turns.where("conv_id % 2 = 0"))
    rest = turns.where("conv_id % 2 = 1")
    shown = rest.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) >= hidden, F.col("role")))
    truth = {}
    for r in rest.orderBy("conv_id", "turn").collect():
        truth.setdefault(r.conv_id, []).append(r.role)
    lost = dict(shown.where("role IS NULL").groupBy("conv_id").count().collect())
    got = chat.format_conversations(shown, model=model).collect()
    assert all(r.n_recovered == lost.get(r.conv_id, 0) for r in got)
    wrong = sum(a != b for r in got for a, b in zip(r.roles.split(","), truth[r.conv_id], strict=True))
    assert wrong <= (1 - least) * sum(lost.values())


def test_messy_conversations(spark):
    rows = [(1, 0, "User", "a?"), (1, None, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "human", "x<|im_end|>"), (2, 5, "", ""), (3, 9000, "user", "late"), (3, 9001, None, " Bot: and\nmore ")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_conversations(d).collect()}
    assert set(got) == {1, None, 2, 3}
    assert got[None].rendered == "<|im_start|>user\nx<| im_end |><|im_end|>\n" and got[2].n_turns == 1 and got[2].n_lines == 0
    assert got[3].rendered == "<|im_start|>user\nlate<|im_end|>\n<|im_start|>assistant\nand\nmore <|im_end|>\n" and got[3].n_recovered == 1
    assert got[1].n_turns == 4 and got[1].n_recovered == 1
    assert chat.format_conversations(d.where("false")).count() == 0
    model = chat.fit(d)
    raw = spark.createDataFrame([(1, "User: q?\nAssistant: a\nmore"), (2, None), (3, " \n ")], "conv_id long, text string")
    assert [r.roles for r in chat.format_transcripts(raw, model).collect()] == ["user,assistant", "", ""]


def test_long_conversations_are_not_cut(spark):
    rng = np.random.default_rng(5)
    texts = ["yes", "and why?", "", "\n", "it goes on\r", "\n\na longer line that is said about a thing\nand another", "User: quoted", "x" * 90 + "?", None]
    roles = ["user", "assistant", "system", None, None, "", "Bot", "tool"]
    rows = [(c, t, roles[rng.integers(8)], texts[rng.integers(9)]) for c, n in ((1, 9), (2, 60), (None, 30), (4, 1)) for t in range(4090, 4090 + n)]
    rows += [(5, None, None, f"{i % 7} tied") for i in range(40)] + [(6, 4095, "user", "first"), (6, 4096, None, "and on")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or -1, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((r, x))
    known, steps = {"system": 0, "user": 1, "assistant": 2, "bot": 2, "tool": 3}, {}
    for c in by:
        ids = [r for _, r in sorted((t or 0, known.get((r or "").lower(), -1)) for k, t, r, _ in rows if k == c)]
        for a, b in zip([-1, *ids], ids):
            if b >= 0:
                steps[a, b] = steps.get((a, b), 0) + 1
    step = np.array([[1 + steps.get((a, b), 0) for b in range(4)] for a in range(4)])
    m = chat.fit(d)
    assert np.allclose((m.turn_step - m.turn_step[:, :1]) / chat._UNIT, np.log(step / step[:, :1]), atol=1e-6)
    want = {}
    for c, conv in by.items():
        e = m.seen([(chat.role_number(r), x or "") for r, x in conv])
        known_, unseen = chat.best_paths(list(e), m.turn_start, m.turn_step)
        turns = [chat.turn(r, x, int(k)) for (r, x), k in zip(conv, known_)]
        want[c] = (len(conv), ",".join(r for r, _ in turns), ",".join(chat.ROLES[u] for u in unseen), chat.render(turns))
    assert want[6][1].startswith("user,")
    for n in (4_096, 1, 3):
        got = chat.format_conversations(d, piece_rows=n).collect()
        assert len(got) == len(by) and {r.conv_id: (r.n_turns, r.roles, r.unseen_roles, r.rendered) for r in got} == want


# ---- secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)]) if len(body) < 256 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structures_are_confirmed():
    rsa = der(0x30, *[der(2, b"\0"), der(2, b"\1" * 128), *[der(2, b"\1" * 64)] * 7])
    spki = der(0x30, der(0x30, der(6, bytes.fromhex("2b6570"))), der(3, b"\0" + b"k" * 32))
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".c2ln"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(rsa).decode() + "-----END RSA PRIVATE KEY-----"
    text = f"é {pem} and {base64.b64encode(spki).decode()} then {token} or {rsa.hex()} but not {base64.b64encode(rsa[:-1]).decode()} nor {'ab' * 40}"
    kinds = [(k, text[a:b]) for a, b, k in secrets.confirmed_spans(text)]
    assert sorted(kinds) == sorted([("private_key", pem), ("public_key", base64.b64encode(spki).decode()), ("signed_token", token), ("private_key", rsa.hex())])


def test_more_structures_are_confirmed():
    pbes2 = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(0x30, der(6, b"\x2a\x03"))))
    keys = [der(0x30, pbes2, der(4, b"e" * 80)), der(0x30, der(2, b"\1"), der(4, b"k" * 32)), der(0x30, der(2, b"\1"), der(4, b"k" * 28))]
    assert [len(k) for k in keys[1:]] == [39, 35]
    for key in keys:
        lines = ["-----BEGIN PRIVATE KEY-----", *base64.encodebytes(key).decode().split(), "-----END PRIVATE KEY-----"]
        for end in ("\n", "\\n", "\\r\\n", "\\\\n"):
            assert secrets.confirmed_spans(f'"{end.join(lines)}{end}"') == [(1, 1 + len(end.join(lines)), "private_key")]
        assert [k for *_, k in secrets.confirmed_spans(f"x {key.hex()} y")] == ["private_key"]
    digest_info = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, b"h" * 32))
    assert secrets.confirmed_spans(digest_info.hex()) == []


def openssh(cipher=b"none", options=b"", rounds=True, checks=(7, 7), cut=0, kind=b"ssh-ed25519"):
    one = lambda x: len(x).to_bytes(4, "big") + x
    public = one(kind) + one(b"k" * 32)
    private = b"".join(c.to_bytes(4, "big") for c in checks) + one(kind) + one(b"k" * 32) + one(b"s" * 64) + one(b"me")
    private += bytes(range(1, 1 + -len(private) % 16))
    head = b"openssh-key-v1\0" + one(cipher) + one(b"none" if cipher == b"none" else b"bcrypt") + one(options)
    whole = head + (1).to_bytes(4, "big") + one(public) + one(private)
    return whole[: len(whole) - cut] if cut else whole


def test_openssh_keys_are_proven_by_their_sections():
    text = lambda data: f"x {base64.b64encode(data).decode()} y"
    salted = (16).to_bytes(4, "big") + b"s" * 16 + (16).to_bytes(4, "big")
    for good in (openssh(), openssh(b"aes256-ctr", salted, checks=(1, 2))):
        assert [k for *_, k in secrets.confirmed_spans(text(good))] == ["ssh_key"]
    head = openssh()[:60]
    for bad in (openssh(cut=1), openssh(checks=(1, 2)), openssh(b"aes256-ctr", b"x" * 5), openssh(kind=b"nothing"), head + b"garbage" * 9, openssh() + b"more"):
        assert secrets.confirmed_spans(text(bad)) == []


def test_bodies_with_header_lines():
    rsa = der(0x30, *[der(2, b"\0"), der(2, b"\1" * 128), *[der(2, b"\1" * 64)] * 7])
    body = base64.encodebytes(rsa).decode()
    plain = f"-----BEGIN RSA PRIVATE KEY-----\nComment: mine, not yours (really)\nX-Made: 2024\n\n{body}-----END RSA PRIVATE KEY-----"
    assert [k for *_, k in secrets.confirmed_spans(plain)] == ["private_key"]
    locked = base64.encodebytes(b"e" * 640).decode()
    head = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{iv}\n\n{body}-----END RSA PRIVATE KEY-----"
    assert [k for *_, k in secrets.confirmed_spans(head.format(iv="0A" * 16, body=locked))] == ["private_key"]
    assert secrets.confirmed_spans(head.format(iv="0A" * 5, body=locked)) == []
    assert secrets.confirmed_spans(head.format(iv="0A" * 16, body=base64.encodebytes(b"e" * 641).decode())) == []
    nested = f"-----BEGIN A-----\n-----BEGIN RSA PRIVATE KEY-----\n{body}-----END RSA PRIVATE KEY-----\n-----END A-----"
    assert [(a, k) for a, _, k in secrets.confirmed_spans(nested)] == [(18, "private_key")]


def test_tokens_anywhere_in_a_chain_of_parts():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    for before, after in (("", ""), ("a.", ""), ("x", ".y"), ("eyJ.", "."), ("eyJa.eyJb.", "")):
        assert [(k, a) for a, _, k in secrets.confirmed_spans(f"see {before}{token}{after} there")] == [("signed_token", 4 + len(before))]
    assert secrets.confirmed_spans(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}") == []


@pytest.mark.parametrize("piece", ["-----BEGIN A-----\n", "eyJ", "eyJa.", "-----BEGIN A-----\n-----END B-----\n", "token ", "token=", "AKIA", "abcdef0123456789 ", "A" * 39 + " ", "MIIB", "-----BEGIN A-----\nx: y\n-----END A-----\n", "0" * 64 + " "])
def test_a_megabyte_is_scanned_in_linear_time(piece):
    import time

    text = piece * (1_000_000 // len(piece))
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 8


def test_base_spans():
    text = "😀 Token = 'abc123', api-key: x, API_KEY:\"ABCDEF\" ſecret=123456 password==xyzxyz AKIA" + "A" * 16 + " AKIAB " + "0" * 24 + "f " + "0" * 23
    got = [(k, text[a:b]) for a, b, k in secrets.base_spans(text)]
    assert sorted(got) == sorted(
        [("assign", "Token = 'abc123"), ("assign", 'API_KEY:"ABCDEF'), ("assign", "password==xyzxyz"), ("access", "AKIA" + "A" * 16), ("hex", "0" * 24 + "f")]
    )


def test_prefilters_lose_nothing(spark):
    assign = re.compile(secrets._ASSIGN.pattern, re.IGNORECASE | re.ASCII)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        t = r.text or ""
        plain = [(m.start(), m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        plain += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        plain += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(plain) == sorted(secrets.base_spans(t))


def test_secrets_of_messy_rows(messy, nothing):
    got = secrets.digest(secrets.find_secrets(messy)).collect()
    assert len(got) == len(ROWS) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.digest(secrets.find_secrets(nothing)).count() == 0
