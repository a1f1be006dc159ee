"""Properties of the kernels, over generated inputs."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import _windows, decontamination, html_text, ngram_join, secrets, warc

small = st.binary(max_size=120).map(lambda b: bytes(97 + x % 3 for x in b))


@given(st.lists(small, min_size=1, max_size=4), st.integers(2, 12), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_equal_stretches_have_equal_anchors(texts, gram, width):
    length, found = gram + width - 1, {}
    for t in texts:
        raw = np.frombuffer(t, np.uint8)
        grams = _windows.Rolling(raw).windows(gram)
        assert len({*map(int, grams)}) == len({t[i : i + gram] for i in range(len(grams))})
        at = set(_windows.anchors(grams, width).tolist())
        for i in range(len(t) - length + 1):
            own = {a - i for a in at if i <= a < i + width}
            least = min(grams[i : i + width])
            own = {a for a in own if grams[i + a] == least}
            assert own and found.setdefault(t[i : i + length], own) == own


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=14).map(" ".join), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_shingles_are_equal_where_words_are(texts):
    plain = [ngram_join.plain_words(t.encode()) for t in texts]
    hashes, counts = ngram_join.shingle_hashes(plain)
    exact = ngram_join.exact_grams(plain)
    sets, at = [], 0
    for t, n in zip(plain, counts.tolist()):
        w = tuple(t.split())
        want = {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set()
        assert n == (max(1, len(w) - 4) if w else 0)
        sets.append((want, {*hashes[at : at + n].tolist()}, None))
        at += n
    wide = ngram_join.wide_grams(plain)
    assert (ngram_join._common(exact) == ngram_join._common(wide)).all() or len(exact) == 1
    for (a, ha, _), ea, wa in zip(sets, exact, wide):
        for (b, hb, _), eb, wb in zip(sets, exact, wide):
            assert len(a & b) == len(ha & hb) == len({*ea.tolist()} & {*eb.tolist()}) == len({*wa.tolist()} & {*wb.tolist()})


@given(st.binary(max_size=400), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_chunked_framing(body, size):
    framed = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)) + b"0\r\n\r\n"
    assert warc.dechunked(framed) == body
    for cut in range(0, len(framed) - 4, 7):
        assert warc.dechunked(framed[:cut]) is None


@given(st.text(alphabet="<>/=\"' abp!-&;#divscripthead1\n", max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_markup_is_read(page):
    text = html_text.main_text(page)
    assert text == text.strip() and "\n\n" not in text


@given(st.text(max_size=200))
@settings(max_examples=100, deadline=None)
def test_any_text_is_scanned(text):
    for a, b, kind in secrets.scan(text):
        assert 0 <= a < b <= len(text) and kind in secrets.KINDS
    assert hashlib.sha256(secrets.listed(secrets.scan(text)).encode()).digest()
    words = decontamination.words(text.encode("utf-8", "replace"))
    assert all(w and w == w.lower() for w in words)
