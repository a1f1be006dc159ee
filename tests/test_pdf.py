import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import fax, jpeg, planes
from leafmill.operators import pdf_rewrite
from leafmill.sources import pdf, pdf_make
from leafmill.sources.pdf_model import Document, Name, PdfError, Ref, Stream, canonical, decoded, operations, rc4, unlzw, unpredicted, unrun, written


def photo(width, height, seed=1):
    draw = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    p = np.stack([np.sin(x / 19 + seed) * 50 + 128, np.cos(y / 23) * 60 + 128, (x + y) % 255], axis=-1)
    return np.clip(p + draw.normal(0, 9, p.shape), 0, 255).astype(np.uint8)


def image(data, width, height, **more):
    d = {b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": width, b"Height": height, b"ColorSpace": Name(b"DeviceRGB"), b"BitsPerComponent": 8, b"Filter": Name(b"DCTDecode")}
    return Stream(d | {k.encode(): v for k, v in more.items()}, data)


PHOTO = jpeg.encode(photo(700, 500), 95)


def base(**changes):
    content = b"BT /F1 12 Tf (Hello \\(world\\) this is text) Tj ET /Im1 Do " + b"q Q " * 40
    objects = {
        1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2), b"Metadata": Ref(9)}, 2: {b"Type": Name(b"Pages"), b"Kids": [Ref(3)], b"Count": 1},
        3: {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(4), b"Resources": {b"Font": {b"F1": Ref(5), b"F2": Ref(8)}, b"XObject": {b"Im0": Ref(7), b"Im1": Ref(6)}}},
        4: Stream({}, content), 5: {b"Type": Name(b"Font"), b"Subtype": Name(b"Type1")}, 6: image(PHOTO, 700, 500), 7: image(PHOTO, 700, 500),
        8: {b"Type": Name(b"Font")}, 9: Stream({b"Type": Name(b"Metadata")}, b"<x/>" * 30), 10: {b"Producer": b"me"},
    }
    for k, v in changes.items():
        objects[int(k[1:])] = v
    return pdf_make.assembled(objects, Info=Ref(10))


def files(spark, *contents):
    return spark.createDataFrame([(str(i), len(c), bytearray(c)) for i, c in enumerate(contents)], "doc_id string, length long, content binary")


def test_round_trip_and_never_larger(spark):
    got = pdf.optimize(files(spark, base(), pdf_make.text_pdf(""), b"%PDF-" + b"\0" * 300, b"nothing")).orderBy("doc_id").collect()
    a = got[0]
    assert a.error is None and a.output_was_smaller and a.images_recompressed == 1 and a.images_deduplicated == 1 and a.resources_removed == 2 and a.metadata_removed
    doc = Document(bytes(a.content))
    assert len(doc.pages()) == 1 and b"Hello \\(world\\)" in doc.content(doc.pages()[0][1]) and b"Info" not in doc.trailer
    assert got[1].error is None and len(got[1].content) <= got[1].original_size_bytes
    assert [r.error.code for r in got[2:]] == ["error.pdfBuild"] * 2


def test_target_size(spark):
    f = files(spark, base())
    met = pdf.optimize(f, target_bytes=40_000).first()
    again = pdf.optimize(f, target_bytes=40_000).first()
    assert met.target_met and met.compressed_size_bytes <= 40_000 and met.content == again.content and met.attempts <= 12
    missed = pdf.optimize(f, target_bytes=10).first()
    assert not missed.target_met and missed.compressed_size_bytes < met.compressed_size_bytes
    assert pdf.optimize(f, target_bytes=0).first().error.code == "error.config"


def test_size_search_keeps_what_no_quality_changes(monkeypatch):
    calls = {"plane": 0, "fax": 0, "mask": 0}

    def counted(name, f):
        def run(*a, **k):
            calls[name] += 1
            return f(*a, **k)

        return run

    monkeypatch.setattr(pdf_rewrite, "plane_of", counted("plane", pdf_rewrite.plane_of))
    monkeypatch.setattr(pdf_rewrite.fax, "encode_g4", counted("fax", fax.encode_g4))
    monkeypatch.setattr(pdf_rewrite, "_resized_mask", counted("mask", pdf_rewrite._resized_mask))
    scan = np.where(np.random.default_rng(2).random((700, 800)) < 0.5, 255, 0).astype(np.uint8)
    alpha = Stream({b"Type": Name(b"XObject"), b"Subtype": Name(b"Image"), b"Width": 700, b"Height": 500, b"ColorSpace": Name(b"DeviceGray"), b"BitsPerComponent": 8, b"Filter": Name(b"FlateDecode")}, zlib.compress(bytes(700 * 500)))
    raw = image(zlib.compress(scan.tobytes()), 800, 700, ColorSpace=Name(b"DeviceGray"), Filter=Name(b"FlateDecode"))
    data = base(b6=image(PHOTO, 700, 500, SMask=Ref(20)), b7=raw, b20=alpha, b4=Stream({}, b"/Im0 Do /Im1 Do"))
    told = []
    out, stats = pdf_rewrite.optimize_to(Document(data), pdf.default_settings(), 4_000, 6, report=lambda *x: told.append(x))
    sizes = stats["attempts"]
    assert sizes > 4 and calls["plane"] == 2 and calls["fax"] < sizes and calls["mask"] < sizes
    assert [p for _, p in told] and {x for x, _ in told} == {"compressing", "writing"}
    plain = dict(calls)
    monkeypatch.setattr(pdf_rewrite, "KEPT", 0)
    monkeypatch.setattr(pdf_rewrite.evict, "__defaults__", (0,))
    again, more = pdf_rewrite.optimize_to(Document(data), pdf.default_settings(), 4_000, 6)
    assert again == out and more == stats and calls["plane"] > 2 * plain["plane"]


def test_caches_are_emptied_planes_first():
    caches = [pdf_rewrite.ImageCache() for _ in range(3)]
    for i, c in enumerate(caches):
        c.keep_plane(np.zeros((10, 10 * (i + 1)), np.uint8))
        c.fax = (1, 1), bytes(50 * (3 - i))
    pdf_rewrite.evict(caches, 500)
    assert [c.plane_bytes() for c in caches] == [100, 0, 0] and [c.product_bytes() for c in caches] == [150, 100, 50]
    pdf_rewrite.evict(caches, 120)
    assert [c.plane_bytes() for c in caches] == [0, 0, 0] and [c.product_bytes() for c in caches] == [0, 0, 50]
    big = pdf_rewrite.ImageCache()
    big.keep_plane(np.broadcast_to(np.uint8(0), (20_000, 6_000)))
    assert big.plane is None


def test_analysis(spark):
    r = pdf.analyze(files(spark, base(), b"x")).orderBy("doc_id").collect()
    assert r[0].page_count == 1 and r[0].image_object_count == 2 and r[0].max_image_edge_px == 700 and r[0].error is None
    assert [n.code for n in r[0].notices][:2] == ["structureBased", "safeOptimization"] and r[1].error.code == "error.pdfBuild" and r[1].document_kind is None


def test_object_tables(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PDF").write_bytes(base())
    (tmp_path / "b.txt").write_bytes(b"no")
    found = pdf.objects(pdf.read_files(spark, str(tmp_path)))
    assert [(r.duplicate, r.canonical) for r in pdf.duplicate_streams(found).collect()] == [(7, 6)]
    e = {(r.src, r.key_path, r.dst) for r in pdf.edges(found).collect()}
    assert (3, "/Contents", 4) in e and (2, "/Kids[]", 3) in e
    spark.dataSource.register(pdf.PdfSource)
    assert spark.read.format("leafmill_pdf").load(str(tmp_path)).count() == found.count() == 10


def test_written_files(spark, tmp_path):
    results = pdf.optimize(files(spark, base(), base(b4=Stream({}, b"BT /F1 9 Tf (x) Tj ET /Im1 Do"))))
    results = results.withColumn("doc_id", F.lit("/in/a.pdf"))
    out = tmp_path / "out"
    out.mkdir()
    (out / "a__optimized-balanced.pdf").write_text("someone else's")
    first = {r.output_path for r in pdf.write_files(results, str(out), "balanced").collect()}
    names = sorted(p.name for p in out.iterdir() if not p.name.startswith("_"))
    assert names == ["a__optimized-balanced-1.pdf", "a__optimized-balanced-2.pdf", "a__optimized-balanced.pdf"] and len(first) == 2
    assert (out / "a__optimized-balanced.pdf").read_text() == "someone else's" and not list(out.glob(".*.part"))
    small = spark.createDataFrame([(f"/{i}/b.PDF", True, bytearray(b"%d" % i)) for i in range(103)], "doc_id string, output_was_smaller boolean, content binary")
    got = pdf.write_files(small, str(out), "maximum").collect()
    assert len(got) == 103 and sum(r.error is not None for r in got) == 3 and {r.error.code for r in got if r.error} == {"error.io"}
    assert len({r.output_path for r in got if r.output_path}) == 100


def with_table(objects, **trailer):
    """A file with a classic cross-reference table; raw bytes are written as they are."""
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n, o in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + (o if isinstance(o, bytes) else written(o)) + b"\nendobj\n"
    at, top = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % top
    for n in range(1, top):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00000 f \n"
    d = {b"Root": Ref(1), b"Size": top} | {k.encode(): v for k, v in trailer.items()}
    return bytes(out) + b"trailer\n" + written(d) + b"\nstartxref\n%d\n%%%%EOF" % at


TREE = {1: {b"Type": Name(b"Catalog"), b"Pages": Ref(2)}, 2: {b"Type": Name(b"Pages"), b"Kids": [Ref(3)], b"Count": 1}, 3: {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(4)}}


@pytest.mark.parametrize("table", [True, False])
@pytest.mark.parametrize("data", [b"seven b\r", b"ends\n", b"ends\r\n", b"a endstream inside b", b"endstream", b"", b"x endobj 9 0 obj 3 endobj"] + [bytes([65, x]) for x in range(0, 256, 17)])
def test_streams_of_indirect_length(table, data):
    raw = b"<</Length 5 0 R>>\nstream\n" + data + b"\nendstream"
    made = with_table(TREE | {4: raw, 5: b"%d" % len(data)})
    doc = Document(made if table else made[: made.rindex(b"xref\n0 ")] + b"trailer\n<</Root 1 0 R>>")
    assert doc.objects[Ref(4)].data == data
    assert Document(doc.save()).content(Document(doc.save()).pages()[0][1]) == data


def test_newest_cross_references_win():
    old = with_table(TREE | {4: Stream({}, b"old"), 5: b"(gone)"})
    at = len(old) + 1
    new = b"\n4 0 obj\n" + written(Stream({}, b"new")) + b"\nendobj\n"
    table = b"xref\n4 1\n%010d 00000 n \n5 1\n0000000000 00001 f \n" % at
    begin = len(old) + len(new)
    prev = int(old.split(b"startxref\n")[1].split()[0])
    doc = Document(old + new + table + b"trailer\n<</Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (prev, begin))
    assert doc.objects[Ref(4)].data == b"new" and Ref(5) not in doc.objects
    # a table that points elsewhere is no table: the file is scanned
    broken = old.replace(b"startxref\n%d" % prev, b"startxref\n%d" % (prev - 30))
    assert Document(broken).objects[Ref(4)].data == b"old" and Ref(5) in Document(broken).objects


def test_packed_objects_of_an_older_revision():
    doc = Document(base())
    first = Document(doc.save())
    assert first._packed and Ref(1) in first.objects
    # a second object stream that redefines an object, found by scanning alone: the later one counts
    body = b"1 0 <</Type/Catalog/Pages 2 0 R/Later true>>"
    later = Stream({b"Type": Name(b"ObjStm"), b"N": 1, b"First": 4}, body)
    whole = doc.save().replace(b"startxref", b"startxxxx") + b"\n900 0 obj\n" + written(later) + b"\nendobj\n"
    assert Document(whole).dict_of(Document(whole).trailer[b"Root"]).get(b"Later") is True


def test_mutants_never_raise(spark):
    seed, source, out = 0xC0FFEE01, base(), []
    source = source[:4000] + source[-4000:]
    for _ in range(96):
        m = bytearray(source)
        for _ in range(24):
            seed = (seed * 1664525 + 1013904223) % 2**32
            m[seed % len(m)] = seed >> 24
        out.append(bytes(m))
    assert pdf.optimize(files(spark, *out)).count() == 96 and pdf.analyze(files(spark, *out)).count() == 96


def test_shared_resources_and_vetoes():
    page = lambda n: {b"Type": Name(b"Page"), b"Parent": Ref(2), b"Contents": Ref(n), b"Resources": Ref(11)}
    res = {b"Font": {b"F1": Ref(5), b"F2": Ref(8)}, b"XObject": {b"Im0": Ref(7), b"Im1": Ref(6)}}
    pages = {b"Type": Name(b"Pages"), b"Kids": [Ref(3), Ref(12)], b"Count": 2}
    second = Stream({}, b"BT /F2 9 Tf (x) Tj ET")
    doc = Document(base(o2=pages, o3=page(4), o11=res, o12=page(13), o13=second))
    assert pdf_rewrite.remove_unused_resources(doc) == 1 and set(doc.objects[Ref(11)][b"XObject"]) == {b"Im1"}
    unsafe = {**page(13), b"Annots": [{b"AP": {}}]}
    doc = Document(base(o2=pages, o3=page(4), o11=res, o12=unsafe, o13=second))
    assert pdf_rewrite.remove_unused_resources(doc) == 0
    doc = Document(base(o2=pages, o3=page(4), o11=res, o12=page(13), o13=Stream({}, b"/Gone Do")))
    assert pdf_rewrite.remove_unused_resources(doc) == 0
    held = {**pages, b"Kids": [Ref(3)], b"Resources": res}
    doc = Document(base(o2=held, o3={k: v for k, v in page(4).items() if k != b"Resources"}))
    assert pdf_rewrite.remove_unused_resources(doc) == 2


def test_passwords():
    import hashlib

    pad, ident, o = pdf_rewrite.__dict__.get("_PAD") or bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a"), b"0123456789abcdef", b"o" * 32

    def locked(password):
        key = hashlib.md5((password + pad)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()[:5]
        own = hashlib.md5(key + (4).to_bytes(4, "little")[:3] + b"\0\0").digest()[:10]
        e = {b"Filter": Name(b"Standard"), b"V": 1, b"R": 2, b"O": o, b"P": -4, b"U": rc4(key, pad)}
        data = base(o4=Stream({}, rc4(own, b"BT /F1 9 Tf (secret) Tj ET")), o14=e)
        return data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 14 0 R/ID[" + written(ident) + b"]")

    doc = Document(locked(b""))
    assert doc.unlocked and b"secret" in doc.content(doc.pages()[0][1])
    for password, code in ((None, "passwordRequired"), ("wrong", "wrongPassword")):
        with pytest.raises(PdfError) as e:
            Document(locked(b"pw"), password)
        assert e.value.code == code
    assert Document(locked(b"pw"), "pw").unlocked


def test_filters():
    assert unrun(b"\2abc\xfex\x80zz") == b"abcxxx"
    assert unlzw(bytes.fromhex("800b6050220c0c8501")) == b"-----A---B"
    assert decoded(Stream({b"Filter": [Name(b"AHx"), Name(b"Fl")]}, zlib.compress(b"hi").hex().encode() + b">")) == b"hi"
    assert decoded(Stream({b"Filter": Name(b"A85")}, b"<~87cURD]i,\"Ebo80~>")) == b"Hello World!"
    rows = bytes([2, 1, 1, 1]) + bytes([1, 1, 1, 1]) + bytes([4, 1, 1, 1])
    assert unpredicted(rows, 15, 1, 8, 3) == bytes([1, 1, 1, 1, 2, 3, 2, 3, 4])
    with pytest.raises(PdfError):
        decoded(Stream({b"Filter": Name(b"FlateDecode")}, zlib.compress(b"\0" * 10_000_000)), 1000)
    assert [op for op, _ in operations(b"q BI /W 1 ID xx EI Q (a) Tj")] == [b"q", b"BI", b"Q", b"Tj"]
    assert canonical({b"b": 1, b"a": [b"x", None]}) == canonical({b"a": [b"x", None], b"b": 1})


@pytest.mark.parametrize(("width", "height", "share"), [(50, 20, 0.3), (3000, 7, 0.01), (1, 3, 0.5), (5300, 5, 0.0005), (64, 40, 1.0)])
def test_fax_round_trip(width, height, share):
    plane = np.random.default_rng(3).random((height, width)) < share
    assert (fax.decode_g4(fax.encode_g4(plane), width, height) == plane).all()
    assert fax.decode_g4(b"", width, height) is None or width == 0


def test_fax_one_dimensional():
    rows = [fax.WHITE[3] + fax.BLACK[2] + fax.WHITE[3], fax.WHITE[0] + fax.BLACK[8]]
    pack = lambda text: int(text + "0" * (-len(text) % 8), 2).to_bytes((len(text) + 7) // 8, "big")
    want = np.array([[0, 0, 0, 1, 1, 0, 0, 0], [1] * 8], bool)
    assert (fax.decode_g3(pack("".join(rows)), 8, 2) == want).all()
    assert (fax.decode_g3(pack("".join(fax.END_OF_LINE + r for r in rows)), 8, 2, end_of_line=True) == want).all()
    assert (fax.decode_g3(b"".join(pack(r) for r in rows), 8, 2, aligned=True) == want).all()


def test_jpeg_quality_rises():
    p = photo(160, 120)
    found = [planes.psnr(p, jpeg.decode(jpeg.encode(p, q))) for q in (30, 60, 90)]
    assert found == sorted(found) and found[0] > 22 and jpeg.header_size(jpeg.encode(p, 50)) == (160, 120)
    with pytest.raises(ValueError, match="JPEG|frame"):
        jpeg.decode(b"\xff\xd8\xff\xc3" + bytes(40))


@pytest.mark.parametrize("progressive", [False, True])
def test_jpeg_of_another_encoder(spark, progressive):
    """Files of the JVM's encoder, with subsampled colour."""
    jvm, p = spark.sparkContext._jvm, photo(90, 61)
    picture = jvm.java.awt.image.BufferedImage(90, 61, 1)
    for y in range(61):
        for x in range(90):
            r, g, b = p[y, x].tolist()
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    settings = writer.getDefaultWriteParam()
    if progressive:
        settings.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), settings)
    stream.flush()
    data = bytes(out.toByteArray())
    assert (b"\xff\xc2" in data) == progressive
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    theirs = np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(90)] for y in range(61)], np.uint8)
    assert planes.psnr(jpeg.decode(data), theirs) > 30 and jpeg.decode(data).shape == (61, 90, 3)


def test_planes():
    assert planes.naive_cmyk(np.array([[[0, 0, 0, 0], [255, 0, 0, 0], [0, 0, 0, 255]]], np.uint8)).tolist() == [[[255, 255, 255], [0, 255, 255], [0, 0, 0]]]
    assert planes.calibrated_cmyk(np.array([[[0, 0, 0, 0], [255, 255, 255, 255]]], np.uint8)).tolist() == [[[255, 255, 255], [0, 0, 0]]]
    assert planes.unpack(bytes([0x12, 0x30, 0x45, 0x60]), 3, 2, 4).tolist() == [[1, 2, 3], [4, 5, 6]]
    assert planes.target_size(1080, 500, 1000) == (1080, 500) and planes.target_size(2000, 1000, 1000) == (1000, 500)
    flat = np.full((40, 60), 77, np.uint8)
    assert (planes.resized(flat, 23, 17) == 77).all() and planes.detail(flat) == 0 and planes.near_bilevel(np.where(flat > 0, 255, 0))
    with pytest.raises(ValueError, match="palette"):
        planes.looked_up(np.array([3]), b"\0" * 9, 3)


def profile(lab_of, grid=3, wide=False, tag=b"A2B1", space=b"CMYK"):
    """A CMYK profile whose grid holds Lab colours of inks, with straight curves."""
    place = np.stack(np.meshgrid(*[np.linspace(0, 1, grid)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    lab = np.array([lab_of(*p) for p in place])
    if wide:
        cells = np.stack([lab[:, 0] * 652.8, (lab[:, 1] + 128) * 256, (lab[:, 2] + 128) * 256], axis=1)
        cells, line = np.rint(cells).astype(">u2").tobytes(), np.array([0, 65535], ">u2").tobytes()
        curves = (2).to_bytes(2, "big") * 2 + line * 4
    else:
        cells = np.rint(np.stack([lab[:, 0] * 2.55, lab[:, 1] + 128, lab[:, 2] + 128], axis=1)).astype(np.uint8).tobytes()
        line = bytes(range(256))
        curves = line * 4
    table = (b"mft2" if wide else b"mft1") + bytes(4) + bytes([4, 3, grid, 0]) + bytes(36) + curves + cells + line * 3
    head = bytearray(128)
    head[16:20], head[20:24], head[36:40] = space, b"Lab ", b"acsp"
    return bytes(head) + (1).to_bytes(4, "big") + tag + (144).to_bytes(4, "big") + len(table).to_bytes(4, "big") + table


@pytest.mark.parametrize("wide", [False, True])
def test_colours_by_profile(wide):
    from leafmill.functions import icc

    # the inks' colours add up so that interpolation is exact: L falls with black, a with cyan, b grows with yellow
    data = profile(lambda c, m, y, k: (100 * (1 - k), -60 * c + 60 * m, 60 * y), wide=wide)
    t = icc.Transform(data)
    plane = np.array([[[0, 0, 0, 0], [0, 0, 0, 255], [0, 0, 0, 128], [0, 255, 0, 100], [255, 0, 128, 40]]], np.uint8)
    rgb = t.rgb(plane)[0].astype(int)
    assert rgb[0].min() >= 254 and rgb[1].max() <= 1 and abs(rgb[2] - 118).max() <= 3  # white, black, gray of L = 49.8
    assert rgb[3][0] > rgb[3][1] and rgb[4][1] > rgb[4][0] and rgb[4][1] > rgb[4][2]
    bright = icc.Transform(profile(lambda c, m, y, k: (100 - 80 * k, 0, 0), wide=wide)).rgb(plane[:, :2])
    assert bright[0, 0].min() >= 254 and bright[0, 1].max() <= 1  # the darkest ink is made black
    for bad in (data[:300], data[:128] + bytes(40), profile(lambda *x: (0, 0, 0), space=b"RGB "), b"x" * 200):
        with pytest.raises(icc.IccError):
            icc.Transform(bad)


def test_images_with_a_profile():
    data = profile(lambda c, m, y, k: (100 * (1 - k), 0, 0))
    inks = np.zeros((120, 130, 4), np.uint8)
    inks[..., 3] = np.arange(130) * 255 // 129
    space = [Name(b"ICCBased"), Ref(12)]
    made = lambda icc: Document(pdf_make.assembled(pdf_make.page_of([pdf_make.image(130, 120, zlib.compress(inks.tobytes()), [b"FlateDecode"], space)], o12=Stream({b"N": 4}, icc))))
    seen = []
    for icc in (data, b"broken" * 40):
        doc = made(icc)
        s, found = doc.objects[Ref(10)], pdf_rewrite.colour_space(doc, space, {})
        assert found["kind"] == "cmyk" and found["icc"] == icc
        seen.append(pdf_rewrite.plane_of(doc, s, pdf_rewrite.image_facts(doc, Ref(10), {}, {}), found))
    assert np.ptp(seen[0].astype(int), axis=2).max() <= 2 and (np.diff(seen[0][0, :, 0].astype(int)) <= 0).all()
    assert (seen[1] == planes.calibrated_cmyk(inks)).all()
    assert pdf_rewrite.cmyk_profile({"kind": "indexed", "base": {"kind": "cmyk", "icc": b"x"}}) == b"x" and pdf_rewrite.cmyk_profile({"kind": "gray"}) is None


def test_bilevel_and_indexed_images():
    black = np.zeros((900, 900), bool)
    black[100:300, 50:800] = True
    plane = np.where(black, 0, 255).astype(np.uint8)
    gray = image(zlib.compress(np.clip(plane.astype(int) + np.random.default_rng(1).integers(0, 9, plane.shape), 0, 255).astype(np.uint8).tobytes()), 900, 900, ColorSpace=Name(b"DeviceGray"), Filter=Name(b"FlateDecode"))
    index = image(zlib.compress(np.random.default_rng(2).integers(0, 4, (900, 900)).astype(np.uint8).tobytes()), 900, 900, Filter=Name(b"FlateDecode"),
                  ColorSpace=[Name(b"Indexed"), Name(b"DeviceRGB"), 3, bytes(range(12))])
    doc = Document(base(o6=gray, o7=index))
    settings = pdf.default_settings(max_image_size_px=450)
    tasks, skipped = pdf_rewrite.image_tasks(doc, settings)
    assert [t[0][0] for t in tasks] == [6, 7] or [t[0][0] for t in tasks] == [7, 6]
    done = {t[0][0]: pdf_rewrite.attempt(doc, t, settings) for t in tasks}
    d, data, _ = done[6]
    assert d[b"Filter"] == b"CCITTFaxDecode" and (d[b"Width"], d[b"Height"]) == (450, 450)
    assert abs(int(fax.decode_g4(data, 450, 450).sum()) - 100 * 375) < 900
    assert done[7][0][b"Filter"] == b"DCTDecode" and not skipped


def font_file(*args):
    return Document(pdf_make.font_file(*args))


def test_font_subsets():
    from leafmill.functions import fonts

    doc = font_file(pdf_make.truetype(), b"CIDFontType2", b"FontFile2", b"\0\4\0")  # glyph 4 is composed of 1; a last odd byte shows nothing
    assert pdf_rewrite.subset_fonts(doc)[0] == 1
    places, glyf, _ = fonts._outlines(decoded(doc.objects[Ref(8)]))
    assert [b > a for a, b in zip(places, places[1:])] == [True, True, False, False, True]
    doc = font_file(pdf_make.cff(), b"CIDFontType0", b"FontFile3", b"\0\x0b")
    assert fonts.Cff(pdf_make.cff()).cids() == [0, 10, 11, 12, 13] and pdf_rewrite.subset_fonts(doc)[0] == 1
    data = decoded(doc.objects[Ref(8)])
    assert [set(data[a:b]) == {14} for a, b in fonts.Cff(data).glyphs] == [False, True, False, True, True]
    for unsafe in ({b"Annots": [{b"AP": {}}]}, {b"Contents": Ref(99), b"Resources": Ref(98)}):
        doc = font_file(pdf_make.truetype(), b"CIDFontType2", b"FontFile2", b"\0\1", unsafe)
        assert pdf_rewrite.subset_fonts(doc)[0] == 0
    for k in range(0, len(pdf_make.cff()), 3):
        for broken in (pdf_make.cff()[:k], pdf_make.cff()[:k] + b"\xff" + pdf_make.cff()[k + 1 :]):
            try:
                fonts.subset_cff(broken, {1})
                fonts.Cff(broken).cids()
            except (fonts.FontError, IndexError):
                pass


def test_aes_by_published_vectors():
    from leafmill.functions import aes

    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert aes.encrypt_cbc(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.encrypt_cbc(bytes(range(32)), bytes(16), plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for k in (key, bytes(range(32))):
        assert aes.decrypt_cbc(k, plain, aes.encrypt_cbc(k, plain, plain * 5), padded=False) == plain * 5


@pytest.mark.parametrize("revision", [4, 5, 6])
def test_aes_passwords(revision):
    import hashlib

    from leafmill.functions import aes

    start, text = b"\7" * 16, b"BT /F1 9 Tf (secret) Tj ET"
    text += bytes([16 - len(text) % 16]) * (16 - len(text) % 16)

    def locked(password):
        if revision == 4:
            pad, ident, o = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a"), b"0123456789abcdef", b"o" * 32
            key = hashlib.md5((password + pad)[:32] + o + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()
            for _ in range(50):
                key = hashlib.md5(key).digest()
            u = rc4(key, hashlib.md5(pad + ident).digest())
            for i in range(1, 20):
                u = rc4(bytes(x ^ i for x in key), u)
            own = hashlib.md5(key + (4).to_bytes(4, "little")[:3] + b"\0\0sAlT").digest()
            e = {b"V": 4, b"R": 4, b"O": o, b"U": u + bytes(16), b"P": -4, b"Length": 128}
            method = b"AESV2"
        else:
            make = aes.hardened if revision == 6 else lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()
            own, ident = bytes(range(32)), b""
            u = make(password, b"a" * 8) + b"a" * 8 + b"b" * 8
            o = make(b"owner", b"c" * 8, u) + b"c" * 8 + b"d" * 8
            e = {b"V": 5, b"R": revision, b"U": u, b"O": o, b"UE": aes.encrypt_cbc(make(password, b"b" * 8), bytes(16), own), b"OE": aes.encrypt_cbc(make(b"owner", b"d" * 8, u), bytes(16), own)}
            method = b"AESV3"
        e |= {b"Filter": Name(b"Standard"), b"StmF": Name(b"StdCF"), b"StrF": Name(b"StdCF"), b"CF": {b"StdCF": {b"CFM": Name(method)}}}
        data = base(o4=Stream({}, start + aes.encrypt_cbc(own, start, text)), o14=e)
        return data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 14 0 R/ID[" + written(ident) + b"]")

    doc = Document(locked(b""))
    assert doc.unlocked and b"(secret)" in doc.content(doc.pages()[0][1])
    assert Document(locked(b"pw"), "pw").unlocked and (revision == 4 or Document(locked(b"pw"), "owner").unlocked)
    for password, code in ((None, "passwordRequired"), ("wrong", "wrongPassword")):
        with pytest.raises(PdfError) as e:
            Document(locked(b"pw"), password)
        assert e.value.code == code


def test_batch_and_notices(spark, tmp_path):
    from leafmill.operators import batch

    (tmp_path / "d").mkdir()
    for name in ("b.pdf", "d/a.PDF", "c.txt"):
        (tmp_path / name).write_bytes(base())
    got = [r.path for r in batch.expanded(spark, [str(tmp_path / "b.pdf"), str(tmp_path)]).collect()]
    assert got == [str(tmp_path / "b.pdf"), str(tmp_path / "d/a.PDF")]
    results = pdf.optimize(files(spark, base(), pdf_make.text_pdf("x"), b"no"), pdf.default_settings("conservative")).cache()
    s = batch.summary(results).first()
    assert (s.files_compressed + s.files_not_smaller, s.files_failed, s.any_failed) == (2, 1, True) and s.original_bytes > s.compressed_bytes > 0
    r = {x.doc_id: x for x in results.collect()}
    codes = [n.code for n in r["0"].notices]
    assert codes[:2] == ["appliedProfile", "safeRewrite"] and {"imageDedupe", "resourcesCleaned", "metadataKept"} <= set(codes) and r["2"].notices is None
    aimed = pdf.optimize(files(spark, base()), target_bytes=40_000).first()
    assert [n.code for n in aimed.notices][:2] == ["targetSizeMet", "appliedProfile"] and aimed.savings_percent > 90


def test_queue_of_files(spark, tmp_path):
    from leafmill.streaming import files as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(base())
    run = lambda: stream.process(spark, str(tmp_path / "in"), pdf.analyze, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(90)
    run()
    (tmp_path / "in" / "b.pdf").write_bytes(pdf_make.text_pdf("hello"))
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id.rsplit("/", 1)[1] for r in got.collect()) == ["a.pdf", "b.pdf"] and got.select("batch").distinct().count() == 2


def test_arithmetic_decoder_by_the_published_sequence():
    from leafmill.functions import jbig2

    coded = bytes.fromhex("84c73bfce1a1430402200000410dbb86f4317fff88ff37471adb6adfffac")
    d, contexts = jbig2.Decoder(coded), [0]
    bits = [d.bit(contexts, 0) for _ in range(256)]
    assert np.packbits(bits).tobytes().hex() == "00020051000000c0035287" + "2aaaaaaaaa82c02000fcd79ef6bf7fed904f46a3bf"


class _Encoder:
    """The arithmetic encoder, to make test data."""

    def __init__(self):
        self.a, self.c, self.count, self.out = 0x8000, 0, 12, bytearray(b"\0")

    def bit(self, contexts, number, value):
        from leafmill.functions import jbig2

        state, likely = contexts[number] >> 1, contexts[number] & 1
        q = jbig2._QE[state]
        self.a -= q
        if value == likely:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            state = jbig2._NEXT[state]
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            likely ^= jbig2._SWAP[state]
            state = jbig2._LESS[state]
        contexts[number] = state << 1 | likely
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.count -= 1
            if not self.count:
                self.byte()

    def byte(self):
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            if self.out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.count = 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c &= 0x7FFFF
            self.count = 8

    def done(self):
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self.byte()
        return bytes(self.out[1:]) + b"\xff\xac"


@pytest.mark.parametrize("template", [0, 1, 2, 3])
def test_jbig2_generic_regions(template):
    from leafmill.functions import jbig2

    moved = [(3, -1), (-3, -1), (2, -2), (-2, -2)] if template == 0 else [(3, -1)] if template == 1 else [(2, -1)]
    y, x = np.mgrid[0:30, 0:45]
    plane = ((x // 7 + y // 5) % 3 == 0) ^ (np.random.default_rng(1).random((30, 45)) < 0.05)
    rows, _ = jbig2.TEMPLATES[template]
    places = sorted([(dy, dx) for dy, a, b in rows for dx in range(a, b + 1)] + [(dy, dx) for dx, dy in moved])
    e, contexts, wide = _Encoder(), [0] * (1 << len(places)), np.pad(plane, 9)
    for r in range(30):
        for c in range(45):
            number = 0
            for dy, dx in places:
                number = number << 1 | int(wide[r + 9 + dy, c + 9 + dx])
            e.bit(contexts, number, int(plane[r, c]))
    four = lambda *v: b"".join(n.to_bytes(4, "big") for n in v)
    segment = lambda n, kind, d: four(n) + bytes([kind, 0, 1]) + four(len(d)) + d
    at = b"".join(bytes([dx & 255, dy & 255]) for dx, dy in moved)
    data = segment(0, 48, four(45, 30, 0, 0) + b"\0\0\0") + segment(1, 38, four(45, 30, 0, 0) + bytes([0, template << 1]) + at + e.done())
    assert (jbig2.decode(data, 45, 30) == plane).all()
    coded = segment(0, 48, four(45, 30, 0, 0) + b"\0\0\0") + segment(1, 38, four(45, 30, 0, 0) + bytes([0, 1]) + fax.encode_g4(plane))
    assert (jbig2.decode(coded, 45, 30) == plane).all()
    for k in range(0, len(data), 5):
        try:
            jbig2.decode(data[:k], 45, 30)
        except ValueError:
            pass
    with pytest.raises(ValueError, match="segment"):
        jbig2.decode(segment(0, 53, b""), 45, 30)


class _Jbig2(_Encoder):
    """Numbers, ids and bitmaps as symbol dictionaries and text regions hold them."""

    def __init__(self):
        super().__init__()
        self.known = {}

    def number(self, kind, value):
        from leafmill.functions import jbig2

        contexts, before = self.known.setdefault(kind, [0] * 512), 1
        size = 0 if value is None else abs(value)
        k = max(i for i, (_, low) in enumerate(jbig2.Numbers.RANGES) if size >= low)
        n, low = jbig2.Numbers.RANGES[k]
        for b in [int(value is None or value < 0)] + [1] * k + [0] * (k < 5) + [(size - low) >> i & 1 for i in range(n - 1, -1, -1)]:
            self.bit(contexts, before, b)
            before = before << 1 | b if before < 256 else (before << 1 | b) & 511 | 256

    def ident(self, value, bits):
        contexts, before = self.known.setdefault("id", [0] * (2 << bits)), 1
        for i in range(bits - 1, -1, -1):
            b = value >> i & 1
            self.bit(contexts, before, b)
            before = before << 1 | b

    def plane(self, plane, places, kind="plane", under=None, others=()):
        """places, others: (x, y) of the pixels seen, of the plane and of the one under it."""
        contexts = self.known.setdefault(kind, [0] * (1 << len(places) + len(others)))
        wide, below = np.pad(plane, 140), None if under is None else np.pad(under, 140)
        for r in range(plane.shape[0]):
            for c in range(plane.shape[1]):
                number = 0
                for dx, dy in places:
                    number = number << 1 | int(wide[r + 140 + dy, c + 140 + dx])
                for dx, dy in others:
                    y, x = r + 140 + dy, c + 140 + dx
                    number = number << 1 | int(below[y, x] if y < below.shape[0] and x < below.shape[1] else 0)
                self.bit(contexts, number, int(plane[r, c]))


def _jbig2_places(template, moved):
    from leafmill.functions import jbig2

    rows, _ = jbig2.TEMPLATES[template]
    return [(dx, dy) for dy, dx in sorted([(dy, dx) for dy, a, b in rows for dx in range(a, b + 1)] + [(dy, dx) for dx, dy in moved])]


_four = lambda *v: b"".join((n & 0xFFFFFFFF).to_bytes(4, "big") for n in v)


def _jbig2_segment(n, kind, d, *told):
    return _four(n) + bytes([kind, len(told) << 5, *told, 1]) + _four(len(d)) + d


GLYPHS = [np.array([[c == "#" for c in row] for row in g.split()]) for g in ("##. #.# ##. #.# ##.", ".#. #.# ### #.# #.#", "### #.. ##. #.. ###", "#### #..#")]


def _jbig2_symbols(glyphs, fine=None):
    """A dictionary of glyphs by height; fine: pairs (glyph that is refined, refinement) that come after."""
    moved = [(3, -1), (-3, -1), (2, -2), (-2, -2)]
    e, height = _Jbig2(), 0
    for h in sorted({g.shape[0] for g in glyphs}):
        e.number("dh", h - height)
        height, width = h, 0
        for g in [g for g in glyphs if g.shape[0] == h]:
            e.number("dw", g.shape[1] - width)
            width = g.shape[1]
            e.plane(g, _jbig2_places(0, moved))
        e.number("dw", None)
    e.number("ex", 0)
    e.number("ex", len(glyphs))
    at = b"".join(bytes([dx & 255, dy & 255]) for dx, dy in moved)
    return (0).to_bytes(2, "big") + at + _four(len(glyphs), len(glyphs)) + e.done()


@pytest.mark.parametrize("corner", [0, 1, 2, 3])
@pytest.mark.parametrize("transposed", [False, True])
@pytest.mark.parametrize("refines", [False, True])
def test_jbig2_symbols_and_text(corner, transposed, refines):
    from leafmill.functions import jbig2

    glyphs = sorted(GLYPHS, key=lambda g: g.shape[0])
    page, e = np.zeros((40, 60), bool), _Jbig2()
    shifts = [(-1, -1), (-1, -1)]
    own, others = jbig2._REFINED[0]
    lines = [(6, 0, [0, 1, 2, 3, 1]), (16, 4, [3, 3, 0]), (27, 2, [2])]
    e.number("dt", 0)
    across = first = 0
    for t, begin, ids in lines:
        e.number("dt", t - across)
        e.number("fs", begin - first)
        across, first, along = t, begin, begin
        for k, i in enumerate(ids):
            if k:
                e.number("ds", 2 - 1)  # and one more by the region's offset
                along += 2
            e.ident(i, 2)
            g = glyphs[i]
            if refines:
                e.number("ri", k % 2)
                if k % 2:
                    g = np.pad(g, ((0, 1), (1, 0)))
                    g[-1, 0] = True
                    for kind, v in (("rdw", 1), ("rdh", 1), ("rdx", 1), ("rdy", 0)):
                        e.number(kind, v)
                    old = np.zeros(g.shape, bool)
                    old[: g.shape[0] - 1, 1:] = glyphs[i]  # half of one is none, and one to the right
                    e.plane(g, [*own, shifts[0]], "refined", old, [*others, shifts[1]])
            h, w = g.shape
            along += (h if transposed else w) - 1 if corner in ((0, 2) if transposed else (2, 3)) else 0
            x, y = (t, along) if transposed else (along, t)
            x, y = x - (w - 1) * (corner in (2, 3)), y - (h - 1) * (corner in (0, 2))
            page[max(y, 0) : y + h, max(x, 0) : x + w] |= g[max(-y, 0) :, max(-x, 0) :][: 40 - max(y, 0), : 60 - max(x, 0)]
            along += (h if transposed else w) - 1 if corner in ((1, 3) if transposed else (0, 1)) else 0
        e.number("ds", None)
    flags = 2 * refines | corner << 4 | transposed << 6 | 1 << 10
    body = _four(60, 40, 0, 0) + b"\0" + flags.to_bytes(2, "big") + (b"\xff\xff\xff\xff" if refines else b"") + _four(9) + e.done()
    data = _jbig2_segment(1, 48, _four(60, 40, 0, 0) + b"\0\0\0") + _jbig2_segment(2, 6, body, 0)
    shared = _jbig2_segment(0, 0, _jbig2_symbols(glyphs))
    assert (jbig2.decode(data, 60, 40, shared) == page).all()
    for k in range(0, len(data), 7):
        try:
            jbig2.decode(data[:k] + b"\x55" + data[k + 1 :], 60, 40, shared)
        except ValueError:
            pass


def test_jbig2_symbols_of_symbols():
    from leafmill.functions import jbig2

    old, new = GLYPHS[0], GLYPHS[0].copy()
    new[0, 2] = True
    pair = np.zeros((5, 7), bool)
    pair[:, :3] |= old
    pair[:, 4:7] |= new
    own, others = jbig2._REFINED[1]
    e = _Jbig2()
    e.number("dh", 5)
    e.number("dw", 3)
    e.number("ai", 1)  # one symbol, refined
    e.ident(0, 2)
    e.number("rdx", 0)
    e.number("rdy", 0)
    e.plane(new, own, "refined", old, others)
    e.number("dw", 4)
    e.number("ai", 2)  # two of them, side by side
    for kind, v in (("dt", 0), ("dt", 0), ("fs", 0)):
        e.number(kind, v)
    e.ident(0, 2)
    e.number("ri", 0)
    e.number("ds", 2)
    e.ident(1, 2)
    e.number("ri", 0)
    e.number("ds", None)
    e.number("dw", None)
    for run in (1, 2):
        e.number("ex", run)
    flags = (2 | 1 << 12).to_bytes(2, "big")
    got = jbig2.dictionary(flags + b"\3\xff\xfd\xff\2\xfe\xfe\xfe" + _four(2, 2) + e.done(), [old])
    assert len(got) == 2 and (got[0] == new).all() and (got[1] == pair).all()


def test_jbig2_halftones_and_refined_regions():
    from leafmill.functions import jbig2

    dots = [np.add.outer(np.arange(4), np.arange(4)) < k for k in (0, 2, 4, 7)]
    e = _Jbig2()
    e.plane(np.concatenate(dots, axis=1), _jbig2_places(1, [(-4, 0)]))
    made = bytes([2, 4, 4]) + _four(3) + e.done()
    gray = np.add.outer(np.arange(5), np.arange(6)) % 4
    e, last = _Jbig2(), np.zeros((5, 6), bool)
    for k in (1, 0):
        now = gray >> k & 1 > 0
        e.plane(now ^ last, _jbig2_places(1, [(3, -1)]))
        last = now
    grid = bytes([2]) + _four(6, 5, 0, 0) + (4 << 8).to_bytes(2, "big") + b"\0\0" + e.done()
    page = np.block([[dots[v] for v in row] for row in gray])
    start = _jbig2_segment(1, 48, _four(24, 20, 0, 0) + b"\0\0\0")
    data = start + _jbig2_segment(2, 16, made) + _jbig2_segment(3, 22, _four(24, 20, 0, 0) + b"\0" + grid, 2)
    assert (jbig2.decode(data, 24, 20) == page).all()
    fine = page.copy()
    fine[3:6, 7:19] ^= True
    own, others = jbig2._REFINED[1]
    e = _Jbig2()
    e.plane(fine, own, "refined", page, others)
    more = _jbig2_segment(4, 42, _four(24, 20, 0, 0) + b"\4\1" + e.done())
    assert (jbig2.decode(data + more, 24, 20) == fine).all()


def test_text_signals_of_long_documents(spark, tmp_path):
    from leafmill.plans import registry

    texts = {1: "a b\n" * 30, 2: "\n".join(f"line {i}" for i in range(1201)), 3: "xy\n" * 4000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.page_count, r.text_chars) for r in registry.pdf_text_signals(spark, str(tmp_path)).collect()}
    assert got == {str(k): (-(-len(t.split("\n")) // 50), len("".join(t.split()))) for k, t in texts.items()}


def test_streams_of_nothing_and_of_damaged_data():
    for nothing in (zlib.compress(b""), b"\x03\0"):
        assert decoded(Stream({b"Filter": Name(b"FlateDecode")}, nothing)) == b""
    for kind in range(pdf_make.FILTERS):
        assert decoded(pdf_make.filtered(b"", kind)) == b""
    with pytest.raises(PdfError, match="damaged"):
        decoded(Stream({b"Filter": Name(b"FlateDecode")}, zlib.compress(b"")[:2]))
    for n in (1599, 1600, 1601, 3200):
        assert unlzw(pdf_make.lzw(bytes(k * k % 251 for k in range(n)))) == bytes(k * k % 251 for k in range(n))


def test_stream_filters_of_odd_rows(spark, tmp_path):
    import duckdb

    from leafmill.plans import registry

    texts = ["", "\0", "ab\0\0", "é " * 40, None]
    rows = [(6 * i + k, t) for i, t in enumerate(texts) for k in range(6)] + [(None, "no id"), (None, ""), *((-k, "x" * k) for k in range(1, 7)), (7, "again"), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["stream_filters"](spark, str(tmp_path)).collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=str) == sorted(duck.execute(registry.ORACLES["stream_filters"]).fetchall(), key=str)
