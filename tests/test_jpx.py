import numpy as np
import pytest

from leafmill.functions import jpx
from leafmill.operators import pdf_rewrite
from leafmill.sources import pdf, pdf_make
from leafmill.sources.pdf_model import Document, Name, Ref, Stream

from .jpx_made import boxed, encode


def noise(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    p = (x * 7 + y * 13 + np.random.default_rng(seed).integers(0, 30, (h, w))) & 255
    return p.astype(np.uint8)


def test_the_published_example():
    """Of the standard's small example: a code block, the upper bit planes of another, and the wavelet."""
    values, lowest = jpx.block_values(bytes.fromhex("0fb176"), 1, 4, 2, 3, 7)
    assert values.ravel().tolist() == [1, 5, 1, 0] and lowest == 0
    values, lowest = jpx.block_values(bytes.fromhex("018f0dc8"), 1, 5, 0, 6, 10)
    assert values.ravel().tolist() == [-24, -20, -28, -32, -16] and lowest == 2
    column = lambda *x: np.array(x)[:, None]
    assert jpx._along(column(-26, -22, -30, -32, -19), column(1, 5, 1, 0), 0, True).ravel().tolist() == [-27, -25, -24, -23, -32, -31, -32, -26, -19]


@pytest.mark.parametrize(
    "options",
    [
        {}, {"levels": 0}, {"levels": 1, "order": 1}, {"levels": 3, "blocks": 0}, {"origin": (3, 5), "levels": 2}, {"precinct": (4, 4), "order": 2, "blocks": 0}, {"precinct": (5, 4), "order": 3, "origin": (1, 0)},
        {"precinct": (4, 5), "order": 4}, {"marks": 6}, {"layers": 2, "blocks": 0}, {"layers": 3, "order": 1, "blocks": 1}, {"levels": 5},
    ],
)
def test_lossless_gray(options):
    p = noise(45, 37)
    assert (jpx.decode(encode([p], **options)) == p).all()


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (2, 3), (64, 5)])
@pytest.mark.parametrize("origin", [(0, 0), (1, 1)])
def test_small_images(shape, origin):
    p = noise(*shape, seed=3)
    assert (jpx.decode(encode([p], origin=origin, levels=2)) == p).all()
    flat = np.full(shape, 128, np.uint8)
    assert (jpx.decode(encode([flat])) == flat).all()


@pytest.mark.parametrize("transform", [False, True])
def test_colour(transform):
    planes = [noise(33, 40, k) for k in range(3)]
    stream = encode(planes, transform=transform, order=2)
    for data in (stream, boxed(stream, jpx.SRGB)):
        assert (jpx.decode(data) == np.stack(planes, axis=-1)).all()
    inks = [noise(16, 20, k) for k in range(4)]
    assert jpx.decode(encode(inks)).shape == (16, 20, 4)


def test_subsampled_colour():
    y, flat = noise(32, 48), np.full((16, 24), 128, np.uint8)
    stream = encode([y, flat, flat], sub=[(1, 1), (2, 2), (2, 2)])
    for data in (stream, boxed(stream, jpx.SYCC)):  # neutral chroma: the luma is the image
        assert (jpx.decode(data) == y[..., None]).all()
    red = jpx.sycc(*(np.full((1, 1), v, np.uint8) for v in (76, 85, 255)))
    assert abs(red[0, 0].astype(int) - [254, 0, 0]).max() <= 1


def test_irreversible_wavelet_undoes_the_plain_analysis():
    """Analysis by the lifting steps in plain loops, mirrored at both ends."""
    for n, begin in ((9, 0), (8, 1), (2, 0), (3, 1), (40, 0)):
        x = np.random.default_rng(n).normal(0, 50, n)
        at = lambda v, i: v[(lambda j: j if j < n else 2 * n - 2 - j)(abs(i - begin) % (2 * n - 2))]
        v = x.copy()
        for odd, factor in ((1, jpx.ALPHA), (0, jpx.BETA), (1, jpx.GAMMA), (0, jpx.DELTA)):
            v = np.array([v[i - begin] + factor * (at(v, i - 1) + at(v, i + 1)) if i % 2 == odd else v[i - begin] for i in range(begin, begin + n)])
        low = np.array([v[i - begin] / jpx.SCALE for i in range(begin, begin + n) if i % 2 == 0])
        high = np.array([v[i - begin] * jpx.SCALE for i in range(begin, begin + n) if i % 2])
        assert np.allclose(jpx._along(low[:, None], high[:, None], begin, False).ravel(), x)


def test_damage_never_raises_anything_else():
    data = bytearray(boxed(encode([noise(20, 20)], blocks=0), jpx.GRAY))
    draw = np.random.default_rng(1)
    for _ in range(150):
        m = bytearray(data)
        for i in draw.integers(0, len(m), 4):
            m[i] = draw.integers(0, 256)
        try:
            jpx.decode(bytes(m[: draw.integers(1, len(m) + 1)]))
        except jpx.JpxError:
            pass


def test_images_of_documents():
    """Gray, coloured, inked, indexed and masked images are decoded and written anew; odd ones stay."""
    made = lambda data, space, **more: pdf_make.image(112, 104, data, [b"JPXDecode"], space, **more)
    gray, rgb = encode([noise(104, 112)]), encode([noise(104, 112, k) for k in range(3)], transform=True)
    index = encode([noise(104, 112) & 1])
    mask = made(encode([noise(104, 112, 9)]), Name(b"DeviceGray"))
    images = [
        made(gray, Name(b"DeviceGray")), made(rgb, Name(b"DeviceRGB"), SMask=Ref(20)), made(index, [Name(b"Indexed"), Name(b"DeviceRGB"), 1, b"\0\0\0\xff\xff\xff"]),
        made(gray, Name(b"DeviceRGB")), made(gray, Name(b"DeviceGray"), Decode=[1, 0]), made(b"broken", Name(b"DeviceGray")),
    ]
    doc = Document(pdf_make.assembled(pdf_make.page_of(images, o20=mask)))
    settings = pdf.default_settings(max_image_size_px=100)
    facts = lambda n: pdf_rewrite.image_facts(doc, Ref(n), {}, {})
    assert [facts(10 + i)["codec_supported"] for i in range(6)] == [True, True, True, True, False, True]
    plane = lambda n: pdf_rewrite.plane_of(doc, doc.objects[Ref(n)], facts(n), pdf_rewrite.colour_space(doc, doc.objects[Ref(n)].dict[b"ColorSpace"], {}))
    assert (plane(10) == noise(104, 112)).all() and plane(11).shape == (104, 112, 3) and set(np.unique(plane(12))) == {0, 255}
    out, stats = pdf_rewrite.optimize(doc, settings)
    reasons = {s["num"]: s["reason"] for s in stats["skips"]}
    assert reasons[14] == "unsupported filter" and reasons[13].startswith("not decoded") and reasons[15].startswith("not decoded")
    again = Document(out)
    kinds = sorted(bytes(o.dict[b"Filter"] if isinstance(o.dict[b"Filter"], Name) else o.dict[b"Filter"][0]) for o in again.objects.values() if isinstance(o, Stream) and o.dict.get(b"Subtype") == b"Image")
    assert kinds.count(b"JPXDecode") == 3 and kinds.count(b"FlateDecode") == 1 and kinds.count(b"CCITTFaxDecode") == 1
