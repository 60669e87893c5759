import hashlib
import random
import time
import zlib

import numpy as np

import pytest

from tidejoin.llm import gif as G
from tidejoin.llm import html_text as H


@pytest.mark.parametrize("make", [lambda r: bytes(r.randrange(256) for _ in range(576 * 3)), lambda r: b"a" * 576, lambda r: (b"abcab" * 999)[: 576 * 4]])
def test_payloads_come_back(make):
    data = make(random.Random(1))
    _, _, frames = G.parse(G.write([data])[0])
    assert b"".join(f.pixels.tobytes() for f in frames) == data


@pytest.mark.parametrize("n", [1, 5000, 200_000])
def test_full_tables_and_clear_codes(n):
    rng = random.Random(n)
    for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(3) for _ in range(n)), b"z" * n):
        assert G.lzw_expand(G.pack_codes([G.lzw_codes(data)]), 8)[0].tobytes() == data


def image(pixels, least, left, top, w, h, flags=0, local=None):
    """A frame whose code stream has a clear code before every pixel."""
    bits, clear = [], 1 << least
    for c in [x for p in pixels for x in (clear, p)] + [clear + 1]:
        bits += [c >> k & 1 for k in range(least + 1)]
    data = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    size = 0x80 | (least - 1) if local else 0
    return b"\x2c" + np.array([left, top, w, h], "<u2").tobytes() + bytes([flags | size]) + (local or b"") + bytes([least]) + G._blocks(data)


def control(disposal, delay, transparent=None):
    return b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None), delay & 255, delay >> 8, transparent or 0]) + b"\0"


def test_disposal_transparency_palettes_and_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + np.array([4, 4], "<u2").tobytes() + bytes([0x81, 0, 0]) + palette
    frames = [
        control(1, 10) + image([1] * 16, 2, 0, 0, 4, 4),
        control(3, 5, 0) + image([2, 0, 0, 2], 2, 1, 1, 2, 2),
        control(2, 7) + image([3] * 4, 2, 0, 0, 2, 2, local=bytes(9) + bytes([9, 9, 9])),
        control(0, 1, 0) + image([0] * 16, 2, 0, 0, 4, 4),
    ]
    value = head + b"\x21\xfe\x03abc\0" + b"".join(frames) + b"\x3b"
    shown = list(G.rendered(*G.parse(value)))
    assert [(s, d) for s, d, _ in shown] == [(0, 100), (100, 50), (150, 70), (220, 10)]
    red, green = [255, 0, 0, 255], [0, 255, 0, 255]
    assert (shown[0][2] == red).all()
    assert shown[1][2][1, 1].tolist() == green and shown[1][2][1, 2].tolist() == red
    assert shown[2][2][0, 0].tolist() == [9, 9, 9, 255] and shown[2][2][1, 1].tolist() == [9, 9, 9, 255] and shown[2][2][2, 2].tolist() == red
    assert shown[3][2][0, 0].tolist() == [0, 0, 0, 0] and shown[3][2][3, 3].tolist() == red
    assert G.histogram(shown[3][2])[48] == 12
    rows = head + image([r % 4 for r in [0, 8, 4, 2, 6, 1, 3, 5, 7] for _ in range(1)], 2, 0, 0, 1, 9, flags=0x40) + b"\x3b"
    assert G.parse(rows)[2][0].pixels.ravel().tolist() == [0, 1, 2, 3, 0, 1, 2, 3, 0]


def naive(width, height, frames):
    """Each frame's canvas, pixel by pixel."""
    canvas, out = {}, []
    for f in frames:
        before = dict(canvas)
        for (y, x), index in np.ndenumerate(f.pixels):
            place = (f.left + x, f.top + y)
            if index != f.transparent and place[0] < width and place[1] < height:
                canvas[place] = tuple(f.palette[index]) if index < len(f.palette) else (0, 0, 0)
        out.append(dict(canvas))
        if f.disposal == 2:
            canvas = {p: c for p, c in canvas.items() if not (f.left <= p[0] < f.left + f.pixels.shape[1] and f.top <= p[1] < f.top + f.pixels.shape[0])}
        elif f.disposal == 3:
            canvas = before
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_rendering_equals_pixel_by_pixel(spark, plain):
    rng = random.Random(plain)
    for k in range(40):
        width, height = rng.randint(1, 9), rng.randint(1, 9)
        common = bytes(rng.randrange(256) for _ in range(12))
        data = b"GIF89a" + np.array([width, height], "<u2").tobytes() + bytes([0x81, 0, 0]) + common
        for _ in range(rng.randint(1, 6)):
            left, top, w, h = (0, 0, width, height) if plain else (rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 9), rng.randint(1, 9))
            local = bytes(rng.randrange(256) for _ in range(12)) if rng.random() < 0.4 else None
            data += control(rng.randint(0, 1 if plain else 3), rng.randint(0, 300), None if plain or rng.random() < 0.5 else rng.randrange(4)) + image([rng.randrange(4) for _ in range(w * h)], 2, left, top, w, h, local=local)
        data += b"\x3b"
        value = G.parse(data)
        want = naive(*value)
        shown = [c for stack in G.canvases(*value, most=rng.choice([1, 50, 10**6])) for c in stack]
        assert len(shown) == len(want) and all((a == b).all() for a, (_, _, b) in zip(shown, G.rendered(*value), strict=True))
        for rgba, pixels in zip(shown, want, strict=True):
            assert {(x, y): tuple(rgba[y, x, :3]) for y in range(height) for x in range(width) if rgba[y, x, 3]} == pixels
            counts = [0] * 64
            for r, g, b in pixels.values():
                counts[int(r) // 64 * 16 + int(g) // 64 * 4 + int(b) // 64] += 1
            assert G.histogram(rgba) == counts
            bright = [0] * 16
            for r, g, b in pixels.values():
                bright[(int(r) * 299 + int(g) * 587 + int(b) * 114) // 16000] += 1
            assert G.tones(rgba).tolist() == bright
    if plain:
        df = spark.createDataFrame([(5, bytearray(data))], "frame long, media binary")
        got = G.frame_table(df, "frame", "media").orderBy("frame").collect()
        assert [(r.key_frame, bytes(r.rgba)) for r in got] == [(5, c.tobytes()) for c in shown]
        assert [r.start_ms for r in got] == [sum(10 * f.delay for f in value[2][:k]) for k in range(len(got))]


def test_a_huge_canvas_and_a_long_stream_are_bounded():
    bomb = b"GIF89a" + np.array([65535, 65535], "<u2").tobytes() + bytes([0x81, 0, 0]) + bytes(12) + image([1] * 4, 2, 0, 0, 2, 2) + b"\x3b"
    with pytest.raises(ValueError):
        list(G.rendered(*G.parse(bomb)))
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3_000_000, np.uint8).tobytes()  # hundreds of clear codes
    began = time.process_time()
    assert G.lzw_expand(G.pack_codes([G.lzw_codes(data)]), 8)[0].tobytes() == data
    assert time.process_time() - began < 30


def test_features_come_from_rendered_frames(spark):
    text = "".join(chr(32 + k % 90) for k in range(1500))
    got = G.stored(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    payload = G.padded(text)
    tone = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16).tolist()
    colours = {(v >> 6) * 21: 0 for v in payload}
    for v in payload:
        colours[(v >> 6) * 21] += 1
    assert got.feature == f"frames=3;ms=120;colours={','.join(f'{k}:{n}' for k, n in sorted(colours.items()))};tones={','.join(map(str, tone))}"


def test_broken_values(spark):
    good = G.write([b"x" * 576])[0]
    for bad in (b"", b"PNG", good[:500], good[:-20]):
        with pytest.raises(ValueError):
            G.parse(bad)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "frame_id long, media binary")
    got = G.frame_table(df, "frame_id", "media").collect()
    assert [(r.frame_id, r.frame, r.width, sum(r.histogram)) for r in got] == [(1, 0, 24, 576)]


def test_stored(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        want[r.doc_id] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    got = G.stored(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1 and G.stored(empty).count() == 0


@pytest.fixture(scope="module")
def model(spark, sf):
    return H.trained_on(spark.read.parquet(f"{sf}/pages.parquet"), most=40)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work well.</p><a href="#">OK</a></div>
<article><h1>A   title &amp; more</h1><p>The first paragraph says something of interest, in full sentences. It goes on.<p>The second one has <b>bold</b> words and
a line break in it. It ends here.</p><script>var x = "<p>no</p>";</script><blockquote>Someone said this about it once.</blockquote></article>
<section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I don't agree with this at all, sorry.</p></div></section>
<form class="search"><label>Search</label><input name="q"></form><footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""


def test_main_text(model):
    assert H.extract([PAGE, None, ""], model) == [
        "A title & more\nThe first paragraph says something of interest, in full sentences. It goes on.\nThe second one has bold words and a line break in it. It ends here.\nSomeone said this about it once.",
        "",
        "",
    ]


def test_registered_pages_give_their_articles(spark, sf, model):
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|article)[^>]*>", "\x01", inner).replace("<br>", " ")).split("\x01")
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert H.extract([r.html], model)[0] == want


def test_no_choice_below_a_dropped_node():
    parent = np.array([-1, 0, 1, 1, 0])
    keep = H.decode(np.array([1.0, -2.0, 3.0, -1.0, -1.0]), parent, np.array([0, 1, 50, 5, 5]))
    assert keep.tolist() == [True, True, True, False, False]
    keep = H.decode(np.array([1.0, -4.0, 1.0, -1.0, 2.0]), parent, np.array([0, 100, 5, 5, 5]))
    assert keep.tolist() == [True, False, False, False, True]


def test_what_a_reader_sees_stays(model):
    """Hidden from reading aids isn't hidden; noscript, xmp and drawings hold words that are seen."""
    filler = "A long sentence of the article that says a number of things about rivers and their banks. " * 3
    page = f'<html><body><nav><a href="/a">Home</a></nav><article><h1>Rivers</h1><p>{filler}</p><p>It was <span aria-hidden="true">seen</span> by all who came to look at the river that day. {filler}</p><noscript><p>{filler} Without scripts.</p></noscript><xmp>Plain <b>as written</b> &amp; long. {filler}</xmp><p>{filler}<svg viewBox="0 0 1 1"><title>no</title><path d="M0"/><text>drawn words</text></svg> {filler}</p></article><footer>Copyright</footer></body></html>'
    text = H.extract([page], model)[0]
    for words in ("It was seen by all", "Without scripts.", "Plain <b>as written</b> &amp; long.", "drawn words"):
        assert words in text, words
    assert "Home" not in text and "Copyright" not in text and "no drawn" not in text


def test_broken_markup(model):
    for page in ("<p>unclosed", "</div></p>text", "<a href='x", "<script>never closed", "<table><tr><td>a<td>b", "<" * 2000, '<p class="' * 500, "<div>" * 3000 + "deep"):
        assert isinstance(H.extract([page], model)[0], str)


def test_pages_table(spark, model):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = H.main_text(df, model, ["page_id", "url"]).collect()
    assert len(got) == 3 and {r.n_chars for r in got if r.page_id == 2} == {0} and len({r.text for r in got if r.page_id == 1}) == 1
    assert H.main_text(df.limit(0), model, ["page_id", "url"]).count() == 0 and H.trained_on(df.limit(0)).leaf.shape[0] > 0


@pytest.mark.parametrize("page", ['<p class="' * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><td>" + "<h1>" * 150_000, "<a \">' " * 150_000, "<li><b>" * 100_000, "<!--" * 400_000, "<script>" * 200_000])
def test_long_broken_pages_take_seconds(page):
    began = time.process_time()
    H.tree(page)
    assert time.process_time() - began < 15


def test_markup_in_one_pass():
    page = """a<p class="x>y">b</p><!-- <i> --><img src='>'>c<d "e>f<!x>g< h <?z>i</q"""
    got = [(page[a:b], name, closes, rest) for a, b, name, closes, rest in H.markup(page)]
    assert got == [('<p class="x>y">', "p", False, ' class="x>y"'), ("</p>", "p", True, ""), ("<!-- <i> -->", None, False, ""), ("<img src='>'>", "img", False, " src='>'"), ('<d "e>', "d", False, ' "e'), ("<!x>", None, False, ""), ("<?z>", None, False, "")]


def test_registered_frames_equal_the_texts(spark, sf):
    from tidejoin.llm.queries import gif_frames

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        payload = G.padded(r.text)
        for k in range(len(payload) // 576):
            counts = [0] * 64
            for v in payload[576 * k : 576 * (k + 1)]:
                counts[v // 64 * 21] += 1
            want[r.doc_id, k] = (40 * k, 40, 24, 24, ",".join(map(str, counts)))
    got = gif_frames(spark, sf).collect()
    assert {(r.doc_id, r.frame): tuple(r)[2:] for r in got} == want and len(got) == len(want)
