"""Media columns (9): GIF animations: LZW code streams, palettes, disposal, transparency, timed frames.

``parse`` reads a GIF into frames of palette indices, ``rendered`` composes them on
the canvas, ``frame_table`` stores timed frames with colour-histogram columns.
``write`` stores bytes losslessly as the palette indices of 24 x 24 frames.

LZW strings are never built: the string of table entry k is what code k gave and
the byte after it, so each code copies from an earlier place of the output.  Lengths
and sources of all codes of all frames are resolved together with numpy.

Nulls count as empty values; an empty payload is one frame of padding; a value that
is no GIF, or is cut off, raises ValueError in ``parse`` and gives no frames in
``frame_table``, as does one whose canvas has more than ``MOST_PIXELS``; equal values give equal results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import slices

SIDE = 24
UNIT = SIDE * SIDE
DELAY = 4  # hundredths of a second
MOST_CODES = 4096
#: Bytes of code streams that are read together.
TOGETHER = 1 << 20
#: Pixels of the largest canvas that is rendered; a larger one, which a few bytes can ask for, counts as no GIF.
MOST_PIXELS = 1 << 26
GRAY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


@dataclass
class Frame:
    """Palette indices of a rectangle of the canvas."""

    pixels: np.ndarray
    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray


# --- LZW -------------------------------------------------------------------------------------------------------------


def widths(n: int, least: int) -> np.ndarray:
    """Bits of each of n codes that follow a clear code; ``least`` is the minimum code size."""
    free = (1 << least) + 1 + np.maximum(np.arange(n), 1)
    return np.minimum(12, np.floor(np.log2(free)).astype(np.int64) + 1)


def lzw_codes(pixels: bytes) -> list[int]:
    """Codes of 8-bit pixels; a clear code first, another whenever the table is full, the end code last."""
    out, table, free = [256], {}, 258
    get = table.get
    now = pixels[0]
    for c in pixels[1:]:
        key = now << 8 | c
        known = get(key)
        if known is not None:
            now = known
            continue
        out.append(now)
        if free < MOST_CODES:
            table[key] = free
            free += 1
        else:
            out.append(256)
            table.clear()
            free = 258
        now = c
    out += (now, 257)
    return out


def pack_codes(frames: list[list[int]]) -> list[bytes]:
    """The codes of each frame as bits, lowest first, filled up to whole bytes."""
    size = np.fromiter(map(len, frames), np.int64, len(frames))
    codes = np.fromiter((c for f in frames for c in f), np.int32, int(size.sum()))
    first = np.cumsum(size) - size
    # places since the last clear code, which is itself read at the width reached so far
    clear = np.flatnonzero(codes == 256)
    run = np.searchsorted(clear, np.arange(len(codes)), "left") - 1
    since = np.arange(len(codes)) - clear[np.maximum(run, 0)] - 1
    since[first] = 0
    width = widths(MOST_CODES, 8)[np.minimum(since, MOST_CODES - 1)]
    bits = np.add.reduceat(width, first)
    fill = -bits % 8
    ends = first + size
    codes, width = np.insert(codes, ends, 0), np.insert(width, ends, fill)
    out = np.empty(int(width.sum()) // 8, np.uint8)
    at = 0
    for a in range(0, len(frames), 512):
        b = min(a + 512, len(frames))
        part = slice(first[a] + a, ends[b - 1] + b)
        grid = (codes[part, None] >> np.arange(12)) & 1
        own = np.packbits(grid[np.arange(12) < width[part, None]].astype(np.uint8), bitorder="little")
        out[at : at + len(own)] = own
        at += len(own)
    stop = np.cumsum((bits + fill) // 8)
    data = out.tobytes()
    return [data[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


@lru_cache(maxsize=16)
def _offsets(least: int) -> np.ndarray:
    """The bit at which each of the first codes after a clear code begins."""
    return np.concatenate([[0], np.cumsum(widths(MOST_CODES, least))])


def _codes(grid: np.ndarray, at: int, first: int, n: int, least: int) -> np.ndarray:
    """Codes ``first`` to ``first + n`` after a clear code whose last bit precedes bit ``at``, of each row of bytes; fewer
    if the rows end.  Each code is taken from the three bytes that it touches."""
    k = np.arange(first, first + n)
    known = _offsets(least)
    bit = at + np.where(k <= MOST_CODES, known[np.minimum(k, MOST_CODES)], known[-1] + 12 * (k - MOST_CODES))
    width = widths(MOST_CODES, least)[np.minimum(k, MOST_CODES - 1)]
    fits = bit + width <= 8 * (grid.shape[1] - 3)  # three bytes of padding
    bit, width = bit[fits], width[fits]
    byte = bit >> 3
    three = grid[:, byte].astype(np.int32) | grid[:, byte + 1].astype(np.int32) << 8 | grid[:, byte + 2].astype(np.int32) << 16
    return (three >> (bit & 7).astype(np.int32)) & ((1 << width) - 1).astype(np.int32)


def _grid(streams: list[bytes]) -> np.ndarray:
    longest = max(map(len, streams)) + 3
    return np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in streams), np.uint8).reshape(len(streams), longest)


def read_codes(streams: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all streams without clear and end codes, the first place of each code's run, the number of codes of each
    stream.  Streams of like length are read together, ``TOGETHER`` bytes at most."""
    clear, end = 1 << least, (1 << least) + 1
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    order = sorted(range(len(streams)), key=lambda i: len(streams[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(streams[order[to]]) <= TOGETHER:
            to += 1
        own, at = order[at:to], to
        if len(own) == 1:
            parts[own[0]] = _slow_runs(streams[own[0]], least)
            continue
        grid = _grid([streams[i] for i in own])
        head = (grid[:, 0].astype(np.int32) | grid[:, 1].astype(np.int32) << 8) & ((1 << (least + 1)) - 1)
        codes = _codes(grid, least + 1, 0, 8 * grid.shape[1] // (least + 1), least)
        stop = (codes == clear) | (codes == end)
        n = np.where(stop.any(axis=1), stop.argmax(axis=1), -1)
        for row, i in enumerate(own):
            if head[row] == clear and n[row] >= 0 and codes[row, n[row]] == end:
                parts[i].append(codes[row, : n[row]])
            else:
                parts[i] = _slow_runs(streams[i], least)
    runs = [r for own in parts for r in own]
    size = np.array([len(r) for r in runs], np.int64)
    first = np.repeat(np.cumsum(size) - size, size)
    return np.concatenate(runs) if runs else np.zeros(0, np.int32), first, np.array([sum(map(len, own)) for own in parts], np.int64)


def _slow_runs(stream: bytes, least: int) -> list[np.ndarray]:
    """Runs of one stream with any number of clear codes, read a table's length at a time; a stream may lack the first
    clear code or the end code."""
    grid, clear, known = _grid([stream]), 1 << least, _offsets(least)
    out, at, run, k = [], 0, [], 0
    while True:
        codes = _codes(grid, at, k, MOST_CODES, least)[0]
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stop[0]) if len(stop) else len(codes)
        run.append(codes[:n])
        k += n
        if len(stop) or len(codes) < MOST_CODES:
            if k:
                out.append(np.concatenate(run))
            if not len(stop) or codes[n] == clear + 1:
                return out
            # the clear code itself was read at the width of its place
            at += int(known[k + 1]) if k < MOST_CODES else int(known[-1]) + 12 * (k + 1 - MOST_CODES)
            run, k = [], 0


def lzw_expand(streams: list[bytes], least: int) -> list[np.ndarray]:
    """The pixels of each stream."""
    codes, first, per = read_codes(streams, least)
    n, base = len(codes), (1 << least) + 2
    here = np.arange(n)
    copied = codes >= base
    source = np.where(copied, first + codes - base, here)
    if (source[copied] >= here[copied]).any() or (~copied & (codes >= 1 << least)).any():
        raise ValueError("LZW code out of range")
    # length: 1 + length of the source code; chains are followed by doubling
    length, up = copied.astype(np.int32), source
    while (moved := up[up] != up).any():
        length = np.where(moved | copied, length + np.where(up != here, length[up], 0), length)
        up = up[up]
    length += 1
    begin = np.cumsum(length, dtype=np.int64) - length
    total = int(length.sum())
    owner = np.repeat(here, length)
    place = np.arange(total)
    link = np.where(copied[owner], begin[source][owner] + place - begin[owner], place)
    while True:
        after = link[link]
        if (after == link).all():
            break
        link = after
    pixels = codes[owner[link]].astype(np.uint8)
    edge = np.concatenate([[0], np.cumsum(per)])
    stops = np.append(begin, total)[edge]
    return [pixels[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


# --- the format ------------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def write(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as a GIF of 24 x 24 frames with a grey palette."""
    frames = [p[k : k + UNIT] for p in payloads for k in range(0, len(p), UNIT)]
    coded = iter(pack_codes([lzw_codes(f) for f in frames]))
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GRAY.tobytes()
    image = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    return [head + b"".join(image + _blocks(next(coded)) for _ in range(len(p) // UNIT)) + b"\x3b" for p in payloads]


def _structure(data: bytes) -> tuple[int, int, list[tuple[dict, bytes]]]:
    """Canvas size and, of each frame, what its headers say and its code stream."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at, common = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            common, at = data[at : at + 3 * n], at + 3 * n
        out, control = [], (0, 0, None)
        while (kind := data[at]) != 0x3B:
            at += 1
            if kind == 0x21:
                label, at = data[at], at + 1
                if label == 0xF9 and data[at] >= 4:
                    packed, delay, transparent = struct.unpack_from("<BHB", data, at + 1)
                    control = (packed >> 2 & 7, delay, transparent if packed & 1 else None)
                while data[at]:
                    at += data[at] + 1
                at += 1
                continue
            if kind != 0x2C:
                raise ValueError(f"unknown block {kind}")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at, palette = at + 9, common
            if packed & 0x80:
                n = 2 << (packed & 7)
                palette, at = data[at : at + 3 * n], at + 3 * n
            least, at = data[at], at + 1
            chunks = []
            while size := data[at]:
                chunks.append(data[at + 1 : at + 1 + size])
                at += size + 1
            at += 1
            out.append(({"left": left, "top": top, "w": w, "h": h, "rows": bool(packed & 0x40), "palette": palette, "least": least, "control": control}, b"".join(chunks)))
            control = (0, 0, None)
        return width, height, out
    except (IndexError, struct.error):
        raise ValueError("the GIF is cut off") from None


def _in_order(pixels: np.ndarray) -> np.ndarray:
    """Rows of an interlaced image in order."""
    h = len(pixels)
    rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
    out = np.empty_like(pixels)
    out[rows] = pixels
    return out


def parse_all(values: list[bytes]) -> list[tuple[int, int, list[Frame]]]:
    """Width, height and frames of each GIF; the code streams of all of them are expanded together."""
    shapes = [_structure(v) for v in values]
    every = [x for s in shapes for x in s[2]]
    pixels: list[np.ndarray | None] = [None] * len(every)
    for least in {h["least"] for h, _ in every}:
        if not 1 <= least <= 8:
            raise ValueError("LZW code size out of range")
        own = [i for i, (h, _) in enumerate(every) if h["least"] == least]
        for i, p in zip(own, lzw_expand([every[i][1] for i in own], least), strict=True):
            pixels[i] = p
    out, k, last = [], 0, None
    for width, height, frames in shapes:
        own = []
        for h, _ in frames:
            n = h["w"] * h["h"]
            if len(pixels[k]) < n:
                raise ValueError("a frame lacks pixels")
            grid = pixels[k][:n].reshape(h["h"], h["w"])
            disposal, delay, transparent = h["control"]
            if last is None or h["palette"] != last[0]:
                last = (h["palette"], np.frombuffer(h["palette"], np.uint8).reshape(-1, 3) if h["palette"] else GRAY)
            palette = last[1]
            own.append(Frame(_in_order(grid) if h["rows"] else grid, h["left"], h["top"], delay, disposal, transparent, palette))
            k += 1
        out.append((width, height, own))
    return out


def parse(value: bytes) -> tuple[int, int, list[Frame]]:
    return parse_all([value])[0]


def colors(f: Frame) -> np.ndarray:
    """Red, green, blue and opacity of each palette index; indices beyond the palette are black, the transparent one is clear."""
    out = np.zeros((256, 4), np.uint8)
    out[: len(f.palette), :3], out[:, 3] = f.palette, 255
    if f.transparent is not None:
        out[f.transparent] = 0
    return out


def rendered(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Start and length in milliseconds and the RGBA canvas of each frame, disposal and transparency applied."""
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas, start = np.zeros((height, width, 4), np.uint8), 0
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = (min(f.pixels.shape[0], max(0, height - f.top)), min(f.pixels.shape[1], max(0, width - f.left)))
        color = colors(f)[f.pixels[:h, :w]]
        part = canvas[f.top : f.top + h, f.left : f.left + w]
        np.copyto(part, color, where=color[..., 3:] > 0)
        yield start, 10 * f.delay, canvas.copy()
        start += 10 * f.delay
        if f.disposal == 2:
            canvas[f.top : f.top + h, f.left : f.left + w] = 0
        elif before is not None:
            canvas = before


def canvases(width: int, height: int, frames: list[Frame], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The canvases of ``rendered`` in stacks.  Neighbours that cover the canvas without a transparent colour, and with the
    same palette, don't depend on what was before: their colours are looked up at once, in stacks of ``most`` pixels."""
    whole = [f.transparent is None and f.left == f.top == 0 and f.pixels.shape == (height, width) and f.disposal < 2 for f in frames]
    if not all(whole):
        yield from (rgba[None] for _, _, rgba in rendered(width, height, frames))
        return
    at = 0
    while at < len(frames):
        to = at + 1
        while to < len(frames) and frames[to].palette is frames[at].palette and (to - at) * width * height < most:
            to += 1
        yield colors(frames[at])[np.stack([f.pixels for f in frames[at:to]])]
        at = to


def bins(rgba: np.ndarray) -> np.ndarray:
    """The two highest bits of red, green and blue of each pixel, as a number below 64."""
    high = rgba >> 6
    return high[..., 0] << 4 | high[..., 1] << 2 | high[..., 2]


def histogram(rgba: np.ndarray) -> list[int]:
    """Visible pixels by the two highest bits of red, green and blue: 64 counts."""
    return np.bincount(bins(rgba)[rgba[..., 3] > 0].ravel(), minlength=64).tolist()


def tones(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels in 16 steps of brightness."""
    bright = rgba[..., :3].astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 16000
    return np.bincount(bright[rgba[..., 3] > 0].ravel(), minlength=16)


FRAMES = "frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<int>"


def frame_table(media: DataFrame, key: str, value: str, canvas: bool = True) -> DataFrame:
    """A row per timed frame of the GIFs in a binary column, with the rendered canvas, if wanted, and its colour histogram;
    a key with the name of one of these columns is called ``key_<name>``."""
    kind, fields = media.select(key).schema[0].dataType.simpleString(), [x for x in FRAMES.split(", ") if canvas or not x.startswith("rgba")]
    names = [x.split()[0] for x in FRAMES.split(", ")]
    out = f"key_{key}" if key in names else key
    names = [x.split()[0] for x in fields]

    def read(values: list[bytes]) -> list[tuple[int, int, list[Frame]] | None]:
        try:
            return parse_all(values)
        except ValueError:  # those that are no GIFs have no rows
            return [None] if len(values) == 1 else [x for v in values for x in read([v])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, value, 1 << 20):
                for k, found in zip(part.column(0), read([v.as_py() or b"" for v in part.column(1)]), strict=True):
                    if found is None or found[0] * found[1] > MOST_PIXELS:
                        continue
                    width, height, frames = found
                    delays, at = np.array([10 * f.delay for f in frames], np.int64), 0
                    starts = delays.cumsum() - delays
                    for stack in canvases(width, height, frames):
                        n = len(stack)
                        place = bins(stack).reshape(n, -1) + 64 * np.arange(n)[:, None]
                        counts = np.bincount(place[stack[..., 3].reshape(n, -1) > 0], minlength=64 * n).astype(np.int32)
                        columns = [pa.array([k.as_py()] * n, k.type), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(starts[at : at + n]), pa.array(delays[at : at + n]), pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, height, np.int32))]
                        columns += [pa.array([c.tobytes() for c in stack], pa.binary())] if canvas else []
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(counts))
                        yield pa.RecordBatch.from_arrays([*columns, lists], [out, *names])
                        at += n

    return media.select(key, value).mapInArrow(lean(run), f"`{out}` {kind}, {', '.join(fields)}")


def padded(text: str | None) -> bytes:
    """The payload of a text: its bytes, and bytes 255 up to a positive multiple of a frame."""
    own = (text or "").encode()
    return own + b"\xff" * (UNIT - len(own) % UNIT if len(own) % UNIT or not own else 0)


def animations(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: each text of ``doc_id, text`` as a GIF."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(write([padded(t.as_py()) for t in part.column("text")]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, media binary")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a digest of each text of ``doc_id, text``, stored as a GIF and read back from it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                payloads = [padded(t.as_py()) for t in part.column("text")]
                sizes = [len((t.as_py() or "").encode()) for t in part.column("text")]
                media = write(payloads)
                rows = []
                for size, own, (width, height, frames) in zip(sizes, media, parse_all(media), strict=True):
                    back = b"".join(f.pixels.tobytes() for f in frames)
                    stacks = [(np.bincount(bins(c).ravel(), minlength=64), tones(c)) for c in canvases(width, height, frames)]
                    seen, tone = (sum(s[k] for s in stacks) for k in (0, 1))
                    colours = ",".join(f"{k}:{seen[k]}" for k in np.flatnonzero(seen).tolist())
                    feature = f"frames={len(frames)};ms={sum(10 * f.delay for f in frames)};colours={colours};tones={','.join(map(str, tone.tolist()))}"
                    rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(own), hashlib.sha256(own).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", *[x.split()[0] for x in DIGEST.split(", ")]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id long, {DIGEST}")
