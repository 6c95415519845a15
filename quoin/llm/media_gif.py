"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

``decode_gif`` reads any GIF87a/89a byte string into composited frames;
``gif_frames`` turns a binary column into one row per frame with start time,
duration and a colour histogram; ``encode_gray_gif`` stores 8-bit samples
losslessly in frames that are drawn over each other. Null or empty bytes give no
frame; bytes that break off give the frames that are whole. Screens and frames
of over ``MOST_PIXELS`` pixels are refused (no further frame): a header of a few
bytes may claim some four thousand million.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quoin.llm._base import arrow_map, struct, text_bytes

#: Samples in a row of a stored payload, and rows in one of its frames.
ROW_SAMPLES, FRAME_ROWS = 64, 64
#: Most pixels that a screen or a frame may claim; memory is three bytes for each, a few times over.
MOST_PIXELS = 1 << 24
#: Duration of a payload frame in hundredths of a second.
FRAME_DELAY_CS = 4
#: Colour histogram bins for each of red, green and blue.
HIST_LEVELS = 4
TABLE_LIMIT = 4096
#: Parts that ``lzw_encode_all`` takes together, places of its table (4 bytes each; 60 parts of all sample values
#: fit), and the samples that a part alone takes in the time of one step of all.
MOST_ALIKE, TABLE_PLACES, STEP_SAMPLES = 256, 1 << 26, 32
GRAY_PALETTE = bytes(v for level in range(256) for v in (level, level, level))


@lru_cache(16)
def _code_widths(min_code_size: int, count: int) -> np.ndarray:
    """Bits of the j-th code after a clear code, as a reader's table has grown by then."""
    entries = (1 << min_code_size) + 2 + np.maximum(np.arange(count) - 1, 0)
    width = np.full(count, min_code_size + 1)
    for w in range(min_code_size + 1, 12):
        width[entries >= 1 << w] = w + 1
    return width


def _packed(codes: np.ndarray, widths: np.ndarray, starts: np.ndarray | None = None) -> bytes:
    """Codes of the given widths as a little-endian bit stream, one after another unless ``starts`` has their first bits."""
    if starts is None:
        starts = np.cumsum(widths) - widths
    out = np.zeros(int(starts[-1] + widths[-1] + 7) // 8 + 2, dtype=np.int64)
    at, shifted = starts >> 3, codes << (starts & 7)
    for i in range(3):
        # Codes of eight bits and more never begin in the same byte.
        if widths.min() >= 8:
            out[at + i] |= shifted >> 8 * i & 255
        else:
            np.bitwise_or.at(out, at + i, shifted >> 8 * i & 255)
    return out[:-2].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, min_code_size: int = 8) -> bytes:
    """The LZW code stream of samples below ``2 ** min_code_size``, by longest matches; the table is cleared when it is full."""
    clear = 1 << min_code_size
    room = TABLE_LIMIT - clear - 2
    segments: list[list[int]] = [[clear]]
    codes: list[int] = []
    known: dict[int, int] = {}  # keys and codes stand eight bits higher, so that a sample fits below
    first, fresh = (clear + 2) << 8, (clear + 2) << 8
    rest = iter(samples)
    prefix = next(rest, -1) << 8
    for sample in rest:
        key = prefix | sample
        if key in known:
            prefix = known[key]
        else:
            codes.append(prefix)
            known[key] = fresh
            fresh += 256
            prefix = sample << 8
            if len(codes) >= room:
                codes.append(clear << 8)
                segments.append([c >> 8 for c in codes])
                codes, fresh = [], first
                known.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append((clear + 1) << 8)
    segments.append([c >> 8 for c in codes])
    steps = _code_widths(min_code_size, TABLE_LIMIT + 2)
    return _packed(np.array([c for s in segments for c in s], dtype=np.int64), np.concatenate([steps[: len(s)] for s in segments]))


def _lzw_alike(parts: list[bytes], table: np.ndarray) -> list[bytes | None]:
    """``lzw_encode`` of as many 8-bit parts as the table holds, one sample of each at a step.

    The parts are in order of falling length, and none is empty. A phrase is named by the first of its
    places in the part's share of the table, one place for each sample value of a part; a place holds the
    phrase that this value makes of it, or 0. Literals come first. The table is all 0 before and after.
    A part that fills its code table is left out (None).
    """
    lengths = np.array([len(p) for p in parts])
    steps = int(lengths[0])
    of = np.repeat(np.arange(len(parts)), lengths)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    used = np.zeros((len(parts), 256), bool)
    used[of, flat] = True
    most = int(used.sum(axis=1).max())
    count = min(len(parts), len(table) // ((most + steps) * most))
    lengths, used = lengths[:count], used[:count]
    of, flat = of[: lengths.sum()], flat[: lengths.sum()]
    values, ranks = np.argsort(~used, axis=1, kind="stable"), np.cumsum(used, axis=1) - 1
    rank = np.zeros((count, steps), np.int32)
    within = np.arange(steps) < lengths[:, None]
    rank[within] = ranks[of, flat]
    rank = np.ascontiguousarray(rank.T)
    literal, place = rank * np.int32(most), rank + np.arange(count) * ((most + steps) * most)
    going = (count - np.searchsorted(lengths[::-1], np.arange(steps), side="right")).tolist()
    phrase, fresh = np.empty((steps, count), np.int32), np.full(count, most * most, np.int32)
    phrase[0] = literal[0]
    for i in range(1, steps):
        n = going[i]
        now, at = phrase[i, :n], phrase[i - 1, :n] + place[i, :n]
        table.take(at, out=now, mode="clip")
        new = (now == 0).nonzero()[0]
        made = fresh[new]
        table[at[new]] = made
        fresh[new] = made + most
        now[new] = literal[i].take(new)
    place, phrase = place.T, np.ascontiguousarray(phrase.T)
    begins = within.copy()
    begins[:, 1:] &= phrase[:, 1:] < most * most
    ends = np.zeros_like(within)
    ends[:, :-1] = begins[:, 1:]
    table[phrase[ends] + place[:, 1:][begins[:, 1:]]] = 0
    ends[np.arange(count), lengths - 1] = True
    counts = ends.sum(axis=1)
    codes = phrase[ends] // most
    codes = np.where(codes < most, values[np.repeat(np.arange(count), counts), np.minimum(codes, 255)], codes - most + 258)
    return [None if n >= TABLE_LIMIT - 258 else s for n, s in zip(counts.tolist(), _streams(codes, counts), strict=True)]


def _streams(codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Code streams of 9 bits and more, ``counts`` codes in each, that are cleared at the start only."""
    sizes = counts + 2
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    every = np.full(int(sizes.sum()), -1)
    every[first], every[last] = 256, 257
    every[every < 0] = codes
    widths = np.concatenate([[9], _code_widths(8, TABLE_LIMIT + 2)])[np.minimum(np.arange(len(every)) - np.repeat(first, sizes), TABLE_LIMIT + 2)]
    bits = np.cumsum(widths)
    before = bits[first] - 9
    size = bits[last] - before + 7 >> 3
    stop = np.cumsum(size)
    packed = _packed(every, widths, bits - widths + np.repeat((stop - size) * 8 - before, sizes))
    return [packed[a:b] for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]


def phrase_table() -> np.ndarray:
    """Room for ``lzw_encode_all``, to be used again; only what is touched takes memory."""
    return np.zeros(TABLE_PLACES, np.int32)


def lzw_encode_all(parts: list[bytes], table: np.ndarray | None = None) -> list[bytes]:
    """``lzw_encode`` of many parts of 8-bit samples: those of up to a frame's samples go on together, others alone."""
    if table is None:
        table = phrase_table()
    order = sorted((i for i, p in enumerate(parts) if 0 < len(p) <= ROW_SAMPLES * FRAME_ROWS), key=lambda i: -len(parts[i]))
    # A step costs as much as STEP_SAMPLES samples by themselves: the longest few may be cheaper so.
    head = order[:STEP_SAMPLES]
    if len(order) < STEP_SAMPLES or sum(len(parts[i]) for i in head) < STEP_SAMPLES * (len(parts[head[0]]) - len(parts[head[-1]])):
        order = order[STEP_SAMPLES:]
    out: list[bytes | None] = [None] * len(parts)
    while len(order) >= STEP_SAMPLES:
        streams = _lzw_alike([parts[i] for i in order[:MOST_ALIKE]], table)
        for i, stream in zip(order, streams, strict=False):
            out[i] = stream
        order = order[len(streams) :]
    return [lzw_encode(p) if s is None else s for p, s in zip(parts, out, strict=True)]


@lru_cache(16)
def _code_spans(min_code_size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits before each code after a clear code, as far as twice the table's limit, and each one's largest value."""
    widths = _code_widths(min_code_size, 2 * TABLE_LIMIT)
    return np.concatenate([[0], np.cumsum(widths)]), (1 << widths) - 1


def _segment(words: np.ndarray, at: int, bits: int, min_code_size: int) -> tuple[np.ndarray, int, bool]:
    """Codes from bit ``at`` to the next clear or end code; the bit after it; whether the stream goes on.

    ``words`` has the 24 bits from each byte on.
    """
    clear, parts, first, window = 1 << min_code_size, [], 0, 1056
    spans, highest = _code_spans(min_code_size)
    while True:
        known = min(first, TABLE_LIMIT)  # past the table's limit all codes have 12 bits
        window = min(window, 2 * TABLE_LIMIT - known, (bits - at) // (min_code_size + 1) + 1)
        ends, most = spans[known : known + window + 1] + (at - spans[known]), highest[known : known + window]
        if whole := ends[-1] > bits:
            ends = ends[: int(np.searchsorted(ends, bits, side="right"))]
            most = most[: len(ends) - 1]
        begin = ends[:-1]
        codes = words[begin >> 3] >> (begin & 7) & most
        stops = (codes >> 1 == clear >> 1).nonzero()[0]
        if len(stops):
            stop = int(stops[0])
            return np.concatenate([*parts, codes[:stop]]), int(ends[stop + 1]), codes[stop] == clear
        parts.append(codes)
        if whole:
            return np.concatenate(parts), bits, False
        at, first, window = int(ends[-1]), first + window, window * 4


def _phrases(codes: np.ndarray, clear: int, limit: int) -> tuple[np.ndarray, bool]:
    """The samples of the codes between two clear codes, at most some ``limit``, and whether all codes are sound.

    The table's entry j is the phrase of code j and the first sample after it, so a code that
    names entry j repeats the output from where phrase j began. Lengths, and then the places
    that samples come from, follow by pointer doubling.
    """
    entry, place = codes - (clear + 2), np.arange(len(codes))
    wrong = ((entry >= place) | (entry >= TABLE_LIMIT - clear - 2)).nonzero()[0]
    sound = not len(wrong)
    if not sound:
        codes, entry, place = codes[: wrong[0]], entry[: wrong[0]], place[: wrong[0]]
    literal = entry < 0
    back, length = np.where(literal, place, entry), (~literal).astype(np.int64)
    while not literal[back].all():
        length, back = length + length[back], back[back]
    sizes = length + 1
    ends = np.cumsum(sizes)
    if len(ends) and ends[-1] > limit:
        fit = int(np.searchsorted(ends, limit)) + 1
        codes, entry, literal, sizes, ends = codes[:fit], entry[:fit], literal[:fit], sizes[:fit], ends[:fit]
    starts = ends - sizes
    source = np.repeat(np.where(literal, 0, starts[np.maximum(entry, 0)] - starts), sizes)
    source += np.arange(len(source))
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return np.repeat(codes.astype(np.uint8), sizes)[source], sound


def lzw_decode(stream: bytes, min_code_size: int, limit: int) -> bytes:
    """The first ``limit`` samples of an LZW code stream; a broken stream gives what precedes the fault."""
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    parts, size, at, goes_on = [], 0, 0, True
    while goes_on and size < limit:
        codes, at, goes_on = _segment(words, at, len(stream) * 8, min_code_size)
        if len(codes):
            got, sound = _phrases(codes, 1 << min_code_size, limit - size)
            parts.append(got.tobytes())
            size, goes_on = size + len(got), goes_on and sound
    return b"".join(parts)[:limit]


@dataclass
class Frame:
    """One image of a GIF: its own indices, the canvas after it was drawn, and its time."""

    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    canvas: np.ndarray
    opaque: np.ndarray


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _deinterlaced(samples: np.ndarray) -> np.ndarray:
    height = samples.shape[0]
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
    out = np.empty_like(samples)
    out[order] = samples
    return out


def decode_gif(data: bytes | None) -> Iterator[Frame]:
    """Frames in order. Disposal 2 clears a frame's area, 3 restores what was below it."""
    if not data or data[:3] != b"GIF" or len(data) < 13:
        return
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    if wide * high > MOST_PIXELS:
        return
    at, shared = 13, None
    if flags & 128:
        size = 2 << (flags & 7)
        shared = np.frombuffer(data[at : at + 3 * size].ljust(3 * size, b"\0"), dtype=np.uint8).reshape(-1, 3)
        at += 3 * size
    canvas, opaque = np.zeros((high, wide, 3), np.uint8), np.zeros((high, wide), bool)
    delay, disposal, transparent, clock, index = 0, 0, None, 0, 0
    while at < len(data):
        mark = data[at]
        if mark == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif mark == 0x2C and at + 10 < len(data):
            left, top, width, height = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            flags, at, palette = data[at + 9], at + 10, shared
            if flags & 128:
                size = 2 << (flags & 7)
                palette = np.frombuffer(data[at : at + 3 * size].ljust(3 * size, b"\0"), dtype=np.uint8).reshape(-1, 3)
                at += 3 * size
            if at >= len(data):
                return
            code_size, (stream, at) = data[at], _sub_blocks(data, at + 1)
            if not 1 <= code_size <= 8 or width * height > MOST_PIXELS:
                return
            got = lzw_decode(stream, code_size, width * height)
            if len(got) < width * height or palette is None:
                return
            samples = np.frombuffer(got, dtype=np.uint8).reshape(height, width)
            if flags & 64:
                samples = _deinterlaced(samples)
            box = np.s_[top : min(top + height, high), left : min(left + width, wide)]
            seen = samples[: max(0, high - top), : max(0, wide - left)]
            below = (canvas[box].copy(), opaque[box].copy()) if disposal == 3 else None
            drawn = np.ones(seen.shape, bool) if transparent is None else seen != transparent
            if transparent is None:
                canvas[box] = palette.take(seen, axis=0, mode="clip")
            else:
                canvas[box][drawn] = palette[np.minimum(seen[drawn], len(palette) - 1)]
            opaque[box] |= drawn
            yield Frame(index, clock, delay, left, top, width, height, disposal, transparent, samples, canvas.copy(), opaque.copy())
            if disposal == 2:
                canvas[box], opaque[box] = 0, False
            elif below is not None:
                canvas[box], opaque[box] = below
            clock, index = clock + delay, index + 1
            delay, disposal, transparent = 0, 0, None
        else:
            return


def colour_histogram(frame: Frame, levels: int = HIST_LEVELS) -> list[int]:
    """Visible pixels in each of ``levels ** 3`` colour boxes, red slowest."""
    red, green, blue = frame.canvas.reshape(-1, 3).T.astype(np.int32) * levels >> 8
    at = (red * levels + green) * levels + blue
    if not frame.opaque.all():
        at = at[frame.opaque.ravel()]
    return np.bincount(at, minlength=levels**3).tolist()


def _spare_level(payload: bytes) -> int | None:
    """The highest sample value that the payload does not use, to stand for transparent; UTF-8 leaves 255 free."""
    free = np.flatnonzero(np.bincount(np.frombuffer(payload, np.uint8), minlength=256) == 0)
    return int(free[-1]) if len(free) else None


def _gray_frames(payload: bytes) -> tuple[bytes, list[tuple[bytes, bytes]]]:
    """The head of a payload's GIF, and each frame's head and samples."""
    rows, spare = len(payload) // ROW_SAMPLES, _spare_level(payload)
    head = b"GIF89a" + ROW_SAMPLES.to_bytes(2, "little") + min(rows, FRAME_ROWS).to_bytes(2, "little") + b"\xf7\0\0" + GRAY_PALETTE
    frames = []
    levels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES)
    canvas = np.full((min(rows, FRAME_ROWS), ROW_SAMPLES), -1, np.int16)  # -1: nothing is drawn there
    for top in range(0, rows, FRAME_ROWS):
        block, later = levels[top : top + FRAME_ROWS], levels[top + FRAME_ROWS : top + 2 * FRAME_ROWS]
        below = canvas.copy()
        there = canvas[: len(block)] == block
        seen = spare is not None and bool(there.any())
        stored = np.where(there, np.uint8(spare), block) if seen else block
        canvas[: len(block)] = block
        left, restored = (np.count_nonzero(c[: len(later)] == later) for c in (canvas, below))
        disposal = 3 if restored > left else 2 if not left and 0 < len(later) < len(block) else 1
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | seen]) + FRAME_DELAY_CS.to_bytes(2, "little") + bytes([spare if seen else 0])
        box = b"\0\x2c\0\0\0\0" + ROW_SAMPLES.to_bytes(2, "little") + len(block).to_bytes(2, "little") + b"\0\x08"
        frames.append((control + box, stored.tobytes()))
        if disposal == 2:
            canvas[: len(block)] = -1
        elif disposal == 3:
            canvas = below
    return head, frames


def encode_gray_gifs(payloads: list[bytes], table: np.ndarray | None = None) -> list[bytes]:
    """GIF89a files whose frames hold the payloads, 64 gray samples a row and ``FRAME_ROWS`` rows a frame at most.

    A sample that already stands on the canvas is stored as transparent. After each frame the
    canvas is restored if that shows more samples of the next frame than leaving it, and cleared
    if neither shows any and the next frame would not cover it. All frames of all payloads are
    coded together, in ``table`` if given (``phrase_table``).
    """
    drawn = [_gray_frames(p) for p in payloads]
    streams = iter(lzw_encode_all([samples for _, frames in drawn for _, samples in frames], table))
    out = []
    for head, frames in drawn:
        parts = [head]
        for control, _ in frames:
            stream = next(streams)
            parts.append(control)
            for i in range(0, len(stream), 255):
                part = stream[i : i + 255]
                parts += [bytes([len(part)]), part]
            parts.append(b"\0")
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def encode_gray_gif(payload: bytes) -> bytes:
    """``encode_gray_gifs`` of one payload."""
    return encode_gray_gifs([payload])[0]


FRAME_SCHEMA = [("frame", T.IntegerType()), ("start_ms", T.LongType()), ("delay_ms", T.LongType()), ("left", T.IntegerType()), ("top", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("disposal", T.IntegerType()), ("transparent", T.IntegerType()), ("n_visible", T.LongType()), ("histogram", T.ArrayType(T.LongType()))]


def gif_frames(df: DataFrame, id_column: str, media_column: str, levels: int = HIST_LEVELS) -> DataFrame:
    """One row per frame of a GIF column: times, box, disposal and colour histogram of what is visible."""
    schema = struct((id_column, df.schema[id_column].dataType), *FRAME_SCHEMA)

    def make():
        def step(cols):
            out = {f.name: [] for f in schema}
            for key, media in zip(cols[id_column], cols[media_column], strict=True):
                for f in decode_gif(media):
                    row = (key, f.index, f.start_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, int(f.opaque.sum()), colour_histogram(f, levels))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            return out

        return step

    return arrow_map(df, [id_column, media_column], make, schema, slice_rows=16)


#: A stored frame: number, time, what becomes of it, which index is transparent, visible pixels and their colours.
STORED_FRAME = struct(("frame", T.IntegerType()), ("start_ms", T.LongType()), ("delay_ms", T.LongType()), ("disposal", T.IntegerType()), ("transparent", T.IntegerType()), ("n_visible", T.LongType()), ("histogram", T.ArrayType(T.LongType())))
MEDIA_SCHEMA = struct(("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_frames", T.IntegerType()), ("duration_ms", T.LongType()), ("frames", T.ArrayType(STORED_FRAME)))


def stored_texts(texts: list[str | None], table: np.ndarray | None = None) -> list[tuple]:
    """Texts stored as GIFs, read back and measured: the columns of ``MEDIA_SCHEMA`` after doc_id."""
    raws = [text_bytes(text) for text in texts]
    medias = encode_gray_gifs([raw + bytes(-len(raw) % ROW_SAMPLES if raw else ROW_SAMPLES) for raw in raws], table)
    return [_measured(len(raw), media) for raw, media in zip(raws, medias, strict=True)]


def stored_text(text: str | None) -> tuple:
    """``stored_texts`` of one text."""
    return stored_texts([text])[0]


def _measured(n_bytes: int, media: bytes) -> tuple:
    digest, total, ends, tail, frames = hashlib.sha256(), 0, 0, b"", []
    shades = np.zeros(HIST_LEVELS, np.int64)
    for frame in decode_gif(media):
        # The canvas is gray, so one channel over the frame's own box is the payload again.
        back = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width, 0].tobytes()
        digest.update(back)
        total, ends, tail = total + len(back), frame.start_ms + frame.delay_ms, back[-ROW_SAMPLES:]
        shades += np.bincount(np.frombuffer(back, np.uint8) >> 6, minlength=HIST_LEVELS)
        frames.append({"frame": frame.index, "start_ms": frame.start_ms, "delay_ms": frame.delay_ms, "disposal": frame.disposal, "transparent": frame.transparent, "n_visible": int(frame.opaque.sum()), "histogram": colour_histogram(frame)})
    feature = f"frames={len(frames)};ms={ends};gray=" + ",".join(map(str, shades.tolist()))
    return n_bytes, total, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), ends, frames


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as a GIF of gray frames, read back: sizes, digests, and its timed frames with colour histograms.

    Null texts count as empty (one row of zeros); equal texts give equal values, and
    repeated rows repeat them; an empty table gives an empty result. Texts are stored
    whole, whatever their length. Other columns of ``docs`` are not read.
    """

    def make():
        table = phrase_table()

        def step(cols):
            rows = [(key, *row) for key, row in zip(cols["doc_id"], stored_texts(cols["text"], table), strict=True)]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(MEDIA_SCHEMA)}

        return step

    return arrow_map(docs, ["doc_id", "text"], make, MEDIA_SCHEMA, slice_rows=1024)
