"""GIF media columns: texts stored as 8-bit GIF frames and read back.

A payload becomes the palette indices of frames 64 samples wide, LZW coded. The
reader takes any GIF87a/89a: it decodes the LZW streams, applies global and local
palettes, disposal and transparency rules, and gives timed frames with a colour
histogram each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty, written

WIDTH, MAX_HEIGHT = 64, 8192
_PLACES = np.arange(16)
_FULL = np.full(4096, 12), np.arange(4097) * 12
#: Colours of the 256 samples: red is the sample, green and blue are two other orders of the same values, so that each channel tells samples apart.
PALETTE = bytes(v for i in range(256) for v in (i, i * 37 % 256, (i * 101 + 64) % 256))


def lzw_encode(data: bytes, bits: int = 8, defer: bool = False) -> bytes:
    """GIF's LZW: a clear code, codes of growing width, an end code; defer keeps a full table instead of clearing it."""
    clear = 1 << bits
    codes, ends = [clear], []  # ends: codes so far at each clear, where widths start anew
    append = codes.append
    table: dict[int, int] = {}
    get = table.get
    it = iter(data)
    cur = next(it, None)
    size = clear + 2
    for c in it:
        k = cur << 8 | c
        nxt = get(k)
        if nxt is not None:
            cur = nxt
            continue
        append(cur)
        if size < 4096:
            table[k] = size
            size += 1
        elif not defer:
            append(clear)
            ends.append(len(codes))
            table.clear()
            size = clear + 2
        cur = c
    if cur is not None:
        append(cur)
    append(clear + 1)
    ends.append(len(codes))
    wide, at = np.empty(len(codes), dtype=np.int64), 1
    wide[0] = bits + 1
    for e in ends:
        wide[at:e] = 12
        wide[at : min(e, at + 4096)] = _widths(bits)[0][: e - at]
        at = e
    each = np.unpackbits(np.array(codes, dtype="<u2").view(np.uint8), bitorder="little").reshape(-1, 16)
    return np.packbits(each[_PLACES < wide[:, None]], bitorder="little").tobytes()


@lru_cache
def _widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes behind a clear code by their place, and the bits before each; a full table keeps 12 bits."""
    size = (1 << bits) + 1 + np.arange(4096)
    width = np.minimum(12, np.array([int(n).bit_length() for n in size]))
    width[0] = bits + 1
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The first `most` samples of an LZW stream; codes without meaning end it.

    Between two clear codes widths depend on places alone, so codes are cut out
    together; each code's string is a stretch of what is already out.
    """
    clear = 1 << bits
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int32)
    room = len(data) * 8
    out = bytearray()
    at, going = 0, True
    while going and at < room and len(out) < most:
        width, start = _widths(bits)
        parts = []
        while True:  # codes up to the next clear code; a table that stays full keeps its width
            n = min(int(np.searchsorted(start, room - at, "right")) - 1, len(width))
            if n <= 0:
                going = False
                break
            first = at + start[:n]
            k = first >> 3
            codes = (raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) >> (first & 7) & (1 << width[:n]) - 1
            stop = np.flatnonzero(codes - clear >> 1 == 0)  # clear or end
            if len(stop):
                n = int(stop[0])
                going = codes[n] == clear
                parts.append(codes[:n])
                at += int(start[n + 1])
                break
            parts.append(codes)
            at += int(start[n])
            if n < len(width):
                going = False
                break
            width, start = _FULL
        if parts:
            got, whole = _strings(np.concatenate(parts) if len(parts) > 1 else parts[0], clear, most - len(out))
            out += got
            going = going and whole
    return bytes(out[:most])


def _strings(codes: np.ndarray, clear: int, most: int) -> tuple[bytes, bool]:
    """What the codes after a clear code stand for, up to `most` samples and the code that passes them; and whether all have a meaning.

    A code repeats an earlier code's string and the sample behind it, so lengths
    are depths in a forest, and each sample is a copy of an earlier one, down to
    a single sample's code: both are found by doubling.
    """
    of = codes - (clear + 2)
    wrong = np.flatnonzero(of >= np.arange(len(codes)))
    whole = not len(wrong)
    if not whole:
        codes, of = codes[: wrong[0]], of[: wrong[0]]
    size = np.ones(len(codes), dtype=np.int64)
    longer = np.flatnonzero(of >= 0)
    up, rest = of.copy(), longer
    while len(rest):
        by = up[rest]
        size[rest] += size[by]
        up[rest] = by = up[by]
        rest = rest[by >= 0]
    ends = np.cumsum(size)
    n = int(np.searchsorted(ends, most)) + 1
    if n < len(codes):
        codes, of, size, ends = codes[:n], of[:n], size[:n], ends[:n]
        longer = longer[: np.searchsorted(longer, n)]
    begin = ends - size
    back = np.zeros(len(codes), dtype=np.int64)
    back[longer] = begin[longer] - begin[of[longer]]
    back = np.repeat(back, size)
    rest = np.flatnonzero(back)
    source = np.arange(len(back)) - back
    got = rest
    while len(got):
        by = source[got]
        to = source[by]
        source[got] = to
        got = got[to != by]
    out = np.zeros(len(back), dtype=np.uint8)
    single = np.ones(len(codes), dtype=bool)
    single[longer] = False
    out[begin[single]] = codes[single]
    return out[source].tobytes(), whole


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, delay: int = 10) -> bytes:
    """A GIF whose frames, one below another in the payload, hold its bytes; its length is a positive multiple of WIDTH."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_HEIGHT), 0xF7, 0, 0), PALETTE]
    for r in range(0, rows, MAX_HEIGHT):
        part = payload[r * WIDTH : (r + MAX_HEIGHT) * WIDTH]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


def _deinterlace(a: np.ndarray) -> np.ndarray:
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, len(a), step)]
    out = np.empty_like(a)
    out[order] = a[: len(order)]
    return out


def frames(gif: bytes) -> list[dict]:
    """All of each_frame, each with a canvas of its own."""
    return [f | {"canvas": f["canvas"].copy()} for f in each_frame(gif)]


def each_frame(gif: bytes) -> Iterator[dict]:
    """Timed frames: start_ms, delay_ms, disposal, indices (the stored samples), canvas (height, width, RGBA after the frame, until the next one).

    Disposal 2 clears a frame's area to transparency before the next one, 3 puts
    back what was there; transparent indices leave the canvas as it is. A file
    that breaks off gives the frames before that.
    """
    if gif[:6] not in (b"GIF87a", b"GIF89a") or len(gif) < 13:
        return
    w, h, flags = *struct.unpack_from("<HH", gif, 6), gif[10]
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common, at = gif[at : at + n], at + n
    canvas = np.zeros((h, w, 4), dtype=np.uint8)
    start, delay, disposal, clear = 0, 0, 0, None

    def data(at: int) -> tuple[bytes, int]:
        got = []
        while at < len(gif) and gif[at]:
            got.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(got), at + 1

    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21 and at + 1 < len(gif):
            body, to = data(at + 2)
            if gif[at + 1] == 0xF9 and len(body) >= 4:
                f, d, t = body[0], struct.unpack_from("<H", body, 1)[0], body[3]
                delay, disposal, clear = d * 10, f >> 2 & 7, t if f & 1 else None
            at = to
        elif gif[at] == 0x2C and at + 10 < len(gif):
            x, y, fw, fh, f = struct.unpack_from("<HHHHB", gif, at + 1)
            at += 10
            table = common
            if f & 0x80:
                n = 3 << (f & 7) + 1
                table, at = gif[at : at + n], at + n
            if at >= len(gif):
                break
            bits = gif[at]
            body, at = data(at + 1)
            if not 1 <= bits <= 11:
                break
            got = lzw_decode(body, bits, fw * fh)
            idx = np.frombuffer(got + bytes(fw * fh - len(got)), dtype=np.uint8).reshape(fh, fw)
            idx = _deinterlace(idx) if f & 0x40 else idx
            colours = np.zeros((256, 4), dtype=np.uint8)
            colours[:, 3] = 255
            if table:
                t = np.frombuffer(table[: len(table) // 3 * 3], dtype=np.uint8).reshape(-1, 3)[:256]
                colours[: len(t), :3] = t
            before = canvas.copy() if disposal == 3 else None
            ch, cw = max(0, min(fh, h - y)), max(0, min(fw, w - x))
            seen = idx[:ch, :cw]
            area = canvas[y : y + ch, x : x + cw]
            if clear is None:
                area[:] = colours[seen]
            else:
                area[seen != clear] = colours[seen[seen != clear]]
            yield {"start_ms": start, "delay_ms": delay, "disposal": disposal, "indices": idx, "canvas": canvas}
            start += delay
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            break


def histogram(canvas: np.ndarray, bins: int = 8) -> list[int]:
    """Visible pixels by their red, then green, then blue, each in `bins` equal steps (bins divides 256)."""
    seen = canvas if canvas[..., 3].all() else canvas[canvas[..., 3] > 0]
    return [n for i in range(3) for n in np.bincount(seen[..., i].ravel(), minlength=256).reshape(bins, -1).sum(axis=1).tolist()]


FRAME = "array<struct<start_ms:int,delay_ms:int,disposal:int,width:int,height:int,histogram:array<long>>>"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's GIF. Null text is empty; repeated rows and null ids are kept."""

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(1).to_pylist()]
            gifs = [encode(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(gifs, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("t")), run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Frames and payload of each GIF: the columns of media, frames (timed, with histograms), payload.

    A frame's histogram counts visible pixels of its canvas by red, green and
    blue, in 8 steps each. Null or broken media have no frames and an empty
    payload. Of media's own columns those named frames or payload are replaced.
    """
    media = media.select([c for c in media.columns if c not in ("frames", "payload")])
    names = media.columns

    def run(batches):
        for b in batches:
            rows, loads = [], []
            for g in b.column("media").to_pylist():
                load, row = [], []
                for f in each_frame(g or b""):
                    load.append(f["indices"].tobytes())
                    row.append({"start_ms": f["start_ms"], "delay_ms": f["delay_ms"], "disposal": f["disposal"], "width": f["indices"].shape[1], "height": f["indices"].shape[0], "histogram": histogram(f["canvas"])})
                loads.append(b"".join(load))
                rows.append(row)
            kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("start_ms", "delay_ms", "disposal", "width", "height")] + [("histogram", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(loads, pa.binary())], names=[*names, "frames", "payload"])

    schema = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)
    return map_arrow(media, run, f"{schema}, frames {FRAME}, payload binary")


def stored(docs: DataFrame) -> DataFrame:
    """read_media of the media table, written once to the shared folder."""
    return read_media(written(to_media(docs), "media"))


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of read_media's rows."""
    histogram_text = F.array_join(F.transform("frames", lambda f: F.concat(f["width"].cast("string"), F.lit("x"), f["height"].cast("string"), F.lit("@"), f["start_ms"].cast("string"), F.lit("+"), f["delay_ms"].cast("string"), F.lit(":"), F.array_join(f["histogram"].cast("array<string>"), ","))), ";")
    size = F.octet_length("payload")
    return read.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), histogram_text.alias("feature"))

