"""GIF media columns: encoding, decoding and features of timed frames.

The decoder takes any GIF: global and local palettes, interlacing, transparency, all disposal methods, LZW with
clear codes anywhere and tables left full. Code widths depend only on how many codes have passed since a clear
code, so a run of codes is unpacked at once. Table entry 258 + j of a run is what code j put out and one character
more, that is a stretch of the output; so lengths follow from parent links and output characters from pointer
doubling, in a few array steps for each run.

The encoder writes a byte payload as palette indices, 576 to a row, in frames of up to 64 rows with a delay each,
with LZW codes.

Defined results: a null or empty text is one row of 255s, a very long one has many frames; equal texts have equal
media; repeated rows come back as often as they occur, a null doc_id as it is. A media value that is null or no GIF, that
breaks off before its trailer, or whose canvas passes MOST_PIXELS, has null features and no frames. Other columns,
whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import documents

ROW = 576
ROWS_EACH = 64
DELAY = 10  # hundredths of a second


# -- LZW ------------------------------------------------------------------------------------------------------


_known: dict = {}


def _schedule(n: int, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of code i after a clear code, for i below n, and their running sum."""
    if (n, min_size) not in _known:
        free = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
        w = np.clip(np.floor(np.log2(free)).astype(np.int32) + 1, min_size + 1, 12)
        _known[n, min_size] = w, np.cumsum(w, dtype=np.int32)
    return _known[n, min_size]


#: Codes of a run that are looked at together: a full table and some more.
RUN = 4352


def lzw_codes(data: bytes, min_size: int) -> list[list[int]]:
    """Codes of data, shifted up by 8 bits, in runs; the table is cleared after each run but the last."""
    first = (1 << min_size) + 2
    runs: list[list[int]] = []
    if not data:
        return runs
    it = iter(data)
    cur = next(it) << 8
    while True:
        codes: list[int] = []
        emit, table, free = codes.append, {}, first << 8
        get = table.get
        for b in it:
            key = cur | b
            cur = get(key)
            if cur is None:
                emit(key)
                cur = b << 8
                table[key] = free
                free += 256
                if free >= 4094 << 8:
                    break
        else:
            emit(cur)
            runs.append(codes)
            return runs
        runs.append(codes)


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """GIF's LZW code stream of indices below 2**min_size."""
    clear = 1 << min_size
    parts, widths = [np.array([clear], np.int32)], [np.array([min_size + 1], np.int32)]
    runs = lzw_codes(data, min_size)
    for k, codes in enumerate(runs):
        c = np.array([*codes, (clear + (k + 1 == len(runs))) << 8], np.int32)
        parts.append(c >> 8)
        widths.append(_schedule(RUN, min_size)[0][: len(c)])
    if not runs:
        parts.append(np.array([clear + 1], np.int32))
        widths.append(np.array([min_size + 1], np.int32))
    c, w = np.concatenate(parts), np.concatenate(widths)
    end = np.cumsum(w, dtype=np.int64)
    at = end - w
    # a code touches three bytes at most; those of neighbours meet in shared bytes, where their bits do not
    out = np.zeros((int(end[-1]) + 7 >> 3) + 3, np.int64)
    word = c.astype(np.int64) << (at & 7)
    byte = at >> 3
    n = len(out)
    for k in range(3):
        out += np.bincount(byte + k, weights=(word >> (8 * k)) & 255, minlength=n).astype(np.int64)[:n]
    return out[:-3].astype(np.uint8).tobytes()


def _lengths(parent: np.ndarray) -> np.ndarray:
    """Lengths of what codes put out: one more than the links to a literal, by doubling over parent links (-1: a literal)."""
    n = len(parent)
    up = np.append(np.where(parent < 0, n, parent), n)
    dist = (up != n).astype(np.int32)
    while True:
        more = dist[up]
        if not more.any():
            return dist[:n] + 1
        dist = dist + more
        up = up[up]


def _run_output(codes: np.ndarray, clear: int) -> np.ndarray:
    """Indices that the codes of one run, without clear and end codes, put out."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint8)
    parent = codes - (clear + 2)
    parent[codes < clear] = -1
    if (parent >= np.arange(n, dtype=np.int32)).any():
        raise ValueError("a code stands before its entry")
    length = _lengths(parent)
    start = np.cumsum(length, dtype=np.int32) - length
    # character t of entry j is output character start[j] + t; literals stand for themselves
    shift = np.where(parent >= 0, start[parent] - start, 0).astype(np.int32)
    root = np.arange(int(start[-1] + length[-1]), dtype=np.int32) + np.repeat(shift, length)
    literal = np.zeros(len(root), np.uint8)
    at = start[parent < 0]
    literal[at] = codes[parent < 0]
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return literal[root]
        root = further


def lzw_decode(data: bytes, min_size: int, most: int) -> np.ndarray:
    """The first `most` indices of a GIF's LZW code stream."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    raw = raw[:-2].astype(np.int32) | raw[1:-1].astype(np.int32) << 8 | raw[2:].astype(np.int32) << 16
    bit, n_bits, out, got = 0, 8 * len(data), [], 0
    while got < most and bit + min_size + 1 <= n_bits:
        size = RUN
        while True:  # a table left full makes a run longer than the table
            widths, ends = _schedule(size, min_size)
            n = int(np.searchsorted(ends, n_bits - bit, side="right"))
            widths = widths[:n]
            pos = ends[:n] - widths + bit
            codes = (raw[pos >> 3] >> (pos & 7)) & ((1 << widths) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or n < size:
                break
            size *= 4
        k = int(stop[0]) if len(stop) else n
        out.append(_run_output(codes[:k], clear))
        got += len(out[-1])
        if not len(stop) or codes[k] == end:
            break
        bit += int(ends[k])
    return np.concatenate(out)[:most] if out else np.empty(0, np.uint8)


# -- files ----------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]


GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(frames: list[Frame], width: int, height: int, palette: bytes = GRAY, background: int = 0) -> bytes:
    """A GIF89a file; frames with a palette of their own get a local one."""
    bits = (len(palette) // 3 - 1).bit_length()
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | (bits - 1), background, 0), palette]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay, f.transparent or 0, 0))
        local = f.palette is not None
        size = (len(f.palette) - 1).bit_length() if local else 8
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, f.width, f.height, 0x80 | (size - 1) if local else 0))
        if local:
            out.append(np.asarray(f.palette, np.uint8).tobytes())
        least = max(2, size if local else bits)
        out.append(bytes([least]) + _blocks(lzw_encode(np.asarray(f.indices, np.uint8).tobytes(), least)))
    return b"".join([*out, b"\x3b"])


def read_gif(data: bytes) -> Gif:
    """Raises ValueError for what is no GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _read(data)
    except (IndexError, struct.error) as e:
        raise ValueError("a GIF that ends early") from e


#: Canvases and frames with more pixels are refused.
MOST_PIXELS = 1 << 26


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    if len(data) < at + n:
        raise ValueError("a palette that ends early")
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _read(data: bytes) -> Gif:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas beyond the bound")
    palette, at = _palette(data, 13, flags)
    gif = Gif(width, height, background, palette, [])
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            local, at = _palette(data, at + 10, flags)
            least = data[at]
            if not 1 <= least <= 8 or w * h > MOST_PIXELS:
                raise ValueError("a code size or a frame beyond the bound")
            body, at = _sub_blocks(data, at + 1)
            idx = lzw_decode(body, least, w * h)
            idx = np.pad(idx, (0, w * h - len(idx))).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(idx)
                plain[order] = idx
                idx = plain
            gif.frames.append(Frame(left, top, w, h, idx, local if local is not None else palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("an unknown block")
    return gif


def canvases(gif: Gif) -> Iterator[np.ndarray]:
    """RGBA canvases, one for each frame, as shown: transparent pixels let through, disposal clears or restores after."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, gif.height - f.top)), max(0, min(f.width, gif.width - f.left))
        idx = f.indices[:h, :w]
        rgba = np.zeros((256, 4), np.uint8)
        if f.palette is not None:
            rgba[: len(f.palette), :3] = f.palette
        rgba[:, 3] = 255
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        new = rgba[idx]
        if f.transparent is None:
            area[:] = new
        else:
            shown = idx != f.transparent
            area[shown] = new[shown]
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours (two bits a channel), of what is not transparent."""
    px = canvas.reshape(-1, 4)
    px = px[px[:, 3] > 0] >> 6
    return np.bincount(px[:, 0] << 4 | px[:, 1] << 2 | px[:, 2], minlength=64)


def frame_histograms(gif: Gif) -> list[np.ndarray]:
    """The histogram of the canvas at each frame. Opaque frames that fill the canvas are counted by palette index."""
    if any(f.transparent is not None or f.palette is None or (f.left, f.top, f.width, f.height) != (0, 0, gif.width, gif.height) for f in gif.frames):
        return [histogram(c) for c in canvases(gif)]
    out = []
    for f in gif.frames:
        p = np.zeros((256, 3), np.uint8)
        p[: len(f.palette)] = f.palette
        p >>= 6
        out.append(np.bincount(p[:, 0] << 4 | p[:, 1] << 2 | p[:, 2], weights=np.bincount(f.indices.ravel(), minlength=256), minlength=64).astype(np.int64))
    return out


# -- payloads -------------------------------------------------------------------------------------------------


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % ROW or (0 if data else ROW))


def gif_of_payload(payload: bytes) -> bytes:
    rows = len(payload) // ROW
    frames = []
    for r in range(0, rows, ROWS_EACH):
        part = payload[r * ROW : (r + ROWS_EACH) * ROW]
        frames.append(Frame(0, 0, ROW, len(part) // ROW, np.frombuffer(part, np.uint8), None, DELAY, 1, None))
    return write_gif(frames, ROW, min(rows, ROWS_EACH))


def payload_of_gif(gif: Gif) -> bytes:
    return b"".join(f.indices.astype(np.uint8).tobytes() for f in gif.frames)


# -- columns --------------------------------------------------------------------------------------------------


def encode_texts(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF) of df(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([gif_of_payload(pad(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and, read back from media: payload digests, size, canvas, frames, time, and the summed histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for m in b.column(len(keep)):
                data = m.as_py()
                try:
                    gif = read_gif(data or b"")
                except ValueError:
                    rows.append((None,) * 6)
                    continue
                payload = payload_of_gif(gif)
                total = sum(frame_histograms(gif), np.zeros(64, np.int64))
                ms = 10 * sum(f.delay for f in gif.frames)
                feature = f"{gif.width}x{gif.height};frames={len(gif.frames)};ms={ms};hist=" + ",".join(f"{k}:{v}" for k, v in enumerate(total) if v)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*keep, *names])

    src = df.select(*keep, "media")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])
    return src.mapInArrow(run, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def timed_frames(df: DataFrame, key: str, with_rgba: bool = True) -> DataFrame:
    """One row for each frame of df(key, media): place in time, its rectangle, the RGBA canvas as shown, and its histogram."""

    kind = df.schema[key].dataType.simpleString()
    names = ["key", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "rgba", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32 = pa.int32()
        types = [i32, i32, i32, i32, i32, i32, i32, i32, i32, pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            for k in range(b.num_rows):
                try:
                    gif = read_gif(b.column(1)[k].as_py() or b"")
                except ValueError:
                    continue
                start, rows, size = 0, [], 0
                shown = zip(gif.frames, canvases(gif), strict=True)
                for i, (f, c) in enumerate(shown):
                    rows.append((i, start, 10 * f.delay, f.left, f.top, f.width, f.height, f.disposal, f.transparent, c.tobytes() if with_rgba else None, histogram(c)))
                    start, size = start + 10 * f.delay, size + c.size
                    if size >= FRAME_BYTES or i + 1 == len(gif.frames):
                        cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1).take(pa.array([0] * len(rows))), *cols], names=names)
                        rows, size = [], 0

    spark_schema = f"key {kind}, frame int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, rgba binary, histogram array<long>"
    return df.select(F.col(key).alias("key"), "media").mapInArrow(run, spark_schema).withColumnRenamed("key", key)


#: Canvases of one media value are handed on in batches of about this many bytes.
FRAME_BYTES = 16 << 20


def gif_timed_frames(spark, sf_dir: str) -> DataFrame:
    """The frames of every document's GIF: their times, rectangles and colour histograms."""
    frames = timed_frames(encode_texts(documents(spark, sf_dir)), "doc_id", with_rgba=False)
    return frames.select("doc_id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", F.array_join("histogram", ",").alias("histogram"))


def op2_gif_media(spark, sf_dir: str) -> DataFrame:
    return media_features(encode_texts(documents(spark, sf_dir)), ["doc_id", "n_bytes"])
