"""Motion-JPEG AVI media columns: RIFF with an index, intra frames, shots by adaptive histogram differences.

A payload of bytes is stored as the quantised coefficients of baseline JPEG frames of 24x24 grey pixels, 64 of
each 8x8 block. The frame's Huffman tables give the one-bit code 0 to "category 8, no zeros before", whose eight
extra bits are the byte itself, so a coefficient is 9 bits and a frame 648 bytes before byte stuffing: coefficients
128..255 stand for the bytes 128..255 and -255..-128 for 0..127, with no loss. Reading goes by the RIFF index;
frames with these tables take a vectorised path, any other baseline frame the general decoder.

Defined cases: a null or empty text is one frame of padding; equal texts, and so rows that repeat each other, give equal
files each; a null doc_id is a document like others; an empty table gives no rows; other columns are ignored. A very long
text is coded and decoded by runs of frames and takes about four times its size, the file included.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import small_batches

FRAME, SIDE, FPS, BINS, RUN = 576, 24, 25, 16, 1024
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<clip:int,first:int,last:int,start_s:double,end_s:double>>"
#: Positions of the zigzag order in a row-major block, by the rule of its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

#: The inverse cosine transform of 8 values.
WAVE = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for u in range(8)] for x in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = bytes([1] + [0] * 15 + [8])
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _TABLE + b"\x10" + _TABLE)
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
TAIL = b"\xff\xd9"


def _runs(n: int) -> Iterator[tuple[int, int]]:
    """Frames by runs of RUN, as what is made of a frame's bytes takes many times their size."""
    yield from ((k, min(k + RUN, n)) for k in range(0, n, RUN))


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of 576."""
    return [f for a, b in _runs(len(payload) // FRAME) for f in _encode_run(payload[a * FRAME : b * FRAME])]


def _encode_run(payload: bytes) -> list[bytes]:
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)).reshape(-1, 8)
    coded = np.zeros((len(bits), 9), np.uint8)
    coded[:, 1:] = bits
    flat = np.packbits(coded)
    full = flat == 255
    place = np.cumsum(full)
    out = np.zeros(len(flat) + int(place[-1]), np.uint8)
    out[np.arange(len(flat)) + place - full] = flat
    per = FRAME * 9 // 8
    ends = [0, *(np.arange(per, len(flat) + 1, per) + place[per - 1 :: per]).tolist()]
    body = out.tobytes()
    return [HEAD + body[a:b] + TAIL for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    parts, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(_chunk(b"00dc", f))
        at += len(parts[-1])
    body = b"AVI " + head + _list(b"movi", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """(frames by the RIFF index, frames a second)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index, fps = 12, 8 + struct.unpack_from("<I", data, 4)[0], None, None, float(FPS)
    while at + 8 <= min(end, len(data)):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"LIST" and kind == b"hdrl" and data[at + 12 : at + 16] == b"avih":
            fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 20)[0])
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movie data or no index")
    out = []
    for name, _, off, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            off += movi if data[movi + off : movi + off + 4] == name else 0  # some writers count from the file's start
            out.append(data[off + 8 : off + 8 + size])
    return out, fps


def read_payload(frames: list[bytes]) -> np.ndarray:
    """The stored bytes of frames made by encode_frames."""
    parts = [_read_run(frames[a:b]) for a, b in _runs(len(frames))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _read_run(frames: list[bytes]) -> np.ndarray:
    if any(not f.startswith(HEAD) or not f.endswith(TAIL) for f in frames):
        raise ValueError("frames of another coder")
    raw = np.frombuffer(b"".join(f[len(HEAD) : -2] for f in frames), np.uint8)
    stuffed = np.zeros(len(raw), bool)
    stuffed[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    bits = np.unpackbits(raw[~stuffed]).reshape(-1, 9)
    if bits[:, 0].any():
        raise ValueError("broken entropy data")
    return np.packbits(bits[:, 1:])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Luma pixels of a baseline JPEG frame (Huffman, 8 bits, any sampling, restart markers)."""
    at, quant, huff, comps, size, every, scan = 2, {}, {}, [], (0, 0), 0, None
    while scan is None:
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.array(struct.unpack_from(">64H" if wide else "64B", body, 1), np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for bits in range(1, 17):
                    for _ in range(counts[bits - 1]):
                        table[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]] = table
                body = body[k:]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    if len(comps) == 1:
        comps, hm, vm = [(comps[0][0], 1, 1, comps[0][3])], 1, 1
    across, down = -(-size[1] // (8 * hm)), -(-size[0] // (8 * vm))
    planes = [np.zeros((down * v * 8, across * h * 8)) for _, h, v, _ in comps]
    pos, hold, have = at, 0, 0

    def take(n: int) -> int:
        nonlocal pos, hold, have
        while have < n:
            byte = data[pos] if pos < len(data) else 0
            if byte != 0xFF:
                pos += 1
            elif data[pos + 1] == 0:
                pos += 2
            else:  # a marker ends the interval
                byte = 0
            hold, have = (hold << 8 | byte) & 0xFFFFFFFFFF, have + 8
        have -= n
        return hold >> have & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for bits in range(1, 17):
            code = code << 1 | take(1)
            if (bits, code) in table:
                return table[bits, code]
        raise ValueError("broken Huffman code")

    def value(bits: int) -> int:
        v = take(bits) if bits else 0
        return v if not bits or v >> (bits - 1) else v - (1 << bits) + 1

    dc = [0] * len(comps)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            pos += 2
            have, dc = 0, [0] * len(comps)
        for c, (ident, h, v, q) in enumerate(comps):
            for block in range(h * v):
                coef, k = np.zeros(64), 1
                dc[c] += value(symbol(huff[scan[ident] >> 4]))
                coef[0] = dc[c]
                while k < 64:
                    s = symbol(huff[0x10 | scan[ident] & 15])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        coef[k] = value(s & 15)
                    k += 1
                grid = np.zeros(64)
                grid[ZIGZAG] = coef * quant[q]
                y, x = (mcu // across * v + block // h) * 8, (mcu % across * h + block % h) * 8
                planes[c][y : y + 8, x : x + 8] = WAVE @ grid.reshape(8, 8) @ WAVE.T
    return np.clip(np.round(planes[0][: size[0], : size[1]] + 128), 0, 255).astype(np.uint8)


def own_pixels(payload: np.ndarray) -> np.ndarray:
    """Luma pixels of the frames of encode_frames by their stored bytes, a row each, as decode_jpeg gives them."""
    side, coef = SIDE // 8, payload.reshape(-1, FRAME // 64, 64).astype(np.float64)
    coef[coef < 128] -= 255
    coef[:, :, 0] = np.cumsum(coef[:, :, 0], axis=1)
    grid = np.zeros_like(coef)
    grid[:, :, ZIGZAG] = coef
    px = WAVE @ grid.reshape(-1, side, side, 8, 8) @ WAVE.T
    return np.clip(np.round(px.transpose(0, 1, 3, 2, 4).reshape(-1, FRAME) + 128), 0, 255).astype(np.uint8)


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS grey levels in each frame's pixels."""
    n = len(frames)
    pixels = frames.reshape(n, -1) >> 4
    return np.bincount((np.arange(n)[:, None] * BINS + pixels).ravel(), minlength=n * BINS).reshape(n, BINS) / pixels.shape[1]


def own_histograms(payload: np.ndarray) -> np.ndarray:
    """The same of the frames of encode_frames, some at a time, by their stored bytes."""
    return np.concatenate([histograms(own_pixels(payload[a * FRAME : b * FRAME])) for a, b in _runs(len(payload) // FRAME)])


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot of frames of pixels."""
    return cuts(histograms(frames))


def cuts(hist: np.ndarray, window: int = 8, least: float = 0.25) -> list[tuple[int, int]]:
    """The same by the frames' histograms. A cut is a histogram difference above the mean of those in the window before
    it by three deviations and a floor."""
    n = len(hist)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2.0
    if not len(diff):
        return [(0, n - 1)]
    c1, c2 = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff**2)))
    lo = np.maximum(0, np.arange(len(diff)) - window)
    count = np.maximum(1, np.arange(len(diff)) - lo)
    mean = (c1[:-1] - c1[lo]) / count
    dev = np.sqrt(np.maximum(0, (c2[:-1] - c2[lo]) / count - mean**2))
    at = np.flatnonzero(diff > np.maximum(mean + 3 * dev, 0) + least) + 1
    return list(zip([0, *at.tolist()], [*(at - 1).tolist(), n - 1], strict=True))


def clips(frames: list[bytes], fps: float) -> list[dict]:
    """Timed clip rows of decoded frames."""
    try:
        seen = own_histograms(read_payload(frames))
    except ValueError:
        seen = np.concatenate([histograms(decode_jpeg(f)[None]) for f in frames])
    return _timed(seen, fps)


def _timed(hist: np.ndarray, fps: float) -> list[dict]:
    return [{"clip": k, "first": a, "last": b, "start_s": a / fps, "end_s": (b + 1) / fps} for k, (a, b) in enumerate(cuts(hist))]


def store(text: bytes) -> bytes:
    pad = -len(text) % FRAME or (FRAME if not text else 0)
    return write_avi(encode_frames(text + b"\xff" * pad))


def _media(with_file: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                cols: list[list] = [[] for _ in range(8)]
                for text in b.column(1).cast(pa.binary()).to_pylist():
                    media = store(text or b"")
                    frames, fps = read_avi(media)
                    stored = read_payload(frames)
                    payload = stored.tobytes()
                    parts = _timed(own_histograms(stored), fps)
                    row = (len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), parts, media)
                    for to, v in zip(cols, row, strict=True):
                        to.append(v)
                long, text, kind = pa.int64(), pa.string(), pa.list_(pa.struct([("clip", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
                types = [long, long, text, long, long, text, kind, pa.binary()][: 7 + with_file]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "media"]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names[: 8 + with_file])

    return run


def media_columns(docs: DataFrame, with_file: bool = False) -> DataFrame:
    """Each text as an AVI file, read back: sizes, digests and timed clips; with_file adds the file's bytes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_media(with_file), SCHEMA + ", media binary" * with_file)


def clip_rows(docs: DataFrame) -> DataFrame:
    """One row per shot: doc_id, media_sha256, clip, first and last frame, start and end in seconds."""
    return media_columns(docs).select("doc_id", "media_sha256", F.inline("clips"))
