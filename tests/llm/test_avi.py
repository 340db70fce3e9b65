import hashlib
import zlib

import numpy as np
import pytest
from helpers import DOCS, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from netlens.llm import avi


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_lossless(data):
    frames, fps = avi.read_avi(avi.store(data))
    back = avi.read_payload(frames).tobytes()
    assert back.startswith(data) and set(back[len(data) :]) <= {255} and len(back) % 576 == 0 and len(back) - len(data) < 577 and len(back) > 0 and fps == 25


def test_frames_decode_as_baseline_jpeg():
    data = bytes(range(256)) * 9
    frames, _ = avi.read_avi(avi.store(data))
    assert avi.decode_jpeg(frames[0]).shape == (24, 24)
    # A frame of one grey level: all coefficients zero but the first, by hand: DC category 0, then end of block.
    table = bytes([0, 2] + [0] * 14)
    head = avi.HEAD[: avi.HEAD.index(b"\xff\xc4")] + avi._segment(0xC4, b"\x00" + table + bytes([0, 6]) + b"\x10" + table + bytes([0, 1])) + avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits = "01100000" + "00" + "0000" * 8
    raw = np.packbits([int(c) for c in bits + "1" * (-len(bits) % 8)]).tobytes().replace(b"\xff", b"\xff\x00")
    px = avi.decode_jpeg(head + raw + avi.TAIL)
    assert px.std() == 0 and px[0, 0] == 128 + 32 // 8


def test_own_frames_decode_to_the_pixels_of_the_general_decoder():
    data = np.random.default_rng(2).integers(0, 256, 576 * 6, np.uint8)
    data[576:1152] = np.frombuffer(b"plain text of a document " * 24, np.uint8)[:576]
    want = np.stack([avi.decode_jpeg(f).ravel() for f in avi.encode_frames(data.tobytes())])
    assert (avi.own_pixels(data) == want).all()


def test_zigzag():
    assert avi.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(avi.ZIGZAG) == list(range(64))


def test_shots_find_a_cut():
    still = np.tile(np.arange(576, dtype=np.uint8) % 64, (20, 1))
    frames = np.concatenate((still, still + 128, still))
    assert avi.shots(frames) == [(0, 19), (20, 39), (40, 59)]
    assert avi.shots(frames[:1]) == [(0, 0)]
    rows = avi.clips(avi.encode_frames(frames.tobytes()), 25.0)
    assert [(r["first"], r["start_s"]) for r in rows] == [(0, 0.0), (20, 0.8), (40, 1.6)]


def test_bad_files():
    for bad in (b"", b"RIFFxxxxWAVE", b"RIFF\x04\0\0\0AVI "):
        with pytest.raises(ValueError):
            avi.read_avi(bad)


def test_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 40_000), (None, "abc"), (1, "abc")]
    got = avi.media_columns(frame(spark, rows), with_file=True).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert got[0][1:] == got[4][1:] == got[5][1:]
    assert avi.media_columns(spark.createDataFrame([], DOCS)).count() == 0
    clips = avi.clip_rows(frame(spark, rows)).where("doc_id = 4").orderBy("clip").collect()
    assert clips[0]["first"] == 0 and clips[-1]["end_s"] == got[3]["payload_bytes"] / 576 / 25


def test_runs_of_frames_are_the_whole(monkeypatch):
    data = np.random.default_rng(5).integers(0, 256, 576 * 11, np.uint8).tobytes()
    whole, seen = avi.encode_frames(data), avi.own_histograms(np.frombuffer(data, np.uint8))
    monkeypatch.setattr(avi, "RUN", 3)
    assert avi.encode_frames(data) == whole and avi.read_payload(whole).tobytes() == data
    assert (avi.own_histograms(np.frombuffer(data, np.uint8)) == seen).all()


def slow_shots(frames):
    """Shots by plain loops over pixels."""
    hist = []
    for f in frames:
        count = [0] * 16
        for p in f.ravel().tolist():
            count[p // 16] += 1
        hist.append([c / f.size for c in count])
    diff = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(hist[:-1], hist[1:], strict=True)]
    starts = [0]
    for k, d in enumerate(diff):
        before = diff[max(0, k - 8) : k]
        mean = sum(before) / max(1, len(before))
        dev = max(0.0, sum(x * x for x in before) / max(1, len(before)) - mean**2) ** 0.5
        if d > mean + 3 * dev + 0.25 + 1e-12:
            starts.append(k + 1)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(frames)], strict=True)]


def test_features_of_the_query_are_those_of_a_slow_decoder(spark, sf_dir):
    from netlens.llm.queries import op9_avi_media

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 1200 and 9000").limit(25).collect()}
    got = {r["doc_id"]: r["feature"] for r in op9_avi_media(spark, sf_dir).collect()}
    assert len(text) > 5
    for i, t in text.items():
        frames, _ = avi.read_avi(avi.store(t.encode()))
        want = slow_shots([avi.decode_jpeg(f) for f in frames])
        assert got[i] == "shots:" + ",".join(f"{a}-{b}" for a, b in want), i
