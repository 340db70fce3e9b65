import base64
import hashlib
import io

import zstandard

from netlens.llm import warc

SCHEMA = "page_id long, url string, html string, lang string"


class Sink(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


def test_bundle_is_plain_zstandard_and_seekable():
    sink = Sink()
    w, kept = warc.BundleWriter(sink), []
    for k in range(400):
        data = warc.record(k, f"http://x/é {k}\r\nbad", b"<p>" + bytes([k % 251]) * (k * 17), 5 if k % 3 == 0 else None)
        kept.append((*w.add(data), len(data), data))
    w.close()
    raw = sink.getvalue()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == b"".join(x[3] for x in kept)
    r = warc.BundleReader(sink)
    assert len(r.sizes) > 3
    for frame, offset, length, data in reversed(kept):
        assert r.read(frame, offset, length) == data


def test_round_trip(spark):
    rows = [(1, "u", "same"), (9, "v", "same"), (4, None, "same"), (2, "x", ""), (3, "y", None), (5, "z", "é😀" * 200_000), (None, "n", "same"), (None, "m", "alone"), (7, "r", "twice"), (7, "r", "twice"), (10, "h", "line\r\n\r\nbreak")]
    got = sorted(warc.round_trip(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)).collect(), key=str)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    assert len(got) == len(rows)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = top[h or ""] >= 0 and i != top[h or ""]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_short_payloads_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab", "x"), (2, "u", "ab", "x"), (3, "u", "abcdef", "x"), (4, "u", "abcdef", "x")], SCHEMA)
    warc.write_archives(df, f"file://{tmp_path}/w", f"file://{tmp_path}/i", least=3)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark.read.parquet(f"file://{tmp_path}/i"), f"file://{tmp_path}/w").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dates_and_ids_of_records(spark, tmp_path):
    fields = lambda data: dict(x.split(": ", 1) for x in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    one, other = fields(warc.record(5, "u", b"a", None)), fields(warc.record(5, "u", b"b", None, "2024-05-06T07:08:09Z"))
    assert one["WARC-Record-ID"] != other["WARC-Record-ID"] and (one["WARC-Date"], other["WARC-Date"]) == (warc.DATE, "2024-05-06T07:08:09Z")
    assert fields(warc.record(4, "u", b"a", 5))["WARC-Refers-To"] == one["WARC-Record-ID"]
    rows = [(5, "u", "one"), (5, "u", "two"), (6, "u", "one"), (6, "u", "three"), (2, "u", "two")]
    got = sorted(warc.round_trip(spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)).select("page_id", "payload_bytes", "record_type", "refers_to").collect(), key=str)
    want = [(5, 3, "revisit", 6), (5, 3, "response", None), (6, 3, "response", None), (6, 5, "response", None), (2, 3, "revisit", 5)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
