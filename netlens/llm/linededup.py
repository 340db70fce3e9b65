"""Line dedup by a segment-partition edit join.

Lines of at least `shortest` code points, trimmed, that are equal or within EDITS edits belong to one class; its first
occurrence by (doc_id, line number) stays, all others go. A line is cut into EDITS + 1 segments, of which a line within
EDITS edits holds one unchanged; the index has a key for each segment and the line's length, and lines probe, for every
length they can match, the substrings that the length difference and the edits before and after allow. Keys that one
line only has are dropped by partial aggregates before any list is made. The lines of a list are joined by a spanning
forest over those that the parities of their bigram counts leave (EDITS edits flip a bounded number); the components are
candidate groups, whose lines are verified by a banded bit-parallel automaton, again along a spanning forest. Lists and
groups beyond ROWS lines are dealt out as pairs of blocks, so a segment that very many lines share is no single task's,
and no step emits pairs. Exact copies are one line throughout.

Defined cases: null text stays null, with 0 lines; an empty table gives an empty table; blank lines and those shorter
than `shortest` (a parameter; EDITS + 1 at least) stay; rows that repeat doc_id and text are one document and lose the
same lines; a null doc_id is larger than all others; ties between places are broken by a hash of the text; other columns
pass through; a text whose lines all go is empty. A very long text is read in pieces of whole lines; one line takes about
eighty times its own size while it is hashed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, aside, bounded, connected_components, small_batches
from netlens.llm.kernel import _powers, chunks, grouped, mix, spanning
from netlens.llm.ngram_join import blocks_of, dealt
from netlens.llm.pii import let

EDITS, SHORTEST, PART, SEEN = 2, 20, 1 << 18, 1 << 19
#: Lines, and code points, of a list or group that are compared with each other at once.
ROWS, POINTS = 2048, 1 << 22
_TRIM = np.zeros(256, bool)
_TRIM[[9, 10, 11, 12, 13, 32]] = True
LAST = 2**63 - 1
ADDED = ("_lines", "_gone", "_dropped")
#: Random words for the lead byte of a code point and for each byte after it.
_CODE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**64, (4, 256), dtype=np.uint64)
#: One edit takes away at most two bigrams and adds at most two.
FLIPS = 4 * EDITS


def _agree(most: int, same: Callable[[int], bool]) -> int:
    """The largest n up to `most` for which same(n), by bisection."""
    lo = 0
    while lo < most:
        mid = (lo + most + 1) // 2
        lo, most = (mid, most) if same(mid) else (lo, mid - 1)
    return lo


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: an automaton whose states for each number of errors are the bits of one
    integer, kept to the band of 2k + 1 diagonals."""
    if abs(len(a) - len(b)) > k:
        return False
    most = min(len(a), len(b))
    lo = _agree(most, lambda n: a[:n] == b[:n])
    hi = _agree(most - lo, lambda n: not n or a[-n:] == b[-n:])
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= k
    masks: dict[str, int] = {}
    for j, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << j
    full, wide = (1 << (len(a) + 1)) - 1, (1 << (2 * k + 1)) - 1
    states = [(1 << (d + 1)) - 1 for d in range(k + 1)]
    for t, c in enumerate(b, 1):
        m, band = masks.get(c, 0), (wide << t - k if t >= k else wide >> k - t) & full
        new = [(states[0] & m) << 1 & band]
        for d in range(1, k + 1):
            new.append(((states[d] & m) << 1 | states[d - 1] | states[d - 1] << 1 | new[d - 1] << 1) & band)
        states = new
        if not states[k]:
            return False
    return bool(states[k] >> len(a) & 1)


def _cut(length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the segments of lines of these lengths; the longer segments are last."""
    parts, out, at = EDITS + 1, [], np.zeros_like(length)
    for i in range(1, parts + 1):
        own = length // parts + (i > parts - length % parts)
        out.append((at, own))
        at = at + own
    return out


def _trim(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds without white space at the ends: one byte a round, then at once for what is left after a few."""
    start, end = start.copy(), end.copy()
    for _ in range(8):
        ends = (start < end) & _TRIM[data[np.maximum(end - 1, 0)]]
        end -= ends
        starts = (start < end) & _TRIM[data[np.minimum(start, len(data) - 1)]]
        start += starts
        if not ends.any() and not starts.any():
            return start, end
    ink = np.concatenate((np.flatnonzero(~_TRIM[data]), [len(data)]))
    first, last = np.searchsorted(ink, start), np.searchsorted(ink, end)
    some = last > first
    return np.where(some, ink[first], start), np.where(some, ink[np.maximum(last - 1, 0)] + 1, start)


class Lines:
    """The lines of a chunk of texts that count: trimmed, at least `shortest` code points. A code point is a lead byte
    with the bytes that follow it, and all lengths and positions count those."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, shortest: int = SHORTEST):
        n, self.shortest = len(data), shortest
        brk = np.flatnonzero(data == 10)
        start = np.sort(np.concatenate((offs[:-1][offs[1:] > offs[:-1]], brk[~np.isin(brk + 1, offs)] + 1)))
        row = np.searchsorted(offs, start, "right") - 1
        end = np.minimum(np.concatenate((start[1:], [n])), offs[row + 1])
        end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10))
        self.at = np.arange(len(start)) - np.searchsorted(row, row)
        start, end = _trim(data, start, end)
        follows = (data & 0xC0) == 0x80
        tail = np.flatnonzero(follows)
        place = np.arange(n) if not len(tail) else np.flatnonzero(~follows)
        unit = (lambda x: x - np.searchsorted(tail, x)) if len(tail) else (lambda x: x)
        first = unit(start)
        size = unit(end) - first
        keep = np.flatnonzero(size >= shortest)
        self.row, self.at, self.size, self.s = row[keep], self.at[keep], size[keep], first[keep]
        self.v = _CODE[0][data[place]]
        own = unit(tail) - 1 if len(tail) else tail  # the code point that each following byte belongs to
        turn = tail - place[own] if len(tail) else tail
        for k in range(1, 4):
            at = turn == k
            self.v[own[at]] += _CODE[k][data[tail[at]]]
        pw, self.inv = _powers(max(1, len(self.v)))
        self.c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.v * pw[: len(self.v)])))
        self.h = self.hash(self.s, self.size)

    def hash(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.c[start + length] - self.c[start]) * self.inv[np.minimum(start, len(self.inv) - 1)] + length.astype(np.uint64))

    def take(self, rows: np.ndarray) -> None:
        self.row, self.at, self.size, self.s, self.h = (x[rows] for x in (self.row, self.at, self.size, self.s, self.h))

    def parity(self) -> np.ndarray:
        """Parities of the counts of a line's bigrams by 64 classes."""
        bits = np.zeros(len(self.v) + 1, np.uint64)
        two = self.v[:-1] * np.uint64(0x9E3779B97F4A7C15)
        two += self.v[1:]
        two *= np.uint64(0xBF58476D1CE4E5B9)
        two >>= np.uint64(58)
        np.left_shift(np.uint64(1), two, out=bits[: len(self.v) - 1])
        run = np.bitwise_xor.accumulate(bits)
        ends = self.s + self.size - 2
        return run[ends] ^ np.where(self.s > 0, run[np.maximum(self.s - 1, 0)], np.uint64(0))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, whether it is an index key) of all lines; an index key is the probe for the own length in place."""
        rows, keys, index = [], [], []
        for gap in range(EDITS + 1):
            length = self.size - gap
            for i, (at, own) in enumerate(_cut(length), 1):
                left, right = i - 1, EDITS + 1 - i
                for move in range(max(-left, gap - right), min(left, gap + right) + 1):
                    start = at + move
                    r = np.flatnonzero((length >= self.shortest) & (start >= 0) & (start + own <= self.size))
                    rows.append(r)
                    keys.append(mix(self.hash(self.s[r] + start[r], own[r]) + mix(length[r].astype(np.uint64) * np.uint64(8) + np.uint64(i))))
                    index.append(np.full(len(r), gap == 0 and move == 0))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(index)


def _chunks(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[tuple[pa.RecordBatch, int, int, Lines]]:
    """(batch, first row, number of its first line, lines). A text beyond PART is cut after line breaks."""
    for b in batches:
        for lo, data, offs in chunks(b.column(b.num_columns - 1), PART):
            if len(data) <= PART:
                if len(data):
                    yield b, lo, 0, Lines(data, offs, shortest)
                continue
            after, at = np.flatnonzero(data == 10) + 1, 0
            while at < len(data):
                k = np.searchsorted(after, at + PART)
                end = int(after[k]) if k < len(after) else len(data)
                yield b, lo, int(np.searchsorted(after, at, "right")), Lines(data[at:end], np.array([0, end - at]), shortest)
                at = end


def _postings(shortest: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)  # sorted; lines met before in this task, to save rows; forgotten when they grow many
        for _, _, _, lines in _chunks(batches, shortest):
            own, first = np.unique(lines.h, return_index=True)
            at = np.searchsorted(seen, own)
            new = seen[np.minimum(at, len(seen) - 1)] != own if len(seen) else np.ones(len(own), bool)
            if not new.any():
                continue
            lines.take(first[new])
            seen = np.insert(seen, at[new], own[new]) if len(seen) < SEEN else own
            r, key, index = lines.keys()
            more = [pa.array(lines.parity().view(np.int64)[r]), pa.array(lines.size[r].astype(np.int32))] if full else [pa.array(index)]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(lines.h.view(np.int64)[r]), *more], ["key", "h", *(("sig", "size") if full else ("own",))])

    return run


def _places(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lo, before, lines in _chunks(batches, shortest):
            doc = b.select(["_d", "_t"]).take(pa.array(lines.row + lo))
            yield pa.RecordBatch.from_arrays([*doc.columns, pa.array((lines.at + before).astype(np.int32)), pa.array(lines.h.view(np.int64))], ["_d", "_t", "at", "h"])

    return run


def _compare(by: str, verify: bool):
    """Rows sorted by (by, i, j) to a spanning forest (a, b) of the lines that can be, or are, within EDITS edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cols in grouped(batches, (by, "i", "j"), ("h", "sig", "size", "b", *(("line",) if verify else ()))):
            h, first = np.unique(cols[0].to_numpy(), return_index=True)
            if len(h) < 2:
                continue
            sig, size, side = cols[1].to_numpy().view(np.uint64)[first], cols[2].to_numpy()[first], cols[3].to_numpy()[first]
            text = cols[4].take(pa.array(first)).to_pylist() if verify else []

            def near(k: int, left: np.ndarray) -> np.ndarray:
                ok = (np.bitwise_count(sig[left] ^ sig[k]) <= FLIPS) & (np.abs(size[left] - size[k]) <= EDITS)
                if i != j:
                    ok &= side[left] != side[k]
                if verify:
                    for p in np.flatnonzero(ok).tolist():
                        ok[p] = within(text[k], text[left[p]], EDITS)
                return ok

            a, b = spanning(len(h), near)
            yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b])], ["a", "b"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_d"), F.xxhash64(text).alias("_t"), text.alias("text"))


def line_links(keyed: DataFrame, firsts: DataFrame, s: Scratch, shortest: int) -> DataFrame:
    """(a, b): hashes of different lines within EDITS edits, a spanning forest of all such pairs."""
    texts = keyed.select("text")
    posts = texts.mapInArrow(_postings(shortest, False), "key long, h long, own boolean")
    keys = posts.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own")).where("low < high and own")
    keys = s.cut(keys.select("key"), "keys", True, True)
    posts = texts.mapInArrow(_postings(shortest, True), "key long, h long, sig long, size int")
    lists = s.cut(posts.join(bounded(keys), "key").distinct(), "lists")
    # Lists of the same lines, by their number and a sum of hashes, are compared once.
    looks = lists.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("h")).alias("x"), F.min("h").alias("low"))
    looks = looks.groupBy("m", "x", "low").agg(F.min("key").alias("key"))
    looks = s.cut(looks.select("key", blocks_of(F.col("m"), ROWS).alias("blocks")), "looks", True)
    met = dealt(lists.join(bounded(looks), "key"), "key", "h").mapInArrow(_compare("key", False), "a long, b long")
    groups = connected_components(met, s)
    facts = lists.select("h", "sig", "size").distinct()
    members = groups.toDF("h", "grp").join(facts, "h").join(firsts.select("h", "first"), "h")
    load = members.groupBy("grp").agg(F.greatest(blocks_of(F.count("*"), ROWS), F.ceil(F.sum("size") / POINTS).cast("int")).alias("blocks"))
    members = members.join(load, "grp").select("h", "grp", "sig", "size", "blocks", "first")
    wanted = members.groupBy("first._d", "first._t").agg(F.collect_list(F.struct("h", "grp", "sig", "size", "blocks", "first.at")).alias("w"))
    wanted = s.cut(wanted, "wanted", True)
    line = lambda all_: F.transform("w", lambda x: F.struct(x, F.btrim(F.get(all_, x["at"]), F.lit(" \t\r\x0b\x0c")).alias("line")))
    found = keyed.join(bounded(wanted), ["_d", "_t"]).select(F.inline(let(F.split("text", "\n", -1), line)).alias("w", "line"))
    found = dealt(found.select("w.*", "line").drop("at"), "grp", "h")
    return s.cut(found.mapInArrow(_compare("grp", True), "a long, b long"), "links", True)


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted positions gone; a byte mask tells each line's fate in one look."""
    def mask(g: Column) -> Column:
        one = lambda d, i: F.concat(F.repeat(F.lit("0"), (d - F.when(i > 0, F.get(g, i - 1)).otherwise(F.lit(-1)) - 1).cast("int")), F.lit("1"))
        return F.array_join(F.transform(g, one), "").cast("binary")

    keep = lambda m: F.filter(F.split(text, "\n", -1), lambda x, i: F.substring(m, i + 1, F.lit(1)) != F.lit(b"1"))
    return let(let(gone, mask), lambda m: F.array_join(keep(m), "\n"))


def dedup_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs with text without repeated lines, _lines and _gone, the numbers of lines before and of those dropped, and
    _dropped: each dropped line with its class, named by the place of the class's first line."""
    s = Scratch(docs.sparkSession)
    shortest = max(shortest, EDITS + 1)
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    places = s.cut(keyed.mapInArrow(_places(shortest), "_d long, _t long, at int, h long"), "places")
    firsts = places.groupBy("h").agg(F.min(F.struct("_d", "at", "_t")).alias("first"), F.count("*").alias("n"))
    firsts = s.cut(firsts, "firsts")
    classes = connected_components(line_links(keyed, firsts, s, shortest), s)
    named = s.cut(firsts.join(classes.toDF("h", "root"), "h"), "named", True)
    head = named.groupBy("root").agg(F.min("first").alias("head"))
    linked = named.join(head, "root").select("h", F.col("head").alias("first"))
    again = firsts.where("n > 1").join(linked.select("h"), "h", "left_anti").select("h", "first").unionByName(linked)
    hit = places.join(bounded(s.cut(again, "again", True)), "h").where("struct(_d, at, _t) <> first")
    gone = hit.groupBy("_d", "_t").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("line"), F.col("first._d").alias("doc_id"), F.col("first.at").alias("first_line")))).alias("gone"))
    gone = s.finish(gone)
    rows, names = aside(docs)
    text = F.col(names["text"]).cast("string")
    keyed = rows.withColumn("_d", F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(LAST))).withColumn("_t", F.xxhash64(text))
    out = keyed.join(bounded(gone), ["_d", "_t"], "left")
    lines = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    out = out.withColumn("_lines", lines.cast("long")).withColumn("_gone", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    out = out.withColumn(names["text"], F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone.line"))))
    return out.withColumnRenamed("gone", "_dropped").select(*rows.columns, *ADDED).toDF(*docs.columns, *ADDED)
