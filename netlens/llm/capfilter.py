"""Near-duplicate embeddings by spherical-cap filters with random product codes.

Filter directions are the products of `BLOCKS` random codes: coordinates are cut into blocks, each block has `width`
random unit vectors, and one of each block makes a direction. A vector is list-decoded to all directions whose inner
product exceeds the cap's bound (and to its best ones, if too few do). Vectors that share a filter are compared in double
precision. The number of filters follows the number of vectors; as caps narrow with it and a pair at cosine 0.9 shares
less of them, a vector goes to GROW more filters for each doubling beyond BASE. There are at most 2^(3 length / 4) filters, as
more would be too narrow for short vectors; their filters hold more vectors instead.

Equal vectors are one row with a multiplicity. Vectors travel once for each group of filters that share their first code
word, not once for each filter; word groups of many vectors are split by filter. Filters of more than MOST vectors are
dealt out by themselves, as pairs of blocks. A pair counts at its smallest common filter only, so partial counts add up;
a task emits one row per vector and a spanning forest, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths don't link; rows that repeat a vec_id count each as a vector;
a null vec_id takes part and is larger than all others; other columns are ignored; an empty table gives an empty table.
A very long vector has a square matrix of its length in each task that reads it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, bounded, connected_components, small_batches
from netlens.llm.kernel import grouped, spanning
from netlens.llm.ngram_join import dealt

BLOCKS, SHARE, EXPECT, LEAST, SEED, MOST = 2, 4, 24, 12, 7, 2048
#: Filters that a vector is in beyond EXPECT, for each doubling of the filters beyond BASE.
GROW, BASE = 6, 8000
#: Vectors of a word group that one task holds at once.
HELD = 20_000


def _bound(share: float) -> float:
    """The x that a standard normal variable exceeds with this probability, by bisection."""
    lo, hi = -8.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) / 2 > share else (lo, mid)
    return lo


def blocks_and_width(dim: int, filters: int) -> tuple[int, int]:
    blocks = min(BLOCKS, dim)
    return blocks, max(2, math.ceil(min(filters, 1 << min(3 * dim // 4, 62)) ** (1 / blocks)))


class Codes:
    """Random product codes for vectors of one length."""

    def __init__(self, dim: int, filters: int):
        rng = np.random.Generator(np.random.PCG64([SEED, dim]))
        self.blocks, self.width = blocks_and_width(dim, filters)
        self.cut = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.code = []
        for a, b in zip(self.cut[:-1], self.cut[1:], strict=True):
            c = rng.standard_normal((self.width, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        many = self.width**self.blocks
        expect = EXPECT + GROW * max(0.0, math.log2(many / BASE))
        self.fewest = math.ceil(expect * LEAST / EXPECT)
        self.least = _bound(min(0.5, expect / many)) * math.sqrt(self.blocks / dim)

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, filters) of the rows of unit vectors, sorted for each row."""
        x = unit @ self.turn
        dots = [x[:, a:b] @ c.T for a, b, c in zip(self.cut[:-1], self.cut[1:], self.code, strict=True)]
        rows, idents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.blocks == 2:
            r, i = np.nonzero(dots[0] + dots[1].max(1)[:, None] >= self.least)
            step = max(1, (1 << 22) // self.width)
            for lo in range(0, len(r), step):
                rr, ii = r[lo : lo + step], i[lo : lo + step]
                k, j = np.nonzero(dots[0][rr, ii][:, None] + dots[1][rr] >= self.least)
                rows.append(rr[k])
                idents.append(ii[k] * self.width + j)
        row, ident = np.concatenate(rows), np.concatenate(idents)
        few = np.bincount(row, minlength=len(x)) < self.fewest
        row, ident = row[~few[row]], ident[~few[row]]
        for k in np.flatnonzero(few).tolist():
            own = self._list([d[k] for d in dots])
            row, ident = np.append(row, np.full(len(own), k)), np.append(ident, own)
        order = np.lexsort((ident, row))
        return np.searchsorted(row[order], np.arange(len(x) + 1)), ident[order]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of unit vectors."""
        at, ident = self.lists(unit)
        return np.split(ident, at[1:-1])

    def _list(self, dots: list[np.ndarray]) -> np.ndarray:
        rest = np.cumsum([d.max() for d in dots[::-1]])[::-1]
        bound = self.least
        while True:
            total, ident = np.zeros(1), np.zeros(1, np.int64)
            for k, d in enumerate(dots):
                after = rest[k + 1] if k + 1 < len(dots) else 0.0
                near = np.flatnonzero(d + total.max(initial=-np.inf) + after >= bound)
                s = total[:, None] + d[near][None, :]
                i, j = np.nonzero(s + after >= bound)
                total, ident = s[i, j], ident[i] * self.width + near[j]
            if len(ident) >= self.fewest or bound < -len(dots):
                return np.sort(ident if bound == self.least else ident[np.argsort(-total, kind="stable")[: self.fewest]])
            bound -= 0.05


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, dim, vec), vec null where it links with nothing: its numbers in four bytes each if
    that is exact, in eight if not, as -0.0 is 0.0."""
    for b in batches:
        out, dims = [], []
        for x in b.column(1):
            v, dim = None, 0
            if x.is_valid and len(x) and not x.values.null_count:
                a = np.asarray(x.values, np.float64) + 0.0
                if np.isfinite(a).all() and a.any():
                    with np.errstate(over="ignore"):
                        short = a.astype(np.float32)
                    v, dim = (short if (short == a).all() else a).tobytes(), len(a)
            out.append(v)
            dims.append(dim)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])


def _vectors(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of what _read stored."""
    return _unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in raw]))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _short(filters: int) -> type:
    """The type that holds the numbers of so many filters."""
    return np.uint32 if filters < 1 << 30 else np.int64


def _filters(filters_: int):
    """Vectors with their filters, packed and as an array beside the first code word of each."""
    short = _short(filters_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for b in batches:
            dims, raw = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            filters: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
            words: list[np.ndarray] = list(filters)
            for dim in np.unique(dims).tolist():
                own = codes[dim] = codes.get(dim) or Codes(dim, filters_)
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), 1024):
                    part = rows[lo : lo + 1024].tolist()
                    for k, f in zip(part, own.decode(_vectors([raw[k] for k in part], dim)), strict=True):
                        filters[k], words[k] = f, f // own.width if own.blocks == 2 else f
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            at = pa.array(np.cumsum([0, *map(len, filters)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, flat(x)) for x in (filters, words)]
            packed = pa.array([x.astype(short).tobytes() for x in filters], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "dim", "vec", "mult")), packed, *lists], ["node", "dim", "vec", "mult", "packed", "filters", "words"])

    return run


def _solve(f: int, unit: np.ndarray, mult: np.ndarray, lists: list[np.ndarray], side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, a, b) of the vectors of a filter: how many others each links with whose smallest common filter this is, and
    a spanning forest of all links."""
    m = len(unit)
    near = np.zeros((m, m), bool)
    for a in range(0, m, 512):
        near[a : a + 512] = unit[a : a + 512] @ unit.T >= least
    near[np.arange(m), np.arange(m)] = False
    if side is not None:
        near &= side[:, None] != side[None, :]
    none, links = np.zeros(0, np.int64), np.zeros(m, np.int64)
    some = np.flatnonzero(near.any(1))
    if not len(some):
        return links, none, none
    near = near[np.ix_(some, some)]  # the few vectors with a link; only their other filters matter
    lower = [lists[k][: np.searchsorted(lists[k], f)] for k in some.tolist()]
    known, row = np.concatenate(lower), np.repeat(np.arange(len(some)), [len(v) for v in lower])
    order = np.argsort(known, kind="stable")
    known, row = known[order], row[order]
    cut = np.flatnonzero(np.concatenate(([True], known[1:] != known[:-1], [True]))) if len(known) else none
    seen = np.zeros(near.shape, bool)
    many = np.flatnonzero(np.diff(cut) > 1)
    for lo, hi in zip(cut[many].tolist(), cut[many + 1].tolist(), strict=True):
        seen[np.ix_(row[lo:hi], row[lo:hi])] = True
    links[some] = (near & ~seen) @ mult[some]
    a, b = spanning(len(some), lambda k, left: near[k, left])
    return links, some[a], some[b]


COLUMNS = ("node", "mult", "vec", "packed")


class _Sums:
    """Links by vector and edges of one task, as (node, links, head) rows: head is a neighbour, or the vector itself."""

    def __init__(self):
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, nodes: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        some = np.flatnonzero(links > 0)
        self.out.append((nodes[some], links[some], nodes[some]))
        self.out.append((nodes[b], np.zeros(len(b), np.int64), nodes[a]))

    def batch(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.out, strict=True)] if self.out else [np.zeros(0, np.int64)] * 3
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "head"])


def _word_groups(least: float, most: int, filters: int):
    """Groups of vectors that share a first code word: all their common filters of at most `most` vectors."""
    short = _short(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for (dim, word, part, parts), cols in grouped(batches, ("dim", "word", "part", "parts"), COLUMNS):
            nodes, first = np.unique(cols[0].to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            take = pa.array(first)
            unit, mult = _vectors(cols[2].take(take).to_pylist(), dim), cols[1].to_numpy()[first]
            lists = [np.frombuffer(x, short).astype(np.int64) for x in cols[3].take(take).to_pylist()]
            flat, row = np.concatenate(lists), np.repeat(np.arange(len(nodes)), [len(x) for x in lists])
            blocks, width = blocks_and_width(dim, filters)
            here = (flat % parts == part) & ((flat // width if blocks == 2 else flat) == word)
            flat, row = flat[here], row[here]
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            cut = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1], [True]))).tolist() if len(flat) else []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if 1 < hi - lo <= most:
                    own = row[lo:hi]
                    sums.add(nodes[own], *_solve(int(flat[lo]), unit[own], mult[own], [lists[k] for k in own.tolist()], None, least))
            if len(sums.out) > 4096:
                yield sums.batch()
        yield sums.batch()

    return run


def _hot_filters(least: float, filters: int):
    """Filters of many vectors, a pair of blocks each."""
    short = _short(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for (f, dim, i, j), cols in grouped(batches, ("filter", "dim", "i", "j"), (*COLUMNS, "b")):
            nodes, first = np.unique(cols[0].to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            take = pa.array(first)
            lists = [np.frombuffer(x, short).astype(np.int64) for x in cols[3].take(take).to_pylist()]
            side = cols[4].to_numpy()[first] if i != j else None
            sums.add(nodes, *_solve(f, _vectors(cols[2].take(take).to_pylist(), dim), cols[1].to_numpy()[first], lists, side, least))
            if len(sums.out) > 64:
                yield sums.batch()
        yield sums.batch()

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings(vec_id, embedding)."""
    s = Scratch(embeddings.sparkSession)
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_read, "vec_id long, dim int, vec binary")
    rows = s.cut(rows.withColumn("node", F.xxhash64("dim", "vec")), "rows")
    good = rows.where("vec is not null")
    reps = s.cut(good.groupBy("dim", "vec").agg(F.count("*").alias("mult"), F.min("vec_id").alias("low")).withColumn("node", F.xxhash64("dim", "vec")), "reps")
    count = reps.count()
    filters = max(4, count // SHARE)
    found = s.cut(reps.select("node", "dim", "vec", "mult").mapInArrow(_filters(filters), "node long, dim int, vec binary, mult long, packed binary, filters array<long>, words array<long>"), "filters")
    # Only ids are counted: vectors by filter, and by first code word.
    hot = found.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").count().where(F.col("count") > MOST)
    hot = s.cut(hot.select("dim", "filter", F.ceil(F.col("count") / MOST).cast("int").alias("blocks")), "hot", True)
    words = found.select("dim", F.explode(F.array_distinct("words")).alias("word")).groupBy("dim", "word").count().where("count > 1")
    words = s.cut(words.select("dim", "word", F.ceil(F.col("count") / HELD).cast("int").alias("parts")), "words", True)
    heavy = ("node", "mult", "vec", "packed")
    own = F.transform(F.filter(F.arrays_zip("filters", "words"), lambda x: x["words"] == F.col("word")), lambda x: F.pmod(x["filters"], F.col("parts")).cast("int"))
    by_word = found.select("dim", "filters", "words", *heavy, F.explode(F.array_distinct("words")).alias("word")).join(bounded(words), ["dim", "word"])
    by_word = by_word.select("dim", "word", "parts", *heavy, F.explode(F.array_distinct(own)).alias("part")).repartition("dim", "word", "part").sortWithinPartitions("dim", "word", "part")
    by_filter = dealt(found.select("dim", *heavy, F.explode("filters").alias("filter")).join(bounded(hot), ["dim", "filter"]), "filter", "node", "dim")
    sums = "node long, links long, head long"
    part = by_word.mapInArrow(_word_groups(threshold, MOST, filters), sums).unionByName(by_filter.mapInArrow(_hot_filters(threshold, filters), sums))
    part = s.cut(part, "links", True)
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(part.select(F.col("head").alias("a"), F.col("node").alias("b")), s)
    comp = comp.join(reps.select("node", "low"), "node")
    low = comp.groupBy("root").agg(F.min("low").alias("component_id"))
    comp = comp.join(low, "root").select("node", "component_id")
    facts = reps.select("node", "mult", "low").join(links, "node", "left").join(comp, "node", "left")
    facts = s.cut(facts.select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")), "facts", True)
    out = good.select("vec_id", "node").join(facts, "node").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return s.finish(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
