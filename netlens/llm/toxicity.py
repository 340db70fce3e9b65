"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features are the words of a text and their first bytes. On a bounded sample of labelled rows (SAMPLE of each class,
a parameter) features are kept whose log-odds of the toxic class stand out and that are needed to cover the toxic rows. Labels are 0/1, so severity grades come
from the sample: clean is 0, toxic rows are cut by the thirds of their evidence into 1, 2 and 3. One weight vector
is shared across the ordered thresholds: P(grade <= j) = logistic(t_j - w.x), t_1 < t_2 < t_3. A text's severity is
the sum of P(grade >= j), and it is toxic if P(grade >= 1) is at least `cut`.

Every text is scored whole against a model of bounded size. Defined cases: null or empty text has no features and
is clean, null labels are ignored, a doc_id that is labelled both ways counts as toxic, without labels of both
classes nothing is toxic; repeated rows are scored each; a null doc_id is scored like others but is no labelled row;
an empty table gives no rows; other columns are ignored. A very long text is hashed in one piece and takes about forty
times its size in the task that does it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, aside, small_batches
from netlens.llm.kernel import chunks, words

SAMPLE, FEATURES, GRADES, HEADS = 4000, 4096, 3, (4, 6)
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SLOTS = 22


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def slots(self) -> np.ndarray:
        out = np.zeros(1 << _SLOTS, bool)
        out[self.keys >> np.uint64(64 - _SLOTS)] = True
        return out


def _features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature hashes, their rows) by chunk."""
    for lo, data, offs in chunks(texts):
        h, _, _, row = words(data, offs, _APART, HEADS)
        yield lo, len(offs) - 1, h, np.tile(row, len(HEADS) + 1)


def _counts(texts: pa.Array, keys: np.ndarray, slots: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, feature, count) of the model's features, by chunk."""
    for lo, rows, h, row in _features(texts):
        near = np.flatnonzero(slots[h >> np.uint64(64 - _SLOTS)])
        at = np.searchsorted(keys, h[near]).clip(0, max(0, len(keys) - 1))
        near, at = (near[keys[at] == h[near]], at[keys[at] == h[near]]) if len(keys) else (near[:0], at[:0])
        pair, count = np.unique(row[near] * max(1, len(keys)) + at, return_counts=True)
        yield lo, rows, pair // max(1, len(keys)), pair % max(1, len(keys)), count


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for _, rows, h, row in _features(b.column(1)):
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(rows + 1))
            out += [np.unique(h[order][x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        at = np.cumsum([0, *map(len, out)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))], ["y", "keys"])


def _sparse(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Model(keys, keys, keys).slots()
        for b in batches:
            f: list[list] = [[] for _ in range(b.num_rows)]
            c: list[list] = [[] for _ in range(b.num_rows)]
            for lo, _, row, at, count in _counts(b.column(2), keys, slots):
                for r, k, n in zip((row + lo).tolist(), at.tolist(), count.tolist(), strict=True):
                    f[r].append(k)
                    c[r].append(n)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, kind), pa.array(c, kind)], ["doc_id", "y", "f", "c"])

    return run


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cover(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, times: int = 3, fine: float = 4.0, least: int = 3) -> np.ndarray:
    """Features picked greedily until every toxic row that can be is covered `times` times; a clean row costs `fine`.
    Features that only go along with a group of copies add no cover and are left out."""
    need, used = np.where(y == 1, times, 0), np.zeros(width, bool)
    clean = np.bincount(col, (y[row] == 0) * fine, width)
    while width:
        gain = np.where(used, -1.0, np.bincount(col, need[row] > 0, width) - clean)
        best = int(np.argmax(gain))
        if gain[best] < least:
            break
        used[best] = True
        need[row[col == best]] -= 1
    return np.flatnonzero(used)


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, l2: float = 2e-5, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by Adam on the full batch."""
    n, k = len(y), GRADES
    p = np.concatenate((np.zeros(width), [1.0], np.full(k - 1, 0.5)))  # weights, the first threshold, log steps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        th = p[width] + np.concatenate(([0], np.cumsum(np.exp(p[width + 1 :]))))
        s = np.bincount(row, val * p[col], n)
        up = np.where(y < k, _logistic(th[np.minimum(y, k - 1)] - s), 1.0)
        down = np.where(y > 0, _logistic(th[np.maximum(y - 1, 0)] - s), 0.0)
        prob = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) / prob, down * (1 - down) / prob
        g = np.zeros_like(p)
        g[:width] = np.bincount(col, val * (du - dd)[row], width) / n + l2 * p[:width]
        gt = (-np.bincount(np.minimum(y, k - 1), du * (y < k), k) + np.bincount(np.maximum(y - 1, 0), dd * (y > 0), k)) / n
        g[width] = gt.sum()
        g[width + 1 :] = [gt[j:].sum() * np.exp(p[width + j]) for j in range(1, k)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:width], p[width] + np.concatenate(([0], np.cumsum(np.exp(p[width + 1 :]))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0))
    s = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    rated = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    drawn = [rated.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    drawn = s.cut(drawn[0].union(drawn[1]), "drawn", True)
    # At most 2 * sample rows go to every executor.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["text", "y"])
    texts = s.cut(texts.select("doc_id", "y", "text"), "sample")
    size = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(size) < 2:
        s.clear()
        return none
    a, b = size[1], size[0]
    seen = texts.select("y", "text").mapInArrow(_distinct, "y int, keys array<long>").select("y", F.explode("keys").alias("key"))
    got = seen.groupBy("key").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where("n >= 3")
    odds = F.log((F.col("p") + 0.5) / (a - F.col("p") + 0.5)) - F.log((F.col("n") - F.col("p") + 0.5) / (b - F.col("n") + F.col("p") + 0.5))
    dev = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    best = got.withColumn("odds", odds).withColumn("z", F.abs(odds) / dev).where("abs(odds) >= 1.5 and z >= 2")
    rows = best.orderBy(F.desc("z"), "key").limit(features).collect()
    if not rows:
        s.clear()
        return none
    table = sorted((r["key"] & (2**64 - 1), r["odds"]) for r in rows)
    keys = np.array([k for k, _ in table], np.uint64)
    sign = np.array([o > 0 for _, o in table])
    found = texts.mapInArrow(_sparse(keys), "doc_id long, y int, f array<int>, c array<int>").toArrow().sort_by("doc_id")
    s.clear()
    y, f, c = found["y"].to_numpy(), found["f"].to_pylist(), found["c"].to_pylist()
    row = np.repeat(np.arange(len(y)), [len(x) for x in f])
    col, count = np.array([k for x in f for k in x], np.int64), np.array([k for x in c for k in x], np.float64)
    used = cover(row, col, y, len(keys))
    new = np.full(len(keys), -1)
    new[used] = np.arange(len(used))
    on = new[col] >= 0
    keys, sign, row, col, count = keys[used], sign[used], row[on], new[col[on]], count[on]
    proof = np.bincount(row, count * sign[col], len(y))
    third = np.quantile(proof[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(third, proof, "left"), 0).astype(np.int64)
    weights, thresholds = fit_ordinal(row, col, np.log1p(count), grade, len(keys))
    return Model(keys, weights, thresholds)


def _score(model: Model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.slots()
        for b in batches:
            s = np.zeros(b.num_rows)
            for lo, rows, row, at, count in _counts(b.column(1), model.keys, slots):
                s[lo : lo + rows] = np.bincount(row, np.log1p(count) * (model.weights[at] if len(at) else 0), rows)
            above = 1 - _logistic(model.thresholds[None, :] - s[:, None])
            grades = np.concatenate((np.ones((len(s), 1)), above), axis=1) - np.concatenate((above, np.zeros((len(s), 1))), axis=1)
            cols = [pa.array(np.round(above.sum(1), 6)), pa.array(np.argmax(grades, axis=1).astype(np.int32)), pa.array(np.round(above[:, 0], 6)), pa.array(above[:, 0] >= cut)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, *range(2, b.num_columns))), *cols], [*(b.schema.names[k] for k in (0, *range(2, b.num_columns))), "severity", "grade", "p_toxic", "is_toxic"])

    return run


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, is_toxic) of every row."""
    schema = "doc_id long, severity double, grade int, p_toxic double, is_toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(model, cut), schema)


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of docs that are not toxic, columns as they are, in one pass without a shuffle."""

    rows, names = aside(docs)
    at = list(names).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(at)], ["doc_id", "text"])
            for out in _score(model, cut)([pair]):
                yield b.filter(pc.invert(out.column("is_toxic")))

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
