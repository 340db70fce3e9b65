"""Vectorised words and shingles of whole texts over Arrow string buffers.

A word is a run of bytes other than space and 09-0D; A-Z are lower-cased. Words get 64-bit hashes by a
random-table polynomial, so a chunk costs a few numpy passes and no Python object for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_TAB = _RNG.integers(1, 2**64, 256, dtype=np.uint64)[_LOW]
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULT = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, r in enumerate((_R, _RINV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    out = _POW[0][:n], _POW[1][:n]
    if n > 8 * CHUNK:  # a very long text leaves no tables behind
        _POW[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return out


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about `most` bytes; a longer text is a run of its own. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    large = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(
    data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _WS, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word of a chunk. apart: the bytes between words. heads: for each of these
    lengths, the hashes of the words' first bytes follow in the first array, word by word as before."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    ws = apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = edge[:n].copy(), edge[1:].copy()
    first[1:] |= ws[:-1]
    last[:-1] |= ws[1:]
    s, e = np.flatnonzero(first & ~ws), np.flatnonzero(last & ~ws) + 1
    pw, inv = _powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_TAB[data] * pw, out=c[1:])
    h = mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if heads:
        cut = [np.minimum(s + k, e) for k in heads]
        parts = [mix((c[x] - c[s]) * inv[s] + np.uint64(0xA0761D6478BD642F * k % 2**64)) for x, k in zip(cut, heads, strict=True)]
        h = np.concatenate((h, *parts))
    return h, s, e, np.searchsorted(offs, s, "right") - 1


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles); a shorter text is one shingle, no words none."""
    for lo, data, offs in chunks(texts):
        h, _, _, row = words(data, offs)
        rows = len(offs) - 1
        at = np.searchsorted(row, np.arange(rows + 1))
        if len(h) >= k:
            g = h[: len(h) - k + 1] * _MULT[0]
            for j in range(1, k):
                g += h[j : len(h) - k + 1 + j] * _MULT[j]
            g = mix(g)
        for r in range(rows):
            a, b = at[r], at[r + 1]
            if b - a >= k:
                x = np.sort(g[a : b - k + 1])
                yield lo + r, x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x
            elif b > a:
                yield lo + r, mix(np.array([(h[a:b] * _MULT[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield lo + r, np.zeros(0, np.uint64)


def spanning(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of rows 0..count-1 as edges: near(i, rows) tells which of the rows are neighbours of i. Rows that
    were reached are not looked at again, so no pairs within a group are listed."""
    left, a, b = np.arange(count), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            got = left[hit]
            a.append(np.full(len(got), i))
            b.append(got)
            queue += got.tolist()
            left = left[~hit]
    return np.concatenate(a), np.concatenate(b)


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], cols: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(values of by, columns) of each run of rows that agree on `by`, over the bounds of batches; by holds integers."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            name = tuple(int(k[lo]) for k in keys)
            if name != at and held:
                yield at, [pa.concat_arrays([h[c] for h in held]) for c in range(len(cols))]
                held = []
            at = name
            held.append([batch.column(c).slice(lo, hi - lo) for c in cols])
    if held:
        yield at, [pa.concat_arrays([h[c] for h in held]) for c in range(len(cols))]
