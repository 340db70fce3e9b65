"""Hierarchical multi-length packing of tokenised documents.

A document is its token ids and an end id. Whole windows of the longest tier leave at once; what remains is
routed to the shortest tier (powers of two) that holds it. Each tier is packed from the longest down: a window
takes one document of its tier, its gap takes the largest pieces of shorter tiers that fit, and the head of one
more piece closes the gap. What is left at a task's end goes to windows of powers of two, so all are full. Finished windows
are dealt to step groups of near equal token counts, largest window to lightest step.

Packing is local to a task: no shuffle, no driver, one buffer of bounded size; a task that is run again gives
the same rows. Defined cases: null text is empty (one end id); rows that repeat a document are packed each;
doc_id may be null; other columns are ignored; an empty table gives no rows; a very long text is encoded in one piece and
leaves as whole windows at once, so that a task holds its ids, four bytes each, once.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import small_batches
from netlens.llm.kernel import chunks

TIERS = (2048, 1024, 512, 256)
BUFFER = 1 << 18
STEP_TOKENS = 16 * 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file. Texts of Latin script take a faster reader of the same
    vocabulary, which gives equal ids; all others, and very long unbroken runs, take the tokenizers library."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        ranks = ranks or (public_tokenizers.path("byte_bpe_50k.tiktoken") if path is None else None)
        self.slow = self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        strings = texts.to_pylist()
        if self.fast is None:
            yield from (self._exact(t or "") for t in strings)
            return
        for lo, data, offs in chunks(texts, 1 << 20):
            odd = np.zeros(len(offs) - 1, bool)
            odd[np.searchsorted(offs, np.flatnonzero(data >= 0xC9), "right") - 1] = True
            gap = np.flatnonzero(np.concatenate(([True], data <= 32, [True])))
            odd[np.searchsorted(offs, gap[:-1][np.diff(gap) > 1000], "right").clip(1, len(odd)) - 1] = True
            for r in range(len(offs) - 1):
                text = strings[lo + r] or ""
                if odd[r] or "<|" in text:
                    yield self._exact(text)
                else:
                    yield np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


class Packer:
    """Packs the documents of one task. Items are [ids, first, last, doc_id, doc_tokens]."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.base = tiers, task << 33
        self.pool: list[list[tuple]] = [[] for _ in tiers]
        self.held = self.count = self.serial = self.steps = 0
        self.done: list[tuple[int, list[tuple]]] = []

    def _route(self, item: list) -> None:
        length = item[2] - item[1]
        if length:
            tier = max(k for k, w in enumerate(self.tiers) if length <= w)
            self.serial += 1
            insort(self.pool[tier], (length, self.serial, item))
            self.held += length

    def add(self, ids: np.ndarray, doc_id: int | None) -> None:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            self._close(top, [(ids, at, at + top, doc_id, len(ids))])
            at += top
        self._route([ids, at, len(ids), doc_id, len(ids)])

    def _close(self, tier: int, parts: list[tuple]) -> None:
        self.done.append((tier, parts))

    def _take(self, tier: int, at: int) -> list:
        length, _, item = self.pool[tier].pop(at)
        self.held -= length
        return item

    def _fill(self, gap: int, below: int, own: int) -> list[tuple]:
        """Pieces that close the gap exactly: whole ones of shorter tiers, then the head of one or more others."""
        parts = []
        for tier in range(below, len(self.tiers)):
            while gap and (k := bisect_right(self.pool[tier], (gap, float("inf")))):
                item = self._take(tier, k - 1)
                gap -= item[2] - item[1]
                parts.append(tuple(item))
        while gap:
            tier = next((t for t in range(len(self.tiers) - 1, own - 1, -1) if self.pool[t]), None)
            tier = next(t for t in range(len(self.tiers)) if self.pool[t]) if tier is None else tier
            item = self._take(tier, len(self.pool[tier]) - 1)
            cut = min(gap, item[2] - item[1])
            parts.append((item[0], item[1], item[1] + cut, item[3], item[4]))
            gap -= cut
            self._route([item[0], item[1] + cut, *item[2:]])
        return parts

    def pack(self) -> None:
        """Full windows of every tier, as long as its documents and what fills their gaps last."""
        for tier, width in enumerate(self.tiers):
            while self.pool[tier] and self.held >= width:
                item = self._take(tier, len(self.pool[tier]) - 1)
                self._close(width, [tuple(item), *self._fill(width - (item[2] - item[1]), tier + 1, tier)])

    def flush(self) -> None:
        """What is left becomes windows of powers of two, down to one token, so that nothing is padded."""
        self.pack()
        width = self.tiers[0]
        while self.held:
            while width > self.held:
                width //= 2
            self._close(width, self._fill(width, len(self.tiers), 0))

    def rows(self) -> Iterator[tuple]:
        """Pieces of the finished windows with their sequence, offset and step group."""
        total = sum(w for w, _ in self.done)
        steps = max(1, round(total / STEP_TOKENS))
        heap = [(0, k) for k in range(steps)]
        for tier, parts in sorted(self.done, key=lambda x: -x[0]):
            load, step = heapq.heappop(heap)
            heapq.heappush(heap, (load + tier, step))
            at = 0
            for ids, lo, hi, doc_id, tokens in parts:
                yield ids[lo:hi], doc_id, lo, tokens, self.base + self.count, at, tier, self.base + self.steps + step
                at += hi - lo
            self.count += 1
        self.steps += steps
        self.done = []


def _pack(path: str | None, ranks: str | None, tiers: tuple[int, ...], with_ids: bool):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, doc, lo, tokens, seq, at, tier, step = zip(*rows, strict=True)
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        cols = [doc, lo, [len(x) for x in ids], crc, tokens, seq, at]
        arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(tier, pa.int32()), pa.array(step, pa.int64())]
        names = re.findall(r"(\w+) (?:long|int)", SCHEMA)
        if with_ids:
            cut = np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(cut, pa.array(np.concatenate(ids).astype(np.int32))))
            names = [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encoder, end = Packer(TaskContext.get().partitionId(), tiers), None, np.array([END_ID], np.uint32)
        for b in batches:
            encoder = encoder or Encoder(path, ranks)
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                packer.add(np.concatenate((ids, end)), doc_id)
                if packer.held >= BUFFER:
                    packer.pack()
                if len(packer.done) >= 512 and (rows := list(packer.rows())):
                    yield batch(rows)
        packer.flush()
        if rows := list(packer.rows()):
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; with_ids adds the piece's token ids. tokenizer: a tokenizers file,
    the public byte-level BPE by default."""
    small_batches(docs.sparkSession)
    schema = SCHEMA + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(tokenizer, ranks, tiers, with_ids), schema)
