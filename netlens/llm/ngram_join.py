"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Rows are distinct shingle sets, columns are shingle hashes. Columns are cut into blocks by hash range and
rows into bands by set size. A pair whose overlap meets the bound that its sizes give differs in at most
(1-t)/(1+t) * (n1+n2) columns, so, cut into one block more than that, the two rows agree on a whole block;
rows that agree on no block are discarded without being multiplied. Of rows that agree on one, those whose column
parities differ in more places than the bound allows are told apart too. Rows that still hang together form candidate
groups; each group's rows are multiplied block by block of columns, overlap counts add up, and pairs below the bound
are discarded. Blocks that one row only has are dropped by partial aggregates before any list is made; lists and groups
of many rows are dealt out as pairs of row blocks of bounded size, and neither step emits pairs.
The result is exact up to collisions of 64-bit hashes; a linked pair is never missed.

Defined cases: a null or empty text has the empty set and links with nothing; a text of fewer words than a
shingle is one shingle; equal sets are one row of the matrix, so copies and repeated rows cost nothing; rows are known by
doc_id and text, so a doc_id may repeat with other texts or be null, and a null one is larger than all others; other
columns of the input are ignored; an empty table gives an empty table. A very long text is hashed in one piece and takes
about forty times its size in the task that does it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import Scratch, aside, bounded, connected_components, small_batches
from netlens.llm.kernel import grouped, mix, shingle_sets, spanning

#: Shingle hashes that one block of rows of a large group holds.
BLOCK = 1_000_000
#: Columns that are multiplied at once.
COLUMNS = 4096
#: Rows, and their columns, that one block of rows of a long list holds.
ROWS, LOAD = 2048, 1 << 25
#: Sets that a task remembers.
SEEN = 1 << 20


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, each about 1.3 times the one below."""
    lo = [1]
    while lo[-1] <= most:
        lo.append(max(lo[-1] + 1, int(lo[-1] * 1.3)))
    return np.array(lo, np.int64)


@lru_cache(maxsize=4096)
def plan(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(column blocks, empty blocks allowed) for rows of lo to hi columns. Linked rows differ in at most `most` columns
    and so agree on all blocks but that many; the blocks beyond are more than a row usually has empty ones, so that
    they agree on one that isn't empty."""
    most = (den - num) * 2 * hi // (den + num)
    for spare in range(most + 16):
        k = most + 1 + spare
        none = np.exp(-lo / k)
        if k * none + 3 * np.sqrt(k * none * (1 - (1 + lo / k) * none)) <= spare + 0.5:
            break
    return k, spare


def block_keys(x: np.ndarray, num: int, den: int, lo: np.ndarray) -> np.ndarray:
    """One key for each column block of the row x, in its own band and in larger ones that it can have partners in.
    Empty blocks count only in a row that has more of them than its band allows; two such rows meet there."""
    n, out = len(x), []
    band = int(np.searchsorted(lo, n, "right")) - 1
    high, values = x >> np.uint64(32), mix(x)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    while band + 1 < len(lo) and (lo[band] <= n or n * den >= num * lo[band]):
        k, spare = plan(-(-int(lo[band]) * num // den), int(lo[band + 1] - 1), num, den)
        cut = np.searchsorted(high * np.uint64(k) >> np.uint64(32), np.arange(k + 1, dtype=np.uint64))
        part = total[cut[1:]] - total[cut[:-1]]
        keys = mix(part + mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 32)))
        full = cut[1:] > cut[:-1]
        out.append(keys if k - int(full.sum()) > spare else keys[full])
        band += 1
    return np.concatenate(out)


def _rows(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, seen = bands(1 << 16), set()
        for batch in batches:
            ns, nodes, keys, marks = [], [], [], []
            for _, x in shingle_sets(batch.column(1), k):
                if len(x) >= lo[-2]:
                    lo = bands(2 * len(x))
                ns.append(len(x))
                nodes.append(mix(np.array([np.add.reduce(mix(x)) + np.uint64(len(x))], np.uint64)).view(np.int64)[0])
                # Copies of a set within a task add no keys; what is remembered of a task is bounded.
                new = len(x) and nodes[-1] not in seen
                keys.append(block_keys(x, num, den, lo).view(np.int64) if new else np.zeros(0, np.int64))
                seen = seen if len(seen) < SEEN else set()
                seen.add(nodes[-1])
                marks.append(parity(x))
            at = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(flat)), pa.array(marks, pa.binary())],
                ["doc_id", "text_hash", "n", "node", "keys", "marks"],
            )

    return run


def parity(x: np.ndarray) -> bytes:
    """Parities of the counts of columns by their low bits, about as many places as there are columns."""
    size = 1 << max(8, (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _meet(num: int, den: int):
    """Rows (key, i, j, node, n, marks, b) sorted by (key, i, j) to edges (a, b), a spanning forest of the rows of a list
    which can be linked: a pair's parities differ in no more places than its columns do. i and j other than each other:
    only rows of different blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cols in grouped(batches, ("key", "i", "j"), ("node", "n", "b", "marks")):
            nodes, n, side = (c.to_numpy() for c in cols[:3])
            if len(nodes) < 2:
                continue
            words = [np.frombuffer(m, np.uint64) for m in cols[3].to_pylist()]
            least = min(map(len, words))
            table = np.stack([np.bitwise_xor.reduce(m.reshape(-1, least), axis=0) for m in words])

            def near(k: int, left: np.ndarray) -> np.ndarray:
                ok = np.bitwise_count(table[left] ^ table[k]).sum(1) <= (den - num) * (n[left] + n[k]) // (den + num)
                return ok & (side[left] != side[k]) if i != j else ok

            a, b = spanning(len(nodes), near)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return run


def blocks_of(count: Column, most: int) -> Column:
    """Blocks of `most` rows."""
    return F.ceil(count / most).cast("int")


def dealt(rows: DataFrame, by: str, node: str = "node", *also: str) -> DataFrame:
    """Rows with the number of blocks of their list or group, once for each pair of blocks that theirs is in."""
    rows = rows.withColumn("b", F.pmod(F.xxhash64(node), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o")).drop("o", "blocks")
    return rows.repartition(by, *also, "i", "j").sortWithinPartitions(by, *also, "i", "j")


def candidate_edges(some: DataFrame, reps: DataFrame, num: int, den: int, s: Scratch) -> DataFrame:
    """(a, b): edges whose components are the candidate groups."""
    posts = some.select("node", "n", F.explode("keys").alias("key"))
    keys = posts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    lists = s.cut(posts.join(bounded(s.cut(keys.select("key"), "keys", True, True)), "key").distinct(), "lists")
    # Lists of the same rows, by their number and a sum of hashes, are compared once.
    looks = lists.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("low"), F.sum("n").alias("load"))
    looks = looks.groupBy("m", "x", "low", "load").agg(F.min("key").alias("key"))
    looks = looks.select("key", F.greatest(blocks_of(F.col("m"), ROWS), F.ceil(F.col("load") / LOAD).cast("int")).alias("blocks"))
    rows = lists.join(bounded(s.cut(looks, "looks", True)), "key").join(reps.select("node", "marks"), "node")
    return dealt(rows, "key").mapInArrow(_meet(num, den), "a long, b long")


def _sets(k: int):
    """Rows (node, grp, blocks, text) to (node, grp, blocks, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for _, x in shingle_sets(batch.column("text"), k)]
            kept = [batch.column(c) for c in ("node", "grp", "blocks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], ["node", "grp", "blocks", "hashes"])

    return run


def overlap_links(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows (left, right) of one group; side: only pairs of different sides count."""
    n = np.array([len(x) for x in sets], np.int64)
    live = np.arange(len(sets))
    cols = np.concatenate(sets)
    row = np.repeat(live, n)
    for _ in range(3):  # columns of a single row add nothing; rows left with too few columns reach no bound
        order = np.argsort(cols, kind="stable")
        cols, row = cols[order], row[order]
        new = np.concatenate(([True], cols[1:] != cols[:-1])) if len(cols) else np.zeros(0, bool)
        code = np.cumsum(new) - 1
        shared = np.bincount(code)[code] > 1 if len(cols) else new
        cols, row = cols[shared], row[shared]
        able = np.bincount(row, minlength=len(sets)) * den >= n * num
        if able[row].all():
            break
        cols, row = cols[able[row]], row[able[row]]
    live = np.flatnonzero(np.bincount(row, minlength=len(sets)) * den >= n * num) if len(row) else live[:0]
    if len(live) < 2:
        return live[:0], live[:0]
    place = np.full(len(sets), -1)
    place[live] = np.arange(len(live))
    on = place[row] >= 0
    cols, row = cols[on], place[row[on]]
    code = np.cumsum(np.concatenate(([True], cols[1:] != cols[:-1]))) - 1
    width, found = int(code[-1]) + 1, []
    size = n[live]
    step = max(1, min(len(live), (1 << 22) // len(live)))
    marks = np.searchsorted(code, np.arange(0, width + COLUMNS, COLUMNS))
    for a in range(0, len(live), step):
        b = min(a + step, len(live))
        got = np.zeros((b - a, len(live)), np.float32)
        for c in range(len(marks) - 1):
            r, m = row[marks[c] : marks[c + 1]], code[marks[c] : marks[c + 1]] - c * COLUMNS
            for p in range(0, len(live), 2048):
                own = (r >= p) & (r < p + 2048)
                right = np.zeros((min(2048, len(live) - p), COLUMNS), np.float32)
                right[r[own] - p, m[own]] = 1
                mine = (r >= a) & (r < b)
                left = np.zeros((b - a, COLUMNS), np.float32)
                left[r[mine] - a, m[mine]] = 1
                got[:, p : p + len(right)] += left @ right.T
        hit = got.astype(np.int64)
        ok = hit * den >= num * (size[a:b, None] + size[None, :] - hit)
        if side is not None:
            ok &= side[live][a:b, None] != side[live][None, :]
        x, y = np.nonzero(ok)
        x += a
        found.append((live[x[x != y]], live[y[x != y]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def forest(count: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected with."""
    root = np.arange(count)
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _multiply(num: int, den: int):
    """Rows sorted by (grp, i, j) to edges (a, b): each row of a group with the root of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cols in grouped(batches, ("grp", "i", "j"), ("node", "b", "hashes")):
            ids, first = np.unique(cols[0].to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            rows = [np.frombuffer(x, np.uint64) for x in cols[2].take(pa.array(first)).to_pylist()]
            root = forest(len(ids), *overlap_links(rows, cols[1].to_numpy()[first] if i != j else None, num, den))
            moved = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    return run


def ngram_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), scratch: Scratch | None = None, with_hash: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row of docs: component_id is the smallest doc_id reachable
    by links of Jaccard similarity of k-word shingle sets at least threshold (a fraction). with_hash adds component_hash,
    the text_hash of the component's least row."""
    num, den = threshold
    spark = docs.sparkSession
    s = scratch or Scratch(spark)
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = s.cut(hashed.mapInArrow(_rows(k, num, den), "doc_id long, text_hash long, n long, node long, keys array<long>, marks binary"), "rows")
    some = rows.where("n > 0")
    # The least row of a set by (doc_id, text_hash), null ids last.
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = s.cut(some.groupBy("node").agg(F.min(rep).alias("rep"), F.max("n").alias("n"), F.first("marks").alias("marks")), "reps")
    edges = candidate_edges(some, reps, num, den, s)
    groups = connected_components(edges, s)
    members = groups.select("node", F.col("root").alias("grp")).join(reps.select("node", "rep", "n"), "node")
    load = members.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK).cast("int"), blocks_of(F.count("*"), ROWS)).alias("blocks"))
    members = members.join(load, "grp").select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "grp", "blocks")
    members = s.cut(members, "members", True)
    same = hashed["doc_id"].eqNullSafe(F.col("rep")) & (hashed["text_hash"] == F.col("rep_hash"))
    got = hashed.join(bounded(members), same).select("node", "grp", "blocks", "text").mapInArrow(_sets(k), "node long, grp long, blocks int, hashes binary")
    links = dealt(got, "grp").mapInArrow(_multiply(num, den), "a long, b long")
    comp = connected_components(links, s).join(reps.select("node", "rep"), "node")
    least = comp.groupBy("root").agg(F.min("rep").alias("least"))
    linked = comp.join(least, "root").select("node", "least")
    named = reps.select("node", F.col("rep").alias("own")).join(linked, "node", "left").select("node", F.coalesce("least", "own").alias("rep"))
    named = s.cut(named.select("node", F.col("rep.doc_id").alias("component_id"), F.col("rep.text_hash").alias("component_hash")), "named", True)
    ids = ("doc_id", "text_hash", F.col("n").alias("n_shingles"))
    out = some.select("doc_id", "text_hash", "n", "node").join(named, "node").select(*ids, "component_id", "component_hash")
    out = out.unionByName(rows.where("n = 0").select(*ids, F.col("doc_id").alias("component_id"), F.col("text_hash").alias("component_hash")))
    return s.finish(out if with_hash else out.drop("component_hash"))


def keep_first(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest (doc_id, text_hash). Of rows that repeat doc_id and text, one."""
    found = ngram_components(docs, k, threshold, with_hash=True).where("doc_id <=> component_id and text_hash <=> component_hash")
    kept = Scratch(docs.sparkSession).keep(found.groupBy("doc_id", "text_hash").count())
    repeated = kept.where("count > 1").limit(1).count()
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    rows, names = aside(docs)
    same = F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.col(names["text"]).cast("string")) == F.col("_t"))
    out = rows.join(bounded(kept), same, "left_semi")
    return (out.dropDuplicates([names["doc_id"], names["text"]]) if repeated else out).toDF(*docs.columns)
