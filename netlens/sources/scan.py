"""Scans of a database as arrays and Arrow batches."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netlens import kinds as K
from netlens.codec import Database, compile_schema, to_variant
from netlens.functions.ipfns import network_text, v6_text, words_binary
from netlens.kinds import InvalidDatabaseError, NetDbError

BATCH = 4096
#: Nodes of a tree from which on a scan expands it piece by piece.
LARGE = 1 << 14
NETWORK_COLUMNS = (
    "network string, network_v4 string, network_v6 string, family int, prefix_len int, depth int, net_start binary, net_end binary, "
    "v4_start long, v4_end long, hi long, lo long, record_offset long, error string"
)


def v4_networks(n: np.ndarray, depth: np.ndarray, v4_depth: int, live: np.ndarray) -> pa.Array:
    """Texts of networks as IPv4 sees them, null where not live; a leaf above the IPv4 subtree is a network of ::."""
    part = [pc.cast(pa.array(n >> k & 255), pa.string()) for k in (24, 16, 8, 0)]
    length = pc.cast(pa.array(depth - v4_depth), pa.string())
    text = pc.binary_join_element_wise(pc.binary_join_element_wise(*part, "."), length, "/")
    above = pc.binary_join_element_wise("::", pc.cast(pa.array(depth), pa.string()), "/")
    return pc.if_else(pa.array(live), pc.if_else(pa.array(depth < v4_depth), above, text), pa.scalar(None, pa.string()))


@dataclass(frozen=True)
class Options:
    within: str | None = None
    aliased: bool = False
    empty: bool = False
    skip_empty_values: bool = False
    permissive: bool = False
    remember: bool = True


@dataclass
class Leaves:
    """Leaves of a scan in address order."""

    pointer: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    depth: np.ndarray

    def take(self, at: np.ndarray) -> Leaves:
        return Leaves(self.pointer[at], self.hi[at], self.lo[at], self.depth[at])

    def ordered(self) -> Leaves:
        return self.take(np.lexsort((self.depth, self.lo, self.hi)))

    def __len__(self) -> int:
        return len(self.pointer)


def start_nodes(db: Database, within: str | None) -> Leaves:
    """Where a scan begins: the root, or what the prefix leads to. Host bits of the prefix don't count; a prefix
    inside a network leads to that network."""
    u = lambda x: np.array([x], np.uint64)
    v4_only = db.metadata.ip_version == 4
    if within is None:
        return Leaves(np.zeros(1, np.int64), u(0), u(0), np.array([96 if v4_only else 0]))
    try:
        net = ipaddress.ip_network(within, strict=False)
    except ValueError as e:
        raise ValueError("invalid prefix") from e
    if v4_only and net.version == 6:
        raise ValueError(f"error getting networks with '{within}': you attempted to use an IPv6 network in an IPv4-only database")
    n = int(net.network_address)
    hi, lo = u(n >> 64), u(n & (1 << 64) - 1)
    node, depth = db.walk(hi, lo, np.array([net.version == 4]), np.array([net.prefixlen + (96 if net.version == 4 else 0)]))
    mask = ((1 << 128) - 1) ^ ((1 << (128 - int(depth[0]))) - 1)
    n &= mask
    return Leaves(node, u(n >> 64), u(n & (1 << 64) - 1), depth)


def split(db: Database, start: Leaves, options: Options, levels: int, most: int = 256) -> tuple[Leaves, np.ndarray]:
    """Subtrees `levels` below the start, in address order, leaves on the way among them, and how many leaves each has.
    Those with more than an equal share of the whole for `most` tasks are split on, wherever in the tree networks crowd."""
    done, count, share = [], [], 0
    now = Leaves(*db.expand(start.pointer, start.hi, start.lo, int(start.depth[0]), options.aliased, min(128, int(start.depth[0]) + levels)))
    while len(now):
        n = np.ones(len(now), np.int64)
        depth = int(now.depth.max())
        open_ = np.flatnonzero((now.pointer < db.metadata.node_count) & (now.depth == depth)) if depth < 128 else np.zeros(0, np.int64)
        n[open_] = leaf_counts(db, now.take(open_), options)
        share = share or max(BATCH, int(n.sum()) // most)
        heavy = open_[n[open_] > share]
        light = np.delete(np.arange(len(now)), heavy)
        done.append(now.take(light))
        count.append(n[light])
        now = now.take(heavy)
        if len(now):
            now = Leaves(*db.expand(now.pointer, now.hi, now.lo, depth, options.aliased, min(128, depth + 6)))
    parts = Leaves(*(np.concatenate([getattr(x, f) for x in done]) for f in ("pointer", "hi", "lo", "depth"))) if done else now
    weights = np.concatenate(count) if count else np.zeros(0, np.int64)
    order = np.lexsort((parts.depth, parts.lo, parts.hi))
    if not options.empty:
        order = order[parts.pointer[order] != db.metadata.node_count]
    return parts.take(order), weights[order]


def leaf_counts(db: Database, start: Leaves, options: Options) -> np.ndarray:
    """How many leaves lie below each of some nodes of one depth. Only weighs tasks, so a tree that is wider than its nodes
    allow, which is corrupt, is not followed to its end."""
    out = np.zeros(len(start), np.int64)
    left, right = db.tree
    n, skip = db.metadata.node_count, bool(not options.aliased and db.v4_start)
    node, hi, lo, of = start.pointer, start.hi, start.lo, np.arange(len(start))
    for depth in range(int(start.depth[0]) if len(start) else 128, 129):
        if skip:
            keep = (node != db.v4_start) | ((hi == 0) & (lo >> np.uint64(32) == 0)) | (node == n)
            node, hi, lo, of = node[keep], hi[keep], lo[keep], of[keep]
        open_ = node < n if depth < 128 else np.zeros(len(node), bool)
        out += np.bincount(of[~open_ & ((node != n) | options.empty)], minlength=len(out))
        node, of = node[open_], of[open_]
        if not len(node) or len(node) > 4 * n:
            break
        if skip:
            hi, lo, bit = hi[open_], lo[open_], np.uint64(1 << (63 - depth % 64))
            rh, rl = (hi | bit, lo) if depth < 64 else (hi, lo | bit)
            hi, lo = np.concatenate((hi, rh)), np.concatenate((lo, rl))
        node, of = np.concatenate((left[node], right[node])).astype(np.int64), np.concatenate((of, of))
    return np.maximum(out, 1)


def leaves(db: Database, start: Leaves, options: Options) -> Leaves:
    """All leaves below nodes of one depth, in address order, without those that the options hide."""
    out = Leaves(*db.expand(start.pointer, start.hi, start.lo, int(start.depth[0]), options.aliased)).ordered()
    n = db.metadata.node_count
    if not options.empty:
        out = out.take(np.flatnonzero(out.pointer != n))
    return out


def leaf_runs(db: Database, start: Leaves, options: Options, levels: int = 12, run: int = 64) -> Iterator[Leaves]:
    """The same leaves in the same order, some subtrees at a time, so that who stops early pays for what was read."""
    until = min(128, int(start.depth[0]) + levels)
    if db.metadata.node_count < LARGE or until == 128:
        yield leaves(db, start, options)
        return
    n = db.metadata.node_count
    parts = Leaves(*db.expand(start.pointer, start.hi, start.lo, int(start.depth[0]), options.aliased, until)).ordered()
    for lo in range(0, len(parts), run):
        some = parts.take(np.arange(lo, min(lo + run, len(parts))))
        deep = (some.pointer < n) & (some.depth == until)
        shut, open_ = some.take(np.flatnonzero(~deep)), some.take(np.flatnonzero(deep))
        below = Leaves(*db.expand(open_.pointer, open_.hi, open_.lo, until, options.aliased)) if len(open_) else open_
        both = Leaves(*(np.concatenate((getattr(shut, f), getattr(below, f))) for f in ("pointer", "hi", "lo", "depth"))).ordered()
        yield both if options.empty else both.take(np.flatnonzero(both.pointer != n))


def network_batch(db: Database, part: Leaves, options: Options) -> tuple[dict[str, pa.Array], list[int | None], list[str | None]]:
    """Columns of some leaves, their data offsets and errors."""
    n, v4_depth = db.metadata.node_count, db.v4_depth if db.has_v4 else 96
    at, inside = db.data_offset(part.pointer)
    data, node = part.pointer > n, part.pointer < n
    offset = pa.array(at, pa.int64(), mask=~(data & inside))
    errors: list[str | None] = [None] * len(part)
    v4 = (part.hi == 0) & (part.lo >> np.uint64(32) == 0)
    plain = v4 & (part.depth >= v4_depth)
    hi, lo, depth = part.hi.tolist(), part.lo.tolist(), part.depth.tolist()
    text6 = pa.array([f"{v6_text(h, x)}/{d}" for h, x, d in zip(hi, lo, depth, strict=True)], pa.string())
    text4 = v4_networks((part.lo & np.uint64(0xFFFFFFFF)).astype(np.int64), part.depth, v4_depth, v4)
    shown = pc.coalesce(text4, text6)
    for k in np.flatnonzero(data & ~inside).tolist():
        errors[k] = "the database file's search tree is corrupt"
    for k in np.flatnonzero(node).tolist():
        errors[k] = f"invalid search tree at {shown[k]}"
    below = 128 - part.depth
    low_mask = np.where(below >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(below, 63).astype(np.uint64)) - np.uint64(1))
    high_mask = np.where(below <= 64, np.uint64(0), np.where(below >= 128, np.uint64(2**64 - 1), (np.uint64(1) << np.clip(below - 64, 0, 63).astype(np.uint64)) - np.uint64(1)))
    end_hi, end_lo = part.hi | high_mask, part.lo | low_mask
    mask = ~plain
    cols = {
        "network": shown, "network_v4": text4, "network_v6": text6, "family": pa.array(np.where(plain, 4, 6).astype(np.int32)),
        "prefix_len": pa.array(np.where(plain, part.depth - v4_depth, part.depth).astype(np.int32)), "depth": pa.array(part.depth.astype(np.int32)),
        "net_start": words_binary(part.hi, part.lo), "net_end": words_binary(end_hi, end_lo),
        "v4_start": pa.array((part.lo & np.uint64(0xFFFFFFFF)).astype(np.int64), mask=mask), "v4_end": pa.array((end_lo & np.uint64(0xFFFFFFFF)).astype(np.int64), mask=mask),
        "hi": pa.array(part.hi.view(np.int64)), "lo": pa.array(part.lo.view(np.int64)), "record_offset": offset, "error": pa.array(errors, pa.string()),
    }
    offsets = offset.to_pylist()
    return cols, offsets, errors


class Records:
    """Decodes records by offset, each once while it is remembered."""

    MOST = 65_536

    def __init__(self, db: Database, kind, decoders: dict | None = None, remember: bool = True):
        self.db, self.kind, self.memo, self.most = db, kind, {}, self.MOST if remember else 1
        self.step = None if kind is None else compile_schema(kind, db.values, None, decoders)

    def get(self, offset: int | None) -> tuple[object, str | None]:
        """(record, error)."""
        if offset is None or self.step is None:
            return None, None
        if offset not in self.memo:
            if len(self.memo) >= self.most:
                self.memo.clear()
            try:
                self.memo[offset] = self.db.values.record(offset, self.step), None
            except NetDbError as e:
                self.memo[offset] = None, str(e)
        return self.memo[offset]


def arrow_type(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def as_dicts(value: object, kind) -> object:
    """Tuples of struct values as dicts and maps as pairs, as Arrow wants them."""
    from pyspark.sql import types as T

    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: as_dicts(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
    if isinstance(kind, T.ArrayType):
        return [as_dicts(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(k, as_dicts(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.VariantType):
        return {"value": value.value, "metadata": value.metadata}
    return value


def _as_arrow(kind):
    """as_dicts for one type, made once; None where values stay as they are."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        names, inner = kind.fieldNames(), [(k, f) for k, f in enumerate(map(_as_arrow, (x.dataType for x in kind.fields))) if f]

        def struct(v: tuple | None) -> dict | None:
            if v is None:
                return None
            if inner:
                v = list(v)
                for k, f in inner:
                    v[k] = f(v[k])
            return dict(zip(names, v, strict=True))

        return struct
    if isinstance(kind, T.ArrayType):
        one = _as_arrow(kind.elementType)
        return one and (lambda v: None if v is None else [one(x) for x in v])
    return (lambda v: as_dicts(v, kind)) if isinstance(kind, T.MapType | T.VariantType) else None


def record_array(values: list, kind) -> pa.Array:
    """Decoded values of one type as Arrow."""
    one = _as_arrow(kind)
    return pa.array([one(v) for v in values] if one else values, arrow_type(kind))


def subtree_runs(db: Database, nodes: Leaves, options: Options) -> Iterator[Leaves]:
    """The leaves below nodes of any depths that are given in address order, some nodes at a time."""
    if len(nodes) == 1:
        yield from leaf_runs(db, nodes, options)
        return
    for lo in range(0, len(nodes), BATCH):
        some = nodes.take(np.arange(lo, min(lo + BATCH, len(nodes))))
        found = [leaves(db, some.take(np.flatnonzero(some.depth == d)), options) for d in np.unique(some.depth)]
        yield Leaves(*(np.concatenate([getattr(x, f) for x in found]) for f in ("pointer", "hi", "lo", "depth"))).ordered()


def scan(db: Database, start: Leaves, options: Options, kind=None, decoders: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the networks view below nodes that are given in address order."""
    records = Records(db, kind, decoders, options.remember)
    parts = (found.take(np.arange(lo, min(lo + BATCH, len(found)))) for found in subtree_runs(db, start, options) for lo in range(0, len(found), BATCH))
    for part in parts:
        cols, offsets, errors = network_batch(db, part, options)
        keep = np.ones(len(offsets), bool)
        values = []
        for k, at in enumerate(offsets):
            value, wrong = None, errors[k]
            if at is not None:
                try:
                    if options.skip_empty_values and db.values.is_empty(at):
                        keep[k] = False
                        values.append(None)
                        continue
                    value, wrong = records.get(at)
                except NetDbError as e:
                    wrong = str(e)
            if wrong and not options.permissive:
                raise InvalidDatabaseError(wrong)
            errors[k] = wrong
            values.append(value)
        cols["error"] = pa.array(errors, pa.string())
        names, arrays = list(cols), list(cols.values())
        if kind is not None:
            arrays.append(record_array(values, kind))
            names.append("record")
        yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep))


def data_values(db: Database) -> Iterator[tuple[int, int | None, str | None]]:
    """(offset, end, error) of the values of the data section, one after the other; an error ends the walk."""

    def text(v: object) -> None:
        if isinstance(v, str):
            try:
                v.encode("utf-8")
            except UnicodeEncodeError as e:
                raise InvalidDatabaseError("invalid UTF-8 string") from e
        elif isinstance(v, dict):
            for k, x in v.items():
                text(k)
                text(x)
        elif isinstance(v, list):
            for x in v:
                text(x)

    at = 0
    while at < db.values.size:
        try:
            value, end = db.values.decode(at)
        except (NetDbError, RecursionError) as e:
            yield at, None, f"received decoding error ({e}) at offset of {at}"
            return
        try:
            text(value)
        except NetDbError as e:
            yield at, None, f"received validation error ({e}) at offset of {at}"
            return
        yield at, end, None
        at = end


def _masks(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words that keep the first bits of an address."""
    ones, one = np.uint64(2**64 - 1), np.uint64(1)
    left = lambda bits: np.where(bits >= 64, ones, ~((one << (64 - np.clip(bits, 1, 63)).astype(np.uint64)) - one))
    zero = np.uint64(0)
    return np.where(depth <= 0, zero, left(depth)), np.where(depth <= 64, zero, left(depth - 64))


def lookup(db: Database, family: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str | None], list[str | None]]:
    """(data offset or -1, depth, network, error) of addresses; family 0 is no address."""
    n = db.metadata.node_count
    bad, v4 = family == 0, family == 4
    wrong = (family == 6) & (db.metadata.ip_version == 4)
    node, depth = np.full(len(hi), n, np.int64), np.zeros(len(hi), np.int64)
    go = np.flatnonzero(~bad & ~wrong)
    node[go], depth[go] = db.walk(hi[go], lo[go], v4[go])
    at, inside = db.data_offset(node)
    errors: list[str | None] = [None] * len(hi)
    for k in np.flatnonzero(bad).tolist():
        errors[k] = "invalid IP address"
    for k in np.flatnonzero(wrong).tolist():
        errors[k] = f"error looking up '{ipaddress.IPv6Address(int(hi[k]) << 64 | int(lo[k]))}': you attempted to look up an IPv6 address in an IPv4-only database"
    for k in go[node[go] < n].tolist():
        errors[k] = "invalid node in search tree"
    for k in np.flatnonzero((node > n) & ~inside).tolist():
        errors[k] = "the database file's search tree is corrupt"
    # A network has one text, however many addresses of it are looked up.
    high, low = _masks(depth)
    above = (db.v4_depth if db.has_v4 else 96) * (node > n) + 96 * (node <= n)
    key = np.stack([hi & high, lo & low, depth.astype(np.uint64), above.astype(np.uint64), v4.astype(np.uint64)], 1)[go]
    distinct, which = np.unique(key, axis=0, return_inverse=True)
    texts = np.array([network_text(*(int(x) for x in k[:3]), bool(k[4]), int(k[3])) for k in distinct], object)
    nets: list[str | None] = [None] * len(hi)
    for k, text in zip(go.tolist(), texts[which.reshape(-1)] if len(go) else (), strict=True):
        nets[k] = text
    found = (node > n) & inside
    return np.where(found, at, -1), depth, nets, errors


def variant(db: Database, offset: int):
    return to_variant(db.values.record(offset))


__all__ = ["K", "Leaves", "Options", "Records", "data_values", "leaves", "lookup", "scan", "split", "start_nodes"]
