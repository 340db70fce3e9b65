"""Writing databases: an addition, as nothing that reads them has a writer.

A database is made of networks and records. Longer networks replace parts of shorter ones, of equal networks the last one
counts. Equal records share one offset; with `pointers`, strings that repeat become pointers to their first copy. The
tree is laid out a level at a time over sorted arrays, so it costs a few numpy passes for each of its levels. `build`
makes the bytes in one process; the data source's writer encodes records in tasks and joins them at commit.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

from netlens import kinds as K


@dataclass(frozen=True)
class Typed:
    """A value with its kind stated."""

    kind: int
    value: object


def u16(v: int) -> Typed:
    return Typed(K.UINT16, v)


def u32(v: int) -> Typed:
    return Typed(K.UINT32, v)


def u64(v: int) -> Typed:
    return Typed(K.UINT64, v)


def u128(v: int) -> Typed:
    return Typed(K.UINT128, v)


def i32(v: int) -> Typed:
    return Typed(K.INT32, v)


def f32(v: float) -> Typed:
    return Typed(K.FLOAT, v)


#: Networks of a v6 tree that point at its IPv4 subtree.
ALIASES = ("::ffff:0:0/96", "2001::/32", "2002::/16")


def _control(kind: int, size: int) -> bytes:
    if size < 29:
        low, more = size, b""
    elif size < 285:
        low, more = 29, (size - 29).to_bytes(1)
    elif size < 65821:
        low, more = 30, (size - 285).to_bytes(2)
    else:
        low, more = 31, (size - 65821).to_bytes(3)
    return bytes([kind << 5 | low]) + more if kind < 8 else bytes([low, kind - 7]) + more


def pointer(target: int) -> bytes:
    for width, (bias, limit) in enumerate(((0, 2048), (2048, 526336), (526336, 134744064)), 1):
        if target < limit:
            value = target - bias
            return bytes([K.POINTER << 5 | (width - 1) << 3 | value >> 8 * width]) + (value & ((1 << 8 * width) - 1)).to_bytes(width)
    return _wide(target)


def _wide(target: int) -> bytes:
    return bytes([K.POINTER << 5 | 3 << 3]) + target.to_bytes(4)


class Encoder:
    """Appends values. wide: pointers take four bytes whatever their target, and their places are kept in `fixes`, so that
    what is encoded here can move."""

    def __init__(self, pointers: bool = False, wide: bool = False):
        self.out, self.pointers, self.wide, self.seen, self.fixes = bytearray(), pointers, wide, {}, []

    def text(self, raw: bytes) -> None:
        if self.pointers:
            at = self.seen.get(raw)
            if at is not None and len(raw) > 4:
                if self.wide:
                    self.fixes.append(len(self.out) + 1)
                self.out += _wide(at) if self.wide else pointer(at)
                return
            self.seen.setdefault(raw, len(self.out))
        self.out += _control(K.STRING, len(raw)) + raw

    def put(self, v: object) -> None:
        if isinstance(v, str):
            self.text(v.encode("utf-8", "surrogateescape"))
        elif isinstance(v, bool):
            self.out += _control(K.BOOL, int(v))
        elif isinstance(v, bytes):
            self.out += _control(K.BYTES, len(v)) + v
        elif isinstance(v, float):
            self.out += _control(K.DOUBLE, 8) + struct.pack(">d", v)
        elif isinstance(v, int):
            self.put(i32(v) if v < 0 else u32(v) if v < 1 << 32 else u64(v) if v < 1 << 64 else u128(v))
        elif isinstance(v, dict):
            self.out += _control(K.MAP, len(v))
            for key, x in v.items():
                self.put(key)
                self.put(x)
        elif isinstance(v, list | tuple):
            self.out += _control(K.SLICE, len(v))
            for x in v:
                self.put(x)
        elif v.kind == K.FLOAT:
            self.out += _control(K.FLOAT, 4) + struct.pack(">f", v.value)
        elif v.kind == K.DOUBLE:
            self.out += _control(K.DOUBLE, 8) + struct.pack(">d", v.value)
        else:
            n = v.value % (1 << 32) if v.kind == K.INT32 else v.value
            raw = n.to_bytes((n.bit_length() + 7) // 8)
            self.out += _control(v.kind, len(raw)) + raw


def encode(value: object) -> bytes:
    e = Encoder()
    e.put(value)
    return bytes(e.out)


def present(value: object) -> object:
    if value is None:
        raise ValueError("null has no encoding outside a struct's field")
    return value


def typed(value: object, kind) -> object:
    """A value of a Spark type, as Arrow gives it, with the kinds that hold it: short and smaller uint16, int uint32, long
    and decimals of up to 20 digits uint64, wider ones uint128, negative numbers int32. Null fields of a struct are left
    out; null elsewhere is an error."""
    from pyspark.sql import types as T

    present(value)
    if isinstance(kind, T.StructType):
        return {f.name: typed(value[f.name], f.dataType) for f in kind.fields if value[f.name] is not None}
    if isinstance(kind, T.MapType):
        return {k: typed(v, kind.valueType) for k, v in (value.items() if isinstance(value, dict) else value)}
    if isinstance(kind, T.ArrayType):
        return [typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.FloatType):
        return f32(value)
    if isinstance(kind, T.DecimalType):
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        return value
    if value < 0:
        if value < -(1 << 31):
            raise ValueError(f"{value} is below what any signed kind holds")
        return i32(value)
    if isinstance(kind, T.ByteType | T.ShortType):
        return u16(value)
    if isinstance(kind, T.IntegerType):
        return u32(value)
    return u128(value) if isinstance(kind, T.DecimalType) and kind.precision > 20 else u64(value)


def putter(kind) -> Callable[[Encoder, object], None]:
    """What puts values of a Spark type, the same as put() does with what typed() makes of them, made once for all rows."""
    from pyspark.sql import types as T

    def struct_() -> Callable[[Encoder, object], None]:
        fields = [(f.name, f.name.encode("utf-8", "surrogateescape"), putter(f.dataType)) for f in kind.fields]

        def put(e: Encoder, v: dict) -> None:
            there = [(raw, one, x) for name, raw, one in fields if (x := v[name]) is not None]
            e.out += _control(K.MAP, len(there))
            for raw, one, x in there:
                e.text(raw)
                one(e, x)

        return put

    def array() -> Callable[[Encoder, object], None]:
        one = putter(kind.elementType)

        def put(e: Encoder, v: list) -> None:
            e.out += _control(K.SLICE, len(v))
            for x in v:
                one(e, present(x))

        return put

    def whole() -> Callable[[Encoder, object], None]:
        as_kind = K.UINT16 if isinstance(kind, T.ByteType | T.ShortType) else K.UINT32 if isinstance(kind, T.IntegerType) else K.UINT128 if isinstance(kind, T.DecimalType) and kind.precision > 20 else K.UINT64

        def put(e: Encoder, v: object) -> None:
            n = int(v)
            if n < 0:
                e.put(typed(n, kind))
                return
            raw = n.to_bytes((n.bit_length() + 7) // 8)
            e.out += _control(as_kind, len(raw)) + raw

        return put

    def real(control: bytes, form: struct.Struct) -> Callable[[Encoder, object], None]:
        return lambda e, v: e.out.extend(control + form.pack(v))

    if isinstance(kind, T.StructType) and len(set(kind.fieldNames())) == len(kind.fields):
        found = struct_()
    elif isinstance(kind, T.ArrayType):
        found = array()
    elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.DecimalType):
        found = whole()
    elif isinstance(kind, T.StringType):
        found = lambda e, v: e.text(v.encode("utf-8", "surrogateescape"))
    elif isinstance(kind, T.FloatType):
        found = real(_control(K.FLOAT, 4), struct.Struct(">f"))
    elif isinstance(kind, T.DoubleType):
        found = real(_control(K.DOUBLE, 8), struct.Struct(">d"))
    else:
        found = lambda e, v: e.put(typed(v, kind))
    return found


#: What a record of the tree holds besides a node: nothing, the IPv4 subtree, and data from DATA down.
_EMPTY, _ALIAS, _DATA = -1, -2, -10


def network_words(texts: Iterable[str], ip_version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high word, low word, depth) of networks in the 128-bit space, where IPv4 lies at ::/96."""
    rows = []
    for text in texts:
        net = ipaddress.ip_network(text)
        if net.version == 6 and ip_version == 4:
            raise ValueError(f"{text} is no network of an IPv4 database")
        n, depth = int(net.network_address), net.prefixlen + (96 if net.version == 4 else 0)
        if depth <= (96 if ip_version == 4 else 0):
            raise ValueError(f"{text} is the whole tree")
        rows.append((n >> 64, n & (1 << 64) - 1, depth))
    hi, lo, depth = zip(*rows, strict=True) if rows else ((), (), ())
    return np.array(hi, np.uint64), np.array(lo, np.uint64), np.array(depth, np.int64)


def _side(hi: np.ndarray, lo: np.ndarray, d: int) -> np.ndarray:
    return ((hi if d < 64 else lo) >> np.uint64(63 - d % 64) & np.uint64(1)).astype(np.int64)


def layout(hi: np.ndarray, lo: np.ndarray, depth: np.ndarray, offset: np.ndarray, ip_version: int, aliases: bool) -> np.ndarray:
    """The tree of networks that lead to data offsets: a row of two records for each node, the root first. Records are
    node numbers, the number of nodes (nothing), or beyond it the place of data."""
    base, value = 96 if ip_version == 4 else 0, _DATA - offset.astype(np.int64)
    inside = (hi == 0) & (lo >> np.uint64(32) == 0)
    if ip_version == 6 and aliases and (inside & (depth > 96)).any():
        for text in ALIASES:
            net = ipaddress.ip_network(text)
            n, bits = int(net.network_address), net.prefixlen
            first, low = np.uint64(n >> 64), np.uint64(n & (1 << 64) - 1)
            same = (hi >> np.uint64(64 - bits) == first >> np.uint64(64 - bits)) if bits <= 64 else (hi == first) & (lo >> np.uint64(128 - bits) == low >> np.uint64(128 - bits))
            keep = ~(same & (depth >= bits))
            hi, lo, depth, value = (np.append(x[keep], one) for x, one in zip((hi, lo, depth, value), (first, low, bits, _ALIAS), strict=True))
    order = np.lexsort((depth, lo, hi))  # stable, so of equal networks the last one comes last
    hi, lo, depth, value = hi[order], lo[order], depth[order].astype(np.int64), value[order]
    if len(hi):
        last = np.append((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1]), True)
        hi, lo, depth, value = hi[last], lo[last], depth[last], value[last]
    levels, count, v4 = [], 0, None
    now, node, given = np.arange(len(hi)), np.zeros(len(hi), np.int64), np.array([_EMPTY])
    for d in range(base, 128):
        if d == 96 and base == 0 and len(now) and not hi[now[0]] and not lo[now[0]] >> np.uint64(32):
            v4 = count
        records = np.repeat(given, 2)
        slot = 2 * node + _side(hi[now], lo[now], d)
        ends = depth[now] == d + 1
        records[slot[ends]] = value[now[ends]]
        now, slot = now[~ends], slot[~ends]
        first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, bool)
        node, count = np.cumsum(first) - 1, count + len(given)
        given = records[slot[first]]
        records[slot[first]] = count + np.arange(len(given))
        levels.append(records)
        if not len(now):
            break
    out = np.concatenate(levels)
    levels.clear()
    data = out <= _DATA
    out[out == _EMPTY] = count
    out[out == _ALIAS] = count if v4 is None else v4
    np.subtract(count + K.SEPARATOR + _DATA, out, out=out, where=data)
    return out.reshape(-1, 2)


def pack(tree: np.ndarray, record_size: int) -> bytes:
    """The bytes of a tree."""
    if tree.size and int(tree.max()) >> record_size:
        raise ValueError(f"records of {record_size} bits are too short for this database")
    left, right = tree[:, 0], tree[:, 1]
    byte = lambda x, k: (x >> k & 255).astype(np.uint8)
    if record_size == 24:
        cols = [byte(x, k) for x in (left, right) for k in (16, 8, 0)]
    elif record_size == 28:
        middle = (left >> 24 << 4 | right >> 24).astype(np.uint8)
        cols = [*(byte(left, k) for k in (16, 8, 0)), middle, *(byte(right, k) for k in (16, 8, 0))]
    else:
        cols = [byte(x, k) for x in (left, right) for k in (24, 16, 8, 0)]
    return np.stack(cols, 1).tobytes()


def head(
    nodes: int, ip_version: int = 6, record_size: int = 28, database_type: str = "Test", description: dict[str, str] | None = None,
    languages: list[str] | None = None, build_epoch: int = 0,
) -> bytes:
    """The marker and the metadata."""
    fields = {
        "binary_format_major_version": u16(2), "binary_format_minor_version": u16(0), "build_epoch": u64(build_epoch), "database_type": database_type,
        "description": {"en": "Test Database"} if description is None else description, "ip_version": u16(ip_version),
        "languages": ["en"] if languages is None else languages, "node_count": u32(nodes), "record_size": u16(record_size),
    }
    return K.MARKER + encode(fields)


def build(
    networks: Iterable[tuple[str, object]],
    ip_version: int = 6,
    record_size: int = 28,
    database_type: str = "Test",
    description: dict[str, str] | None = None,
    languages: list[str] | None = None,
    build_epoch: int = 0,
    aliases: bool = True,
    pointers: bool = False,
) -> bytes:
    """The bytes of a database of (network, record) pairs."""
    networks = list(networks)
    enc, offsets, at = Encoder(pointers), {}, []
    hi, lo, depth = network_words((n for n, _ in networks), ip_version)
    for _, record in networks:
        key = encode(record)
        if key not in offsets:
            offsets[key] = len(enc.out)
            enc.put(record)
        at.append(offsets[key])
    tree = layout(hi, lo, depth, np.array(at, np.int64), ip_version, aliases)
    return pack(tree, record_size) + bytes(K.SEPARATOR) + bytes(enc.out) + head(len(tree), ip_version, record_size, database_type, description, languages, build_epoch)
