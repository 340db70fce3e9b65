"""Reading database bytes: values, metadata, the search tree and compiled record schemas.

Trees are handled as whole numpy arrays: a scan expands one depth level of all open nodes at a time, a lookup walks all
addresses together. Addresses are two unsigned 64-bit words of the 128-bit space, where IPv4 lies at ::/96.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from netlens import kinds as K
from netlens.kinds import ContextualError, InvalidDatabaseError, UnmarshalTypeError, end_of_data

sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * K.MAX_DEPTH))

Step = Callable[[int, int], tuple[object, int]]


class Values:
    """Decoder of a section of tagged values. Offsets count from the section's start."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.size = data, len(data)

    def control(self, at: int) -> tuple[int, int, int]:
        """(kind, size, offset of the payload)."""
        if not 0 <= at < self.size:
            raise end_of_data()
        byte = self.data[at]
        at, kind, size = at + 1, byte >> 5, byte & 31
        if kind == K.EXTENDED:
            if at >= self.size:
                raise end_of_data()
            kind, at = (self.data[at] + 7) & 255, at + 1
        if kind != K.POINTER and size >= 29:
            more = size - 28
            if at + more > self.size:
                raise end_of_data()
            size, at = K.SIZE_BIAS[more - 1] + int.from_bytes(self.data[at : at + more]), at + more
        return kind, size, at

    def pointer(self, size: int, at: int) -> tuple[int, int]:
        """(target, offset after the pointer)."""
        width = (size >> 3 & 3) + 1
        if at + width > self.size:
            raise end_of_data()
        value = int.from_bytes(self.data[at : at + width])
        if width < 4:
            value |= (size & 7) << 8 * width
        return value + K.POINTER_BIAS[width - 1], at + width

    def resolve(self, at: int) -> tuple[int, int, int, int | None]:
        """(kind, size, payload offset, offset after the pointer if there was one). One hop is all that is allowed."""
        if 0 <= at < self.size and (byte := self.data[at]) >> 5 > K.POINTER and byte & 31 < 29:  # most values, at once
            return byte >> 5, byte & 31, at + 1, None
        kind, size, body = self.control(at)
        if kind != K.POINTER:
            return kind, size, body, None
        target, after = self.pointer(size, body)
        kind, size, body = self.control(target)
        if kind == K.POINTER:
            raise InvalidDatabaseError(f"invalid pointer to pointer at offset {at}")
        return kind, size, body, after

    def home(self, at: int) -> int:
        """The offset of the value itself, behind a pointer if there is one."""
        kind, size, body = self.control(at)
        return self.pointer(size, body)[0] if kind == K.POINTER else at

    def scalar(self, kind: int, size: int, at: int) -> tuple[object, int]:
        if kind == K.BOOL:
            if size > 1:
                raise InvalidDatabaseError(f"the bool size of {size} is invalid")
            return bool(size), at
        end = at + size
        if kind in (K.DOUBLE, K.FLOAT) and size != (8 if kind == K.DOUBLE else 4):
            raise InvalidDatabaseError(f"the float size of {size} is invalid")
        if kind in K.WIDTH and size > K.WIDTH[kind]:
            raise InvalidDatabaseError(f"the {K.kind_name(kind)} size of {size} is invalid")
        if end > self.size:
            raise end_of_data()
        raw = bytes(self.data[at:end])
        if kind == K.STRING:
            return raw.decode("utf-8", "surrogateescape"), end
        if kind == K.BYTES:
            return raw, end
        if kind == K.DOUBLE:
            return struct.unpack(">d", raw)[0], end
        if kind == K.FLOAT:
            return struct.unpack(">f", raw)[0], end
        if kind in K.WIDTH:
            value = int.from_bytes(raw)  # short encodings are zero-extended, signed ones too
            return value - (1 << 32) if kind == K.INT32 and value >> 31 else value, end
        raise InvalidDatabaseError(f"unknown type: {kind}")

    def _room(self, kind: int, size: int, at: int, depth: int = 0) -> None:
        """A container can't have more values than bytes are left; a large one is sound before it is decoded."""
        count = size * (2 if kind == K.MAP else 1)
        if count > self.size - at:
            raise end_of_data()
        if count >= K.LARGE:
            self.check(kind, size, at, depth)

    def check(self, kind: int, size: int, at: int, depth: int) -> None:
        """Whether everything in a container is well formed: kinds, widths, bounds, map keys, pointers and depth. No value
        is made. What is still open is kept as (values left, whether keys are among them, place, depth)."""
        open_ = [[size * (2 if kind == K.MAP else 1), kind == K.MAP, at, depth + 1]]
        while open_:
            top = open_[-1]
            if not top[0]:
                done = open_.pop()
                if open_ and len(done) == 4:  # what a pointer leads to doesn't move the place before it
                    open_[-1][2] = done[2]
                continue
            if top[3] > K.MAX_DEPTH:
                raise InvalidDatabaseError("exceeded maximum data structure depth; database is likely corrupt")
            is_key = top[1] and top[0] % 2 == 0
            top[0] -= 1
            where = top[2]
            kind, size, body = self.control(where)
            if kind == K.POINTER:
                target, top[2] = self.pointer(size, body)
                kind, size, body = self.control(target)
                if kind == K.POINTER:
                    raise InvalidDatabaseError(f"invalid pointer to pointer at offset {target}")
                aside = True
            else:
                aside = False
            if is_key and kind != K.STRING:
                raise InvalidDatabaseError(f"unexpected map key type: {K.kind_name(kind)}")
            if kind in K.CONTAINERS:
                inner = [size * (2 if kind == K.MAP else 1), kind == K.MAP, body, top[3] + 1]
                if inner[0] > self.size - body:
                    raise end_of_data()
                open_.append([*inner, "aside"] if aside else inner)
                continue
            fixed = {K.DOUBLE: 8, K.FLOAT: 4}.get(kind, size)
            if kind == K.BOOL and size > 1:
                raise InvalidDatabaseError(f"invalid bool size: {size}")
            if kind not in K.SCALARS:
                raise InvalidDatabaseError(f"unknown type: {kind}")
            if size != fixed or size > K.WIDTH.get(kind, size):
                raise InvalidDatabaseError(f"invalid {K.kind_name(kind)} size: {size}")
            end = body + (0 if kind == K.BOOL else size)
            if end > self.size:
                raise end_of_data()
            if not aside:
                top[2] = end

    def key(self, at: int) -> tuple[str, int]:
        if 0 <= at < self.size and (byte := self.data[at]) >> 5 == K.STRING and byte & 31 < 29 and (end := at + 1 + (byte & 31)) <= self.size:
            return bytes(self.data[at + 1 : end]).decode("utf-8", "surrogateescape"), end
        kind, size, body, after = self.resolve(at)
        if kind != K.STRING:
            raise InvalidDatabaseError(f"map key must be a string, found {K.kind_name(kind)}")
        text, end = self.scalar(kind, size, body)
        return text, end if after is None else after

    def decode(self, at: int, depth: int = 0) -> tuple[object, int]:
        """(value, offset after it). Of repeated map keys the last one counts."""
        if depth > K.MAX_DEPTH:
            raise InvalidDatabaseError("exceeded maximum data structure depth; database is likely corrupt")
        kind, size, body, after = self.resolve(at)
        if kind == K.MAP:
            self._room(kind, size, body, depth)
            out = {}
            for _ in range(size):
                name, body = self.key(body)
                try:
                    out[name], body = self.decode(body, depth + 1)
                except K.NetDbError as e:
                    raise _inside(e, name) from e
            value = out
        elif kind == K.SLICE:
            self._room(kind, size, body, depth)
            value = []
            for k in range(size):
                try:
                    one, body = self.decode(body, depth + 1)
                except K.NetDbError as e:
                    raise _inside(e, k) from e
                value.append(one)
        else:
            value, body = self.scalar(kind, size, body)
        return value, body if after is None else after

    def skip(self, at: int) -> int:
        """The offset after a value; pointers are not followed."""
        left = 1
        while left:
            kind, size, body = self.control(at)
            left -= 1
            if kind == K.POINTER:
                at = self.pointer(size, body)[1]
            elif kind in K.CONTAINERS:
                if size * (2 if kind == K.MAP else 1) > self.size - body:
                    raise end_of_data()
                left += size * (2 if kind == K.MAP else 1)
                at = body
            elif kind == K.BOOL:
                at = body
            elif kind in K.SCALARS:
                at = body + size
                if at > self.size:
                    raise end_of_data()
            else:
                raise InvalidDatabaseError(f"unknown type: {kind}")
        return at

    def is_empty(self, at: int) -> bool:
        """Whether the value is an empty map or slice; only control bytes are read."""
        kind, size, _, _ = self.resolve(at)
        return kind in K.CONTAINERS and size == 0

    def record(self, at: int, step: Step | None = None) -> object:
        """A record, with errors that name its offset and the path."""
        try:
            return (step or self.decode)(at, 0)[0]
        except _Inside as e:
            raise ContextualError(at, "/" + "/".join(map(str, e.path)), e.cause) from e
        except K.NetDbError as e:
            raise ContextualError(at, "", e) from e

    def path(self, at: int, *path: str | int) -> object:
        """The value at a path, None where a key is missing or an index is out of range. Of repeated keys the
        first one counts; a negative index counts from the end."""
        for k, step in enumerate(path):
            kind, size, body, _ = self.resolve(at)
            if isinstance(step, bool) or not isinstance(step, str | int):
                raise TypeError(f"unexpected path element at index {k} ({step}): {type(step).__name__}")
            if isinstance(step, str):
                if kind != K.MAP:
                    raise InvalidDatabaseError(f"expected a map for {step} but found {K.kind_name(kind)}")
                at = None
                for _ in range(size):
                    name, body = self.key(body)
                    if name == step:
                        at = body
                        break
                    body = self.skip(body)
            else:
                if kind != K.SLICE:
                    raise InvalidDatabaseError(f"expected a slice for {step} but found {K.kind_name(kind)}")
                place = step + size if step < 0 else step
                at = None
                if 0 <= place < size:
                    for _ in range(place):
                        body = self.skip(body)
                    at = body
            if at is None:
                return None
        return self.decode(at, len(path))[0]


class _Inside(K.NetDbError):
    """Carries the path outwards while decoding unwinds."""

    def __init__(self, path: list, cause: Exception):
        super().__init__(str(cause))
        self.path, self.cause = path, cause


def _inside(e: Exception, step: str | int) -> _Inside:
    return _Inside([step, *e.path], e.cause) if isinstance(e, _Inside) else _Inside([step], e)


class Cursor:
    """A place in the data for custom decoders. Reading gives the value and the cursor behind it, so a decoder proves
    where it ended by what it returns."""

    __slots__ = ("values", "at")

    def __init__(self, values: Values, at: int):
        self.values, self.at = values, at

    def kind(self) -> int:
        return self.values.resolve(self.at)[0]

    def offset(self) -> int:
        return self.values.home(self.at)

    def skip(self) -> Cursor:
        return Cursor(self.values, self.values.skip(self.at))

    def read(self, *wanted: int) -> tuple[object, Cursor]:
        """The value, of one of the wanted kinds if there are any."""
        if wanted and self.kind() not in wanted:
            raise K.UnexpectedKindError(self.kind(), frozenset(wanted))
        value, end = self.values.decode(self.at)
        return value, Cursor(self.values, end)

    def size(self) -> int:
        """Entries of a map or elements of a slice; nothing of them is read."""
        kind, size, _, _ = self.values.resolve(self.at)
        if kind not in K.CONTAINERS:
            raise K.UnexpectedKindError(kind, K.CONTAINERS)
        return size

    def read_bool(self) -> tuple[bool, Cursor]:
        return self.read(K.BOOL)

    def read_string(self) -> tuple[str, Cursor]:
        return self.read(K.STRING)

    def read_bytes(self) -> tuple[bytes, Cursor]:
        return self.read(K.BYTES)

    def read_float32(self) -> tuple[float, Cursor]:
        return self.read(K.FLOAT)

    def read_float64(self) -> tuple[float, Cursor]:
        return self.read(K.DOUBLE)

    def read_int32(self) -> tuple[int, Cursor]:
        return self.read(K.INT32)

    def read_uint128(self) -> tuple[int, Cursor]:
        return self.read(K.UINT128)

    def read_float(self) -> tuple[float, Cursor]:
        return self.read(K.FLOAT, K.DOUBLE)

    def read_uint(self) -> tuple[int, Cursor]:
        return self.read(K.UINT16, K.UINT32, K.UINT64)

    def read_integer(self) -> tuple[int, Cursor]:
        return self.read(K.UINT16, K.UINT32, K.UINT64, K.INT32)

    def items(self) -> Iterator[tuple[str, Cursor]]:
        """Keys of a map with cursors at their values."""
        kind, size, body, _ = self.values.resolve(self.at)
        if kind != K.MAP:
            raise K.UnexpectedKindError(kind, frozenset((K.MAP,)))
        for _ in range(size):
            name, body = self.values.key(body)
            yield name, Cursor(self.values, body)
            body = self.values.skip(body)

    def elements(self) -> Iterator[Cursor]:
        kind, size, body, _ = self.values.resolve(self.at)
        if kind != K.SLICE:
            raise K.UnexpectedKindError(kind, frozenset((K.SLICE,)))
        for _ in range(size):
            yield Cursor(self.values, body)
            body = self.values.skip(body)


class Decoder:
    """The older way of custom decoding: a place that moves on with every read. What is behind the value follows from the
    value itself, so a decoder returns nothing but what it made."""

    __slots__ = ("cursor",)

    def __init__(self, cursor: Cursor):
        self.cursor = cursor

    def kind(self) -> int:
        return self.cursor.kind()

    def offset(self) -> int:
        return self.cursor.offset()

    def skip(self) -> None:
        self.cursor = self.cursor.skip()

    def read(self, *wanted: int) -> object:
        value, self.cursor = self.cursor.read(*wanted)
        return value

    def items(self) -> Iterator[tuple[str, Decoder]]:
        """Keys of a map with decoders at their values; the place moves behind the map, whatever is read of it."""
        entries = list(self.cursor.items())
        self.skip()
        return ((name, Decoder(at)) for name, at in entries)

    def elements(self) -> Iterator[Decoder]:
        entries = list(self.cursor.elements())
        self.skip()
        return (Decoder(at) for at in entries)


@dataclass
class Metadata:
    binary_format_major_version: int = 0
    binary_format_minor_version: int = 0
    build_epoch: int = 0
    database_type: str = ""
    description: dict[str, str] = field(default_factory=dict)
    ip_version: int = 0
    languages: list[str] = field(default_factory=list)
    node_count: int = 0
    record_size: int = 0


def _metadata(values: Values) -> Metadata:
    kind, size, body, _ = values.resolve(0)
    if kind != K.MAP:
        raise InvalidDatabaseError(f"metadata must be a map, found {K.kind_name(kind)}")
    out, want = Metadata(), Metadata.__dataclass_fields__
    for _ in range(size):
        name, body = values.key(body)
        if name not in want:
            body = values.skip(body)
            continue
        try:
            value, body = values.decode(body, 1)
        except _Inside as e:
            raise ContextualError(0, "/".join(("", name, *map(str, e.path))), e.cause) from e
        except K.NetDbError as e:
            raise ContextualError(0, f"/{name}", e) from e
        kinds = {"database_type": str, "description": dict, "languages": list}.get(name, int)
        if not isinstance(value, kinds) or isinstance(value, bool):
            raise UnmarshalTypeError(value, type(value).__name__, kinds.__name__)
        setattr(out, name, value)
    return out


class Database:
    """A database over bytes: metadata, tree arrays and the data section."""

    def __init__(self, data: bytes | memoryview):
        mark = bytes(data).rfind(K.MARKER) if not hasattr(data, "rfind") else data.rfind(K.MARKER)
        if not len(data):
            raise InvalidDatabaseError("file is empty")
        if mark < 0:
            raise InvalidDatabaseError("invalid database file: it has no metadata")
        view = memoryview(data)
        self.metadata = m = _metadata(Values(view[mark + len(K.MARKER) :]))
        self.tree_bytes = m.node_count * (m.record_size // 4)
        if self.tree_bytes >> 63:
            raise InvalidDatabaseError("database tree size would overflow")
        start = self.tree_bytes + K.SEPARATOR
        if start > mark:
            raise InvalidDatabaseError("the database contains invalid metadata")
        self.view, self.values = view, Values(view[start:mark])
        self.separator = bytes(view[self.tree_bytes : start])
        self._tree: tuple[np.ndarray, np.ndarray] | None = None
        self.v4_start, self.v4_depth = (0, 96) if m.ip_version == 4 else self._first_v4()

    @property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """Left and right records of all nodes, of 32 bits each."""
        if self._tree is None:
            m = self.metadata
            raw = np.frombuffer(self.view[: self.tree_bytes], np.uint8).reshape(m.node_count, -1) if m.node_count else np.zeros((0, 8), np.uint8)
            part = lambda k: raw[:, k].astype(np.uint32)
            if m.record_size == 24:
                pair = (part(0) << 16 | part(1) << 8 | part(2), part(3) << 16 | part(4) << 8 | part(5))
            elif m.record_size == 28:
                pair = (part(3) >> 4 << 24 | part(0) << 16 | part(1) << 8 | part(2), (part(3) & 15) << 24 | part(4) << 16 | part(5) << 8 | part(6))
            elif m.record_size == 32:
                whole = np.frombuffer(self.view[: self.tree_bytes], ">u4").reshape(-1, 2)
                pair = (whole[:, 0].astype(np.uint32), whole[:, 1].astype(np.uint32))
            else:
                raise InvalidDatabaseError("unsupported record size")
            self._tree = pair
        return self._tree

    def _first_v4(self) -> tuple[int, int]:
        if self.metadata.record_size not in K.RECORD_SIZES:
            return 0, 96
        node, depth, left = 0, 0, self.tree[0]
        while depth < 96 and node < self.metadata.node_count:
            node, depth = int(left[node]), depth + 1
        return node, depth

    @property
    def has_v4(self) -> bool:
        return self.metadata.ip_version == 4 or self.v4_start < self.metadata.node_count

    def data_offset(self, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset in the data section, whether it lies inside)."""
        at = pointers.astype(np.int64) - self.metadata.node_count - K.SEPARATOR
        return at, (at >= 0) & (at < self.values.size)

    def walk(self, hi: np.ndarray, lo: np.ndarray, v4: np.ndarray, stop: np.ndarray | int = 128) -> tuple[np.ndarray, np.ndarray]:
        """(record reached, depth) for all addresses together; v4 ones start at the IPv4 subtree."""
        left, right = self.tree
        n = self.metadata.node_count
        node = np.where(v4, self.v4_start, 0).astype(np.int64)
        depth = np.where(v4, self.v4_depth if self.metadata.ip_version != 4 else 96, 0).astype(np.int64)
        stop = np.broadcast_to(np.asarray(stop), node.shape)
        live = np.flatnonzero((node < n) & (depth < stop))
        while len(live):
            d = depth[live]
            word = np.where(d < 64, hi[live], lo[live])
            bit = (word >> (63 - (d & 63)).astype(np.uint64)) & np.uint64(1)
            node[live] = np.where(bit == 1, right[node[live]], left[node[live]])
            depth[live] = d + 1
            live = live[(node[live] < n) & (depth[live] < stop[live])]
        return node, depth

    def expand(self, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, depth: int, aliased: bool, until: int = 128) -> tuple[np.ndarray, ...]:
        """Leaves (pointer, hi, lo, depth) below nodes of one depth, one level at a time. Nodes still open at
        `until` come back as they are."""
        left, right = self.tree
        n, out = self.metadata.node_count, []
        while len(node):
            if not aliased and self.v4_start:
                keep = (node != self.v4_start) | ((hi == 0) & (lo >> np.uint64(32) == 0)) | (node == n)
                node, hi, lo = node[keep], hi[keep], lo[keep]
            open_ = node < n if depth < until else np.zeros(len(node), bool)
            out.append((node[~open_], hi[~open_], lo[~open_], np.full(int((~open_).sum()), depth, np.int64)))
            node, hi, lo = node[open_], hi[open_], lo[open_]
            bit = np.uint64(1 << (63 - depth % 64))
            rh, rl = (hi | bit, lo) if depth < 64 else (hi, lo | bit)
            node, hi, lo = np.concatenate((left[node], right[node])).astype(np.int64), np.concatenate((hi, rh)), np.concatenate((lo, rl))
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (node, hi, lo, node)


def compile_schema(kind, values: Values, meta: dict | None = None, decoders: dict[str, Callable[[Cursor], tuple[object, Cursor]]] | None = None) -> Step:
    """A decoder of one Spark type, specialised before the first row: unknown keys are skipped undecoded. Field
    metadata: {"key": name} takes a value by another key, {"as": "offset"} gives the value's offset instead of it,
    {"decoder": name} a registered custom decoder, {"legacy_decoder": name} one that takes a Decoder and counts only without
    the other, {"key_decoder": name} one for the keys of a map, which may then be of
    any type. Repeated keys: the last one counts."""
    from pyspark.sql import types as T

    meta, decoders = meta or {}, decoders or {}
    if meta.get("as") == "offset":
        return lambda at, depth: (values.home(at), values.skip(at))
    if "decoder" in meta:
        custom = decoders[meta["decoder"]]

        def by_custom(at: int, depth: int) -> tuple[object, int]:
            value, end = custom(Cursor(values, at))
            after = values.skip(at)
            if not isinstance(end, Cursor) or end.at not in (after, values.skip(values.home(at))):
                raise InvalidDatabaseError("a custom decoder did not return the cursor behind its value")
            return value, after

        return by_custom

    if "legacy_decoder" in meta:
        older = decoders[meta["legacy_decoder"]]
        return lambda at, depth: (older(Decoder(Cursor(values, at))), values.skip(at))

    def typed(wanted: frozenset[int], name: str, check: Callable[[object], object] | None = None) -> Step:
        def step(at: int, depth: int) -> tuple[object, int]:
            found, size, body, after = values.resolve(at)
            if found not in wanted:
                raise UnmarshalTypeError("" if found in K.CONTAINERS else values.scalar(found, size, body)[0], K.kind_name(found), name)
            value, end = values.scalar(found, size, body)
            return check(value) if check else value, end if after is None else after

        return step

    def ranged(lo: int, hi: int, name: str) -> Step:
        def check(v: int) -> int:
            if not lo <= v <= hi:
                raise UnmarshalTypeError(v, "integer", name)
            return v

        return typed(frozenset((K.UINT16, K.UINT32, K.UINT64, K.INT32)), name, check)

    ints = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
    if type(kind) in ints:
        bits = ints[type(kind)]
        return ranged(-(1 << bits), (1 << bits) - 1, kind.simpleString())
    if isinstance(kind, T.DecimalType):
        from decimal import Decimal

        most = 10 ** (kind.precision - kind.scale) - 1

        def exact(v: int) -> Decimal:
            if not -most <= v <= most:
                raise UnmarshalTypeError(v, "integer", kind.simpleString())
            return Decimal(v)

        return typed(frozenset(K.WIDTH), kind.simpleString(), exact)
    if isinstance(kind, T.StringType):
        return typed(frozenset((K.STRING,)), "string", lambda v: v.encode("utf-8", "surrogateescape").decode("utf-8", "replace"))
    if isinstance(kind, T.BooleanType):
        return typed(frozenset((K.BOOL,)), "boolean")
    if isinstance(kind, T.BinaryType):
        return typed(frozenset((K.BYTES, K.UINT128)), "binary", lambda v: v.to_bytes(16) if isinstance(v, int) else v)
    if isinstance(kind, T.DoubleType):
        return typed(frozenset((K.DOUBLE, K.FLOAT)), "double")
    if isinstance(kind, T.FloatType):

        def narrow(v: float) -> float:
            if abs(v) > 3.4028234663852886e38 and v not in (float("inf"), float("-inf")):
                raise UnmarshalTypeError(v, "Float64", "float")
            return v

        return typed(frozenset((K.DOUBLE, K.FLOAT)), "float", narrow)
    if isinstance(kind, T.VariantType):
        return lambda at, depth: (lambda v: (to_variant(v[0]), v[1]))(values.decode(at, depth))

    def nested(at: int, depth: int, wanted: int, name: str) -> tuple[int, int, int | None]:
        if depth > K.MAX_DEPTH:
            raise InvalidDatabaseError("exceeded maximum data structure depth; database is likely corrupt")
        found, size, body, after = values.resolve(at)
        if found != wanted:
            raise UnmarshalTypeError("map" if found == K.MAP else "array" if found == K.SLICE else "value", K.kind_name(found), name)
        values._room(found, size, body, depth)
        return size, body, after

    if isinstance(kind, T.StructType):
        order: dict[str, int] = {}
        steps: list[Step] = []
        for f in kind.fields:
            name = f.metadata.get("key", f.name)
            if name in order:
                raise ValueError(f"two fields take the key {name}")
            order[name] = len(steps)
            steps.append(compile_schema(f.dataType, values, f.metadata, decoders))

        shown = kind.simpleString()

        def struct_step(at: int, depth: int) -> tuple[object, int]:
            size, body, after = nested(at, depth, K.MAP, shown)
            out: list = [None] * len(steps)
            for _ in range(size):
                name, body = values.key(body)
                k = order.get(name)
                if k is None:
                    body = values.skip(body)
                else:
                    try:
                        out[k], body = steps[k](body, depth + 1)
                    except K.NetDbError as e:
                        raise _inside(e, name) from e
            return tuple(out), body if after is None else after

        return struct_step
    if isinstance(kind, T.ArrayType):
        one, shown = compile_schema(kind.elementType, values, None, decoders), kind.simpleString()

        def array_step(at: int, depth: int) -> tuple[object, int]:
            size, body, after = nested(at, depth, K.SLICE, shown)
            out = []
            for k in range(size):
                try:
                    value, body = one(body, depth + 1)
                except K.NetDbError as e:
                    raise _inside(e, k) from e
                out.append(value)
            return out, body if after is None else after

        return array_step
    if isinstance(kind, T.MapType):
        by_key = decoders[meta["key_decoder"]] if "key_decoder" in meta else None
        if by_key is None and not isinstance(kind.keyType, T.StringType):
            raise ValueError("map keys are strings, or what a key decoder makes of them")
        one = compile_schema(kind.valueType, values, None, decoders)

        def own_key(at: int, name: str) -> object:
            key, end = by_key(Cursor(values, at))
            if not isinstance(end, Cursor):
                raise InvalidDatabaseError("a custom decoder did not return the cursor behind its value")
            return key

        def map_step(at: int, depth: int) -> tuple[object, int]:
            size, body, after = nested(at, depth, K.MAP, kind.simpleString())
            out = {}
            for _ in range(size):
                start = body
                name, body = values.key(body)
                try:
                    key = name if by_key is None else own_key(start, name)
                    out[key], body = one(body, depth + 1)
                except K.NetDbError as e:
                    raise _inside(e, name) from e
            return out, body if after is None else after

        return map_step
    raise ValueError(f"no decoder for {kind.simpleString()}")


def to_json_value(value: object) -> object:
    """A value for JSON: bytes as hex text, integers that no JSON reader keeps exactly as text."""
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) >= 10**38:
        return str(value)
    if isinstance(value, dict):
        return {k: to_json_value(v) for k, v in value.items()}
    return [to_json_value(v) for v in value] if isinstance(value, list) else value


def to_variant(value: object):
    """A VARIANT, the same as of the value's JSON text."""
    import json

    from pyspark.sql.types import VariantVal

    keys: dict[str, int] = {}
    try:
        body = _variant_body(value, keys)
    except _NotPlain:
        return VariantVal.parseJson(json.dumps(to_json_value(value)))
    names = tuple(keys)
    if names not in _VARIANT_KEYS:
        if len(_VARIANT_KEYS) >= 4096:
            _VARIANT_KEYS.clear()
        _VARIANT_KEYS[names] = _variant_keys(names)
    if len(body) + len(_VARIANT_KEYS[names]) > 1 << 22:  # what is near the limit of a VARIANT is Spark's to judge
        return VariantVal.parseJson(json.dumps(to_json_value(value)))
    return VariantVal(body, _VARIANT_KEYS[names])


#: The dictionaries of keys of VARIANT values.
_VARIANT_KEYS: dict[tuple[str, ...], bytes] = {}


class _NotPlain(Exception):
    """A value that is left to Spark's own reader of JSON."""


def _variant_width(n: int) -> int:
    return 1 if n < 1 << 8 else 2 if n < 1 << 16 else 3


def _variant_keys(names: tuple[str, ...]) -> bytes:
    raw = [x.encode("utf-8") for x in names]
    width = _variant_width(max(len(raw), sum(map(len, raw))))
    out, at = bytearray([1 | width - 1 << 6]) + len(raw).to_bytes(width, "little"), 0
    for x in (*raw, b""):
        out += at.to_bytes(width, "little")
        at += len(x)
    return bytes(out + b"".join(raw))


def _variant_body(v: object, keys: dict[str, int]) -> bytes:
    """The bytes of a value: maps and slices with their offsets before their values, numbers as short as they go, floats
    as decimals where their text is one."""
    t = type(v)
    if t is bytes:
        v, t = v.hex(), str
    if t is str:
        try:
            raw = v.encode("utf-8")
        except UnicodeEncodeError as e:
            raise _NotPlain from e
        return (bytes([len(raw) << 2 | 1]) if len(raw) < 64 else b"\x40" + len(raw).to_bytes(4, "little")) + raw
    if t is bool:
        return b"\x04" if v else b"\x08"
    if t is int:
        if -128 <= v < 128:
            return b"\x0c" + v.to_bytes(1, "little", signed=True)
        if -(1 << 15) <= v < 1 << 15:
            return b"\x10" + v.to_bytes(2, "little", signed=True)
        if -(1 << 31) <= v < 1 << 31:
            return b"\x14" + v.to_bytes(4, "little", signed=True)
        if -(1 << 63) <= v < 1 << 63:
            return b"\x18" + v.to_bytes(8, "little", signed=True)
        return _variant_decimal(v, len(str(abs(v))), 0) if abs(v) < 10**38 else _variant_body(str(v), keys)
    if t is float:
        text = repr(v)
        whole, dot, part = text.lstrip("-").partition(".")
        if dot and whole.isdecimal() and part.isdecimal():
            digits = (whole + part).lstrip("0")
            if len(part) <= 38 and len(digits) <= 38:
                return _variant_decimal(int(digits or "0") * (-1 if text[0] == "-" else 1), len(digits) or 1, len(part))
        return b"\x1c" + struct.pack("<d", v if v == v else float("nan"))  # all NaN have one text
    if t is dict:
        at, places, bodies = 0, [], []
        for name, x in v.items():
            k = keys.setdefault(name, len(keys))
            one = _variant_body(x, keys)
            places.append((name, k, at))
            bodies.append(one)
            at += len(one)
        places.sort()
        ids, width = _variant_width(max((p[1] for p in places), default=0)), _variant_width(at)
        large = len(places) > 255
        out = bytearray([large << 6 | ids - 1 << 4 | width - 1 << 2 | 2]) + len(places).to_bytes(4 if large else 1, "little")
        for _, k, _ in places:
            out += k.to_bytes(ids, "little")
        for _, _, p in places:
            out += p.to_bytes(width, "little")
        return bytes(out + at.to_bytes(width, "little") + b"".join(bodies))
    if t is list:
        bodies = [_variant_body(x, keys) for x in v]
        at, total, large = 0, sum(map(len, bodies)), len(bodies) > 255
        width = _variant_width(total)
        out = bytearray([large << 4 | width - 1 << 2 | 3]) + len(bodies).to_bytes(4 if large else 1, "little")
        for one in (*bodies, b""):
            out += at.to_bytes(width, "little")
            at += len(one)
        return bytes(out + b"".join(bodies))
    raise _NotPlain


def _variant_decimal(unscaled: int, digits: int, scale: int) -> bytes:
    for most, head, size in ((9, 0x20, 4), (18, 0x24, 8), (38, 0x28, 16)):
        if digits <= most and scale <= most:
            return bytes([head, scale]) + unscaled.to_bytes(size, "little", signed=True)
    raise _NotPlain


def infer_schema(values: list[object]):
    """The narrowest Spark type that holds all of these decoded values."""
    from pyspark.sql import types as T

    def of(v: object):
        if v is None:
            return T.NullType()
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, int):
            return T.LongType() if -(1 << 63) <= v < 1 << 63 else T.DecimalType(20, 0) if v < 1 << 64 else T.BinaryType()
        if isinstance(v, float):
            return T.DoubleType()
        if isinstance(v, str | bytes):
            return T.StringType() if isinstance(v, str) else T.BinaryType()
        if isinstance(v, list):
            return T.ArrayType(merge([of(x) for x in v]))
        return T.StructType([T.StructField(k, of(x)) for k, x in v.items()])

    def merge(types: list):
        types = [t for t in types if not isinstance(t, T.NullType)]
        if not types:
            return T.StringType()
        if all(t == types[0] for t in types):
            return types[0]
        if all(isinstance(t, T.StructType) for t in types):
            names = dict.fromkeys(f.name for t in types for f in t.fields)
            return T.StructType([T.StructField(n, merge([f.dataType for t in types for f in t.fields if f.name == n])) for n in names])
        if all(isinstance(t, T.ArrayType) for t in types):
            return T.ArrayType(merge([t.elementType for t in types]))
        if all(isinstance(t, T.LongType | T.DecimalType) for t in types):
            return T.DecimalType(20, 0)
        return T.VariantType()

    return merge([of(v) for v in values])
