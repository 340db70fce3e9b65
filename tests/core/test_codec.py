import ipaddress
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netlens import kinds as K
from netlens import writer as w
from netlens.codec import Cursor, Database, Values, compile_schema, infer_schema
from netlens.kinds import ContextualError, InvalidDatabaseError, UnexpectedKindError, UnmarshalTypeError
from netlens.reader import NetDb
from netlens.sources.netdb import _type

def plainly(value):
    """An encoder of its own, by the format's rules: a control byte of kind and size, longer sizes and kinds in the bytes
    that follow, big-endian payloads without leading zeros. Numbers are (kind, number)."""

    def control(kind, size):
        low, tail = (size, b"") if size < 29 else (29, bytes([size - 29])) if size < 285 else (30, (size - 285).to_bytes(2, "big"))
        return (bytes([(kind << 5) + low]) if kind <= 7 else bytes([low, kind - 7])) + tail

    if isinstance(value, bool):
        return control(14, int(value))
    if isinstance(value, str):
        return control(2, len(value.encode())) + value.encode()
    if isinstance(value, bytes):
        return control(4, len(value)) + value
    if isinstance(value, list):
        return control(11, len(value)) + b"".join(map(plainly, value))
    if isinstance(value, dict):
        return control(7, len(value)) + b"".join(plainly(k) + plainly(v) for k, v in value.items())
    kind, number = value
    if kind in (3, 15):
        return control(kind, 8 if kind == 3 else 4) + struct.pack(">d" if kind == 3 else ">f", number)
    raw = number.to_bytes(4, "big", signed=True) if number < 0 else number.to_bytes((number.bit_length() + 7) // 8, "big")
    return control(kind, len(raw)) + raw


#: Bytes written out by hand, with the value that they stand for.
LITERAL = [
    ("683fc4000000000000", 0.15625), ("68c004000000000000", -2.5), ("04083f400000", 0.75), ("a107", 7), ("a21234", 4660), ("01012a", 42), ("0401fffffc18", -1000),
    ("c301e240", 123456), ("05020102030405", 4328719365), ("0303010000", 65536), ("83090807", b"\x09\x08\x07"), ("436f7574", "out"), ("e1416b427639", {"k": "v9"}), ("0204a1070107", [7, True]),
]


@pytest.mark.parametrize(("hexed", "want"), LITERAL)
def test_bytes_by_hand(hexed, want):
    raw = bytes.fromhex(hexed)
    values = Values(raw)
    assert values.decode(0) == (want, len(raw))
    assert values.skip(0) == len(raw)


numbers = st.one_of(
    st.tuples(st.just(5), st.integers(0, 2**16 - 1)), st.tuples(st.just(6), st.integers(0, 2**32 - 1)), st.tuples(st.just(8), st.integers(-(2**31), 2**31 - 1)),
    st.tuples(st.just(9), st.integers(0, 2**64 - 1)), st.tuples(st.just(10), st.integers(0, 2**128 - 1)), st.tuples(st.just(3), st.floats(allow_nan=False)),
    st.tuples(st.just(15), st.floats(allow_nan=False, width=32)),
)
mixed = st.recursive(
    st.one_of(numbers, st.booleans(), st.text(max_size=400), st.binary(max_size=400)),
    lambda x: st.one_of(st.lists(x, max_size=40), st.dictionaries(st.text(max_size=8), x, max_size=5)),
    max_leaves=30,
)


def bare(value):
    """The value without the kinds of its numbers."""
    if isinstance(value, tuple):
        return value[1]
    if isinstance(value, dict):
        return {k: bare(v) for k, v in value.items()}
    return [bare(v) for v in value] if isinstance(value, list) else value


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_values_of_another_encoder(value):
    raw = plainly(value)
    assert Values(raw).decode(0) == (bare(value), len(raw))
    assert Values(raw).skip(0) == len(raw)


@pytest.mark.parametrize("count", [1023, 1024, 3000])
def test_large_containers_are_checked_first(count):
    good = plainly([(5, k % 9) for k in range(count)])
    assert Values(good).decode(0)[0] == [k % 9 for k in range(count)]
    bad = good[:-2] + b"\xa3abc"
    with pytest.raises(K.NetDbError, match="invalid Uint16 size: 3" if count >= 1024 else "the Uint16 size of 3 is invalid"):
        Values(bad + b"\x40" * 8).decode(0)
    table = plainly({f"k{j}": {"x": [True, "y"]} for j in range(count)})
    assert len(Values(table).decode(0)[0]) == count
    far = b"\x43abc" + plainly([(5, 1)] * count)[: -2 * count] + (b"\x20\x00") * count
    assert Values(far).decode(4)[0] == ["abc"] * count


def test_cursor_readers_and_sizes():
    raw = plainly({"b": True, "s": "t", "y": b"z", "f": (15, 0.5), "d": (3, 0.25), "i": (8, -3), "u": (6, 4), "n": (9, 5), "h": (10, 6), "l": [(5, 1), (5, 2), (5, 3)]})
    c = Cursor(Values(raw), 0)
    at = dict(c.items())
    assert c.size() == 10 and at["l"].size() == 3 and [e.read_uint()[0] for e in at["l"].elements()] == [1, 2, 3]
    got = at["b"].read_bool()[0], at["s"].read_string()[0], at["y"].read_bytes()[0], at["f"].read_float32()[0], at["d"].read_float64()[0], at["i"].read_int32()[0], at["h"].read_uint128()[0]
    assert got == (True, "t", b"z", 0.5, 0.25, -3, 6)
    assert at["f"].read_float()[0] == 0.5 and at["d"].read_float()[0] == 0.25 and at["n"].read_uint()[0] == 5 and at["i"].read_integer()[0] == -3 and at["u"].read_integer()[0] == 4
    for wrong in (at["s"].read_bool, at["b"].read_string, at["u"].read_int32, at["f"].read_float64, at["i"].read_uint, at["h"].read_integer, at["s"].size):
        with pytest.raises(UnexpectedKindError):
            wrong()


def test_mismatches_as_errors_of_types():
    plain = K.unmarshal_error(UnexpectedKindError(K.MAP, frozenset((K.STRING,))), "string")
    assert str(plain) == "cannot unmarshal Map (Kind) into type string"
    inside = K.unmarshal_error(ContextualError(7, "/a", UnexpectedKindError(K.BOOL, frozenset((K.STRING,)))), "string")
    assert isinstance(inside, ContextualError) and str(inside) == "at offset 7, path /a: cannot unmarshal Bool (Kind) into type string"
    other = InvalidDatabaseError("x")
    assert K.unmarshal_error(other, "string") is other
    deeper = ContextualError(7, "/a", other)
    assert K.unmarshal_error(deeper, "string") is deeper


def test_map_keys_of_other_types():
    from pyspark.sql import types as T

    from netlens.functions.decoders import whole_key

    values = Values(plainly({"by": {"12": "a", "7": "b"}}))
    kind = T.StructType([T.StructField("by", T.MapType(T.LongType(), T.StringType()), metadata={"key_decoder": "whole"})])
    assert compile_schema(kind, values, None, {"whole": whole_key})(0, 0)[0] == ({12: "a", 7: "b"},)
    with pytest.raises(ValueError, match="key decoder"):
        compile_schema(T.MapType(T.LongType(), T.StringType()), values)
    wrong = Values(plainly({"by": {"x": "a"}}))
    with pytest.raises(ContextualError, match="path /by/x: cannot unmarshal x"):
        wrong.record(0, compile_schema(kind, wrong, None, {"whole": whole_key}))
    with pytest.raises(ContextualError, match="did not return the cursor"):
        values.record(0, compile_schema(kind, values, None, {"whole": lambda c: (1, None)}))


@pytest.mark.parametrize("size", [28, 29, 284, 285, 65820, 65821, 70000])
def test_sizes_and_pointers(size):
    assert Values(w.encode("x" * size)).decode(0) == ("x" * size, len(w.encode("x" * size)))
    for target in (0, 2047, 2048, 526335, 526336, 134744063, 134744064):
        raw = w.pointer(target)
        v = Values(raw)
        kind, low, at = v.control(0)
        assert kind == K.POINTER and v.pointer(low, at) == (target, len(raw))


plain = st.recursive(
    st.one_of(st.booleans(), st.integers(-(2**31), 2**128 - 1), st.floats(allow_nan=False), st.text(max_size=40), st.binary(max_size=40)),
    lambda x: st.one_of(st.lists(x, max_size=5), st.dictionaries(st.text(max_size=8), x, max_size=5)),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(plain)
def test_round_trip(value):
    raw = w.encode(value)
    assert Values(raw).decode(0) == (value, len(raw))
    assert Values(raw).skip(0) == len(raw)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_garbage_gives_errors_only(raw):
    v = Values(raw)
    for call in (v.decode, v.skip, v.record):
        try:
            call(0)
        except K.NetDbError:
            pass


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(0, 200))
def test_broken_files_give_errors_only(noise, at):
    data = bytearray(w.build([("1.0.0.0/8", {"a": [1, 2]}), ("2.0.0.0/7", "x")], 4, 24))
    data[at : at + len(noise)] = noise
    try:
        db = NetDb.from_bytes(bytes(data))
        for r in db.networks(empty=True):
            if r.found:
                r.decode()
        db.lookup("1.2.3.4")
    except (K.NetDbError, ValueError):
        pass


def test_pointer_rules_and_depth():
    with pytest.raises(InvalidDatabaseError, match="pointer to pointer"):
        Values(w.pointer(2) + w.pointer(4) + w.encode(1)).decode(0)
    deep = b"\x01\x04" * 600 + w.encode(1)
    with pytest.raises(ContextualError, match="exceeded maximum data structure depth"):
        Values(deep).record(0)
    cyclic = b"\xe1" + w.encode("a") + w.pointer(0)
    with pytest.raises(ContextualError, match="depth"):
        Values(cyclic).record(0)
    with pytest.raises(InvalidDatabaseError, match="unexpected end of database"):
        Values(bytes([31, 4, 255, 255, 255])).decode(0)


def test_repeated_keys():
    raw = b"\xe2" + w.encode("a") + w.encode(1) + w.encode("a") + w.encode(2)
    v = Values(raw)
    assert v.decode(0)[0] == {"a": 2} and v.path(0, "a") == 1
    assert compile_schema(_type("a long"), v)(0, 0)[0] == (2,)


RECORD = {
    "ports": [w.u32(80), w.u32(443), w.u32(8080), w.u32(22)], "up": False, "mac": b"\x02\x42\xac\x11", "load": 0.375, "ratio": w.f32(0.1), "delta": w.i32(-77_000),
    "site": {"rack": {"slots": [w.u32(3), w.u32(5)], "label": "nørd 7"}}, "vlan": w.u16(4094), "asn": w.u32(4_200_000_001), "serial": w.u64(3**39), "token": w.u128(7**44), "title": "Ζεύς, 東京",
}


def reached(path):
    """What a path leads to in RECORD."""
    at = RECORD
    for step in path:
        if isinstance(step, str):
            at = at.get(step)
        else:
            at = at[step] if -len(at) <= step < len(at) else None
        if at is None:
            return None
    return getattr(at, "value", at)


PATHS = [("vlan",), ("title",), *((("ports", k)) for k in range(-6, 6)), ("site", "rack", "slots", 1), ("site", "rack", "slots", -2), ("site", "rack", "label"), ("absent", 4), ("site", "absent", "x")]


@pytest.mark.parametrize("size", [24, 28, 32])
@pytest.mark.parametrize("pointers", [False, True])
def test_record_paths_and_schemas(size, pointers):
    db = NetDb.from_bytes(w.build([("198.51.100.0/24", RECORD)], 6, size, pointers=pointers))
    r = db.lookup("198.51.100.77")
    for path in PATHS:
        assert r.decode_path(*path) == reached(path), path
    assert r.decode_path() == r.decode()
    with pytest.raises(InvalidDatabaseError, match="expected a map for x but found Slice"):
        r.decode_path("ports", "x")
    with pytest.raises(InvalidDatabaseError, match="expected a slice for 1 but found Map"):
        r.decode_path("site", 1)
    with pytest.raises(TypeError, match="unexpected path element at index 0"):
        r.decode_path(1.5)
    assert r.decode(_type("vlan int, token binary, site struct<rack:struct<slots:array<long>>>, absent string")) == (4094, (7**44).to_bytes(16), (([3, 5],),), None)
    assert r.decode(_type("load float, ratio double, serial decimal(20,0)"))[0] == 0.375
    for wrong in ("asn smallint", "delta string", "ports string", "site array<long>", "title long", "up int", "mac string"):
        with pytest.raises(ContextualError, match="cannot unmarshal"):
            r.decode(_type(wrong))
    assert infer_schema([r.decode()])["serial"].dataType.simpleString() == "bigint"


def test_field_metadata_and_custom_decoders():
    from pyspark.sql import types as T

    db = NetDb.from_bytes(w.build([("1.0.0.0/8", {"name": "abc", "deep": {"x": w.u32(5)}})], 4, 24))
    r = db.lookup("1.2.3.4")
    kind = T.StructType([T.StructField("n", T.StringType(), metadata={"key": "name", "decoder": "upper"}), T.StructField("deep", T.LongType(), metadata={"as": "offset"})])

    def upper(c: Cursor):
        text, after = c.read(K.STRING)
        return text.upper(), after

    name, at = r.decode(kind, {"upper": upper})
    assert name == "ABC" and db.lookup_offset(at).decode() == {"x": 5}
    with pytest.raises(ContextualError, match="did not return the cursor"):
        r.decode(kind, {"upper": lambda c: ("x", c)})
    with pytest.raises(ValueError, match="two fields"):
        r.decode(T.StructType([T.StructField("a", T.StringType(), metadata={"key": "name"}), T.StructField("name", T.StringType())]))
    c = r.cursor()
    assert dict((k, v.kind()) for k, v in c.items()) == {"name": K.STRING, "deep": K.MAP}
    with pytest.raises(UnexpectedKindError, match="unexpected kind Map, expected String"):
        c.read(K.STRING)
    assert K.kind_set_name(frozenset()) == "none" and K.kind_set_name(frozenset((K.MAP, K.STRING))) == "String or Map"


def test_unmarshal_error_text():
    assert str(UnmarshalTypeError(5, "Uint16", "string")) == "cannot unmarshal 5 (Uint16) into type string"


BASE4 = ["192.0.2.0/26", "192.0.2.64/28", "192.0.2.81/32", "192.0.2.128/25", "203.0.113.8/29"]
BASE6 = ["::2:0:0/115", "2001:db8:40::/44", "2400:cb00::/32", "fd00:7::1/128"]


def named(nets):
    return [(n, {"net": n}) for n in nets]


def shared(net):
    """An IPv4 network at the places of the IPv6 space that share its subtree."""
    n, bits = int(net.network_address), net.prefixlen
    return [ipaddress.IPv6Network((at, bits + more)) for at, more in ((0xFFFF << 32 | n, 96), (0x20010000 << 96 | n << 64, 32), (0x2002 << 112 | n << 80, 16))]


def parts(whole, nets):
    """whole, cut into the networks and the largest ones between them."""
    out = [whole]
    for n in nets:
        holder = next(x for x in out if n.subnet_of(x))
        out.remove(holder)
        out += [n, *holder.address_exclude(n)] if holder != n else [n]
    return sorted(out)


@pytest.mark.parametrize("size", [24, 28, 32])
class TestNetworks:
    def v4(self, size):
        return NetDb.from_bytes(w.build(named(BASE4), 4, size))

    def mixed(self, size):
        return NetDb.from_bytes(w.build(named(BASE4 + BASE6), 6, size))

    def test_scans(self, size):
        list_of = lambda it: [r.prefix for r in it]
        four = [ipaddress.ip_network(n) for n in BASE4]
        assert list_of(self.v4(size).networks()) == BASE4
        assert list_of(self.v4(size).networks(empty=True)) == [str(n) for n in parts(ipaddress.ip_network("0.0.0.0/0"), four)]
        db = self.mixed(size)
        assert list_of(db.networks()) == BASE4 + BASE6
        assert (db._db.v4_depth, db._db.has_v4) == (96, True)
        aliased = {ipaddress.ip_network(x) for x in list_of(db.networks(aliased=True))}
        assert aliased == {ipaddress.ip_network(n) for n in BASE4 + BASE6} | {x for n in four for x in shared(n)}
        assert list_of(db.networks_within("192.0.2.0/24", empty=True)) == [str(n) for n in parts(ipaddress.ip_network("192.0.2.0/24"), four[:4])]
        assert list_of(db.networks_within("192.0.2.34/24")) == BASE4[:4]
        assert list_of(db.networks_within("192.0.2.70/32")) == ["192.0.2.64/28"]
        assert list_of(db.networks_within("192.0.2.0/25")) == BASE4[:3]
        assert list_of(db.networks_within("2001:db8:47::/40")) == ["2001:db8:40::/44"]
        with pytest.raises(ValueError, match="IPv4-only"):
            list_of(self.v4(size).networks_within("::/0"))
        with pytest.raises(ValueError, match="invalid prefix"):
            list_of(db.networks_within("nonsense"))

    def test_lookups(self, size):
        db, rng = self.mixed(size), random.Random(size)
        nets = [ipaddress.ip_network(n) for n in BASE4]
        cut = parts(ipaddress.ip_network("0.0.0.0/0"), nets)
        ips = [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(30)] + [n[k] for n in nets for k in (0, -1)]
        for ip in ips:
            holder = next(n for n in cut if ip in n)
            value = {"net": str(holder)} if holder in nets else None
            r = db.lookup(ip)
            assert (r.prefix, r.found, r.decode()) == (str(holder), value is not None, value)
            if value:
                for at, one in zip(shared(holder), shared(ipaddress.ip_network(ip)), strict=True):
                    again = db.lookup(one[0])
                    assert (ipaddress.ip_network(again.prefix), again.decode()) == (at, value)
        six = parts(ipaddress.ip_network("::/0"), [ipaddress.ip_network(n) for n in BASE6[1:]])
        for ip in ("2001:db8:4f::1", "2400:cb00:ffff::", "fd00:7::1", "8123::5", "fe80::1"):
            holder = next(n for n in six if ipaddress.ip_address(ip) in n)
            assert (db.lookup(ip).prefix, db.lookup(ip).found) == (str(holder), str(holder) in BASE6)
        assert "IPv6 address in an IPv4-only database" in self.v4(size).lookup("::1").error
        assert self.v4(size).lookup("x").error == "invalid IP address"

    def test_random_tree_against_a_linear_search(self, size):
        rng = random.Random(size)
        nets = {}
        for _ in range(200):
            depth = rng.randrange(1, 33)
            net = ipaddress.ip_network((rng.getrandbits(32) >> (32 - depth) << (32 - depth), depth))
            nets[net] = str(net)
        db = NetDb.from_bytes(w.build([(str(n), {"n": v}) for n, v in nets.items()], 4, size))
        for _ in range(300):
            ip = ipaddress.IPv4Address(rng.getrandbits(32))
            best = max((n for n in nets if ip in n), key=lambda n: n.prefixlen, default=None)
            got = db.lookup(ip)
            assert got.decode() == ({"n": nets[best]} if best else None)
            assert ip in ipaddress.ip_network(got.prefix)


def test_tree_without_v4_part():
    db = NetDb.from_bytes(w.build([("::/40", "low"), ("c000::/3", "high")], 6, 28))
    for ip in ("198.51.100.9", "::198.51.100.9", "0:0:ff:ffff::1"):
        assert (db.lookup(ip).prefix, db.lookup(ip).decode()) == ("::/40", "low")
    assert (db.lookup("d123::").decode(), db.lookup("a000::").prefix, db.lookup("a000::").found) == ("high", "8000::/2", False)


def test_empty_values_and_closing():
    db = NetDb.from_bytes(w.build([("1.0.0.0/8", {}), ("2.0.0.0/8", []), ("3.0.0.0/8", {"a": True}), ("4.0.0.0/8", 0)], 4, 24))
    assert [r.prefix for r in db.networks(skip_empty_values=True)] == ["3.0.0.0/8", "4.0.0.0/8"]
    with_empty = [r.prefix for r in db.networks(skip_empty_values=True, empty=True)]
    assert "0.0.0.0/8" in with_empty and "1.0.0.0/8" not in with_empty
    r = db.lookup("3.1.1.1")
    db.close()
    db.close()
    for call, run in (("Lookup", lambda: db.lookup("1.1.1.1")), ("LookupOffset", lambda: db.lookup_offset(0)), ("Decode", r.decode), ("DecodePath", lambda: r.decode_path("a"))):
        with pytest.raises(K.ClosedDatabaseError, match=f"cannot call {call} on a closed database"):
            run()


def test_open_errors(tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(InvalidDatabaseError, match="file is empty"):
        NetDb.open(str(tmp_path / "empty"))
    with pytest.raises(InvalidDatabaseError, match="invalid database file"):
        NetDb.from_bytes(b"nothing here")
    good = w.build(named(BASE4), 4, 24)
    nodes = Database(good).metadata.node_count
    big = good.replace(w.encode("node_count") + w.encode(w.u32(nodes)), w.encode("node_count") + b"\x08\x02" + b"\xff" * 8)
    with pytest.raises(InvalidDatabaseError, match="overflow|invalid metadata"):
        NetDb.from_bytes(big)
    with pytest.raises(InvalidDatabaseError, match="invalid metadata"):
        NetDb.from_bytes(good.replace(w.encode("node_count") + w.encode(w.u32(nodes)), w.encode("node_count") + w.encode(w.u32(nodes * 100))))
    m = NetDb.from_bytes(w.build(named(BASE4), 4, 24, build_epoch=2**64 - 1))
    assert m.metadata.build_epoch == 2**64 - 1 and m.build_time is None
    assert Database(good).metadata.description == {"en": "Test Database"}


def test_bad_data_pointer():
    data = bytearray(w.build([("1.0.0.0/8", "x")], 4, 24))
    db = NetDb.from_bytes(bytes(data))
    n, at = db.metadata.node_count, None
    left, right = db._db.tree
    for side, rows in ((0, left), (3, right)):
        for k in range(n):
            if rows[k] > n:
                at = k * 6 + side
    data[at : at + 3] = (n + 16 + 5000).to_bytes(3)
    broken = NetDb.from_bytes(bytes(data))
    assert "corrupt" in broken.lookup("1.1.1.1").error and [r.error is None for r in broken.networks()] == [False]


def test_tree_deeper_than_addresses():
    data = bytearray(w.build([("128.128.128.128/32", "x")], 4, 24))
    db = NetDb.from_bytes(bytes(data))
    n = db.metadata.node_count
    last = next(k for k in range(n) if max(db._db.tree[0][k], db._db.tree[1][k]) > n)
    for side in (0, 3):
        data[last * 6 + side : last * 6 + side + 3] = last.to_bytes(3)
    errors = [r.error for r in NetDb.from_bytes(bytes(data)).networks()]
    assert any(e and e.startswith("invalid search tree at 128.128.128.12") for e in errors)
    assert NetDb.from_bytes(bytes(data)).lookup("128.128.128.128").error == "invalid node in search tree"


def test_later_and_longer_networks_win():
    nets = [("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("10.0.0.0/8", 3), ("10.1.2.0/24", 4), ("10.1.0.0/16", 5)]
    db = NetDb.from_bytes(w.build([(n, w.u32(v)) for n, v in nets], 4, 24))
    assert [db.lookup(ip).decode() for ip in ("10.9.9.9", "10.1.9.9", "10.1.2.3")] == [3, 5, 4]
    with pytest.raises(ValueError, match="whole tree"):
        w.build([("0.0.0.0/0", 1)], 4, 24)
    with pytest.raises(ValueError, match="too short"):
        w.pack(w.layout(*w.network_words(["1.0.0.0/8"], 4), w.np.array([1 << 24]), 4, True), 24)


def test_pieces_of_a_scan_are_the_scan(monkeypatch):
    from netlens.sources import scan as sc

    rng = random.Random(9)
    nets = {ipaddress.ip_network((rng.getrandbits(32) >> (32 - d) << (32 - d), d)): d for d in [rng.randrange(3, 33) for _ in range(400)]}
    db = NetDb.from_bytes(w.build([(str(n), w.u32(d)) for n, d in nets.items()], 6, 28))._db
    for options in (sc.Options(), sc.Options(aliased=True, empty=True)):
        start = sc.start_nodes(db, None)
        whole = sc.leaves(db, start, options)
        monkeypatch.setattr(sc, "LARGE", 1)
        pieces = list(sc.leaf_runs(db, start, options, levels=5, run=3))
        assert len(pieces) > 1
        for f in ("pointer", "hi", "lo", "depth"):
            assert (sc.np.concatenate([getattr(x, f) for x in pieces]) == getattr(whole, f)).all()


@settings(max_examples=1500, deadline=None)
@given(st.text("0123456789abfF:.%xé \0", max_size=24) | st.ip_addresses().map(str) | st.lists(st.sampled_from(["0", "1", "ffff", "", "10", "1.2.3.4", "00001", "g", "255", "256", "01"]), max_size=9).flatmap(lambda x: st.sampled_from([":".join(x), ".".join(x)])))
def test_addresses_are_read_as_the_library_reads_them(text):
    from netlens.functions.ipfns import parse

    family, hi, lo = parse([text])
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        ip = None
    if ip is None or "%" in text:
        assert family[0] == 0
    else:
        assert (family[0], int(hi[0]) << 64 | int(lo[0])) == (ip.version, int(ip))


@settings(max_examples=500, deadline=None)
@given(st.integers(0, 2**128 - 1) | st.lists(st.sampled_from([0, 0, 1, 0xFFFF, 0x2001]), min_size=8, max_size=8).map(lambda g: sum(x << 16 * k for k, x in enumerate(g))) | st.integers(0, 2**48))
def test_texts_of_addresses_are_the_library_s(n):
    from netlens.functions.ipfns import v6_text

    assert v6_text(n >> 64, n & 2**64 - 1) == str(ipaddress.IPv6Address(n))


def test_variants_are_those_of_their_json():
    import json
    import random
    import struct

    from pyspark.sql.types import VariantVal

    from netlens.codec import to_json_value, to_variant

    r = random.Random(7)
    plain = [True, False, 0, 127, 128, -129, 2**31, -(2**31), 2**63 - 1, 2**63, 2**64 - 1, 10**38 - 1, 10**38, 2**128 - 1, 0.0, -0.0, 903.0, 0.05, 1e15, 1e16, 1e-5, 0.0001, float("nan"), -float("inf"), 5e-324, "", "é漢😀\"", "x" * 63, "x" * 64, b"ab"]

    def value(depth):
        k = r.randrange(12 if depth < 4 else 8)
        if k < 7:
            return r.choice(plain)
        if k == 7:
            return struct.unpack("<d", r.randbytes(8))[0]
        size = 300 if r.random() < 0.03 else r.randrange(5)
        return [value(depth + 1) for _ in range(size)] if k < 10 else {r.choice(["a", "é", "", f"k{r.randrange(400)}"]): value(depth + 1) for _ in range(size)}

    for v in (*plain, *(value(0) for _ in range(1500)), {f"k{k}": k for k in range(70_000)}, ["x" * 70_000, {"b": 1, "a": 2}]):
        a, b = to_variant(v), VariantVal.parseJson(json.dumps(to_json_value(v)))
        assert (a.value, a.metadata) == (b.value, b.metadata)


def test_variants_come_in_batches():
    import pyarrow as pa
    from pyspark.sql import types as T

    from netlens.sources import scan as sc

    db = Database(w.build([("1.0.0.0/8", {"a": [w.u32(1), 2.5]})], 4, 24))
    (batch,) = sc.scan(db, sc.start_nodes(db, None), sc.Options(), T.VariantType())
    assert isinstance(batch, pa.RecordBatch) and set(batch.column("record")[0].as_py()) == {"value", "metadata"}


def test_encoders_made_once_are_the_plain_ones():
    import decimal

    kind = _type("struct<a:smallint,b:int,c:long,d:decimal(20,0),e:decimal(38,0),f:float,g:double,h:boolean,i:binary,repeated:string,again:array<struct<repeated:string,x:int>>,m:map<string,array<int>>>")
    rng = random.Random(4)
    pick = lambda *of: rng.choice((None, *of))
    for _ in range(300):
        v = {
            "a": pick(0, -1, 32767), "b": pick(0, -5, 2**31 - 1), "c": pick(0, -(2**31), 2**63 - 1), "d": pick(decimal.Decimal(2**64 - 1), decimal.Decimal(-3)), "e": pick(decimal.Decimal(10**38 - 1), decimal.Decimal(0)),
            "f": pick(0.5, -0.0), "g": pick(1e300, float("inf")), "h": pick(True, False), "i": pick(b"", b"x" * 300), "repeated": pick("repeated", "", "é" * 40, "long text"),
            "again": pick([], [{"repeated": "long text", "x": 1}, {"repeated": None, "x": None}]), "m": pick([], [("repeated", [1, 2])]),
        }
        for options in ((), (True,), (True, True), (False, True)):
            one, other = w.Encoder(*options), w.Encoder(*options)
            one.put(w.typed(v, kind))
            w.putter(kind)(other, v)
            assert one.out == other.out and one.fixes == other.fixes
    for bad in ({"x": [None]}, {"x": [-(2**40)]}):
        with pytest.raises(ValueError, match="null has no encoding|below what any"):
            w.putter(_type("struct<x:array<long>>"))(w.Encoder(), bad)
