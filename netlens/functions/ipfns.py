"""Addresses: text, words of the 128-bit space, and the Column helpers that joins are made of."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def ipv4_to_long(ip: Column) -> Column:
    """The number of an IPv4 text, null for anything else; all in the JVM."""
    p = F.split(ip, r"\.")
    part = lambda k: F.get(p, F.lit(k)).cast("long")
    value = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    return F.when(ip.rlike(V4), value)


def long_to_ipv4(n: Column) -> Column:
    part = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def mask_v4(n: Column, prefix_len: Column | int) -> Column:
    bits = F.lit(prefix_len) if isinstance(prefix_len, int) else prefix_len
    return n.bitwiseAND(F.expr("4294967295L") - (F.pow(F.lit(2.0), F.lit(32) - bits) - 1).cast("long"))


def _packed(text: str | None) -> bytes | None:
    """An address as 4 or 16 bytes, None for anything else; zones are no part of one."""
    if not text:
        return None
    for kind in (socket.AF_INET, socket.AF_INET6) if ":" not in text else (socket.AF_INET6,):
        try:
            return socket.inet_pton(kind, text)
        except (OSError, ValueError):
            pass
    return None


def parse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(family, high word, low word); family 0 where the text is no address."""
    raw = [_packed(t) for t in texts]
    family = np.array([0 if r is None else 4 if len(r) == 4 else 6 for r in raw], np.int32)
    whole = b"".join(bytes(16) if r is None else bytes(12) + r if len(r) == 4 else r for r in raw)
    words = np.frombuffer(whole, ">u8").astype(np.uint64).reshape(-1, 2)
    return family, words[:, 0], words[:, 1]


def v4_text(n: int) -> str:
    return f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"


def v6_text(hi: int, lo: int) -> str:
    if not hi and not lo >> 32:  # the system's text of these has dots
        return str(ipaddress.IPv6Address(lo))
    return socket.inet_ntop(socket.AF_INET6, hi.to_bytes(8) + lo.to_bytes(8))


def network_text(hi: int, lo: int, depth: int, v4: bool, v4_depth: int) -> str:
    """A network as an address of the family sees it; a leaf above the IPv4 subtree is a network of ::."""
    if not v4:
        return f"{v6_text(hi, lo)}/{depth}"
    return f"::/{depth}" if depth < v4_depth else f"{v4_text(lo & 0xFFFFFFFF)}/{depth - v4_depth}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(hexed: Column) -> Column:
    return F.conv(hexed, 16, -10).cast("long")


def ipv6_words(ip: Column) -> Column:
    """(h, l), the signed words of an IPv6 text, null for anything else; all in the JVM. Zones are no part of it."""

    def tail(text: Column) -> Column:
        """The text with a dotted tail as two groups."""
        n = ipv4_to_long(F.regexp_extract(text, r"^(.*:)([0-9.]+)$", 2))
        four = lambda v: F.lpad(F.hex(v), 4, "0")
        both = F.concat(F.regexp_extract(text, r"^(.*:)([0-9.]+)$", 1), four(F.shiftright(n, 16)), F.lit(":"), four(n.bitwiseAND(F.lit(65535))))
        return F.when(F.contains(text, F.lit(".")), both).otherwise(text)

    groups = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":", -1))
    join = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")

    def words(p: Column) -> Column:
        n = F.size(p["a"]) + F.size(p["b"])
        good = F.forall(F.concat(p["a"], p["b"]), lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$"))
        good = good & F.when(p["halves"] == 2, n <= 7).otherwise((p["halves"] == 1) & (n == 8))
        full = F.concat(join(p["a"]), F.repeat(F.lit("0000"), 8 - n), join(p["b"]))
        return F.when(good, let(full, lambda t: F.struct(_long(F.substring(t, 1, 16)).alias("h"), _long(F.substring(t, 17, 16)).alias("l"))))

    def parts(h: Column) -> Column:
        second = F.when(F.size(h) >= 2, F.get(h, F.lit(1))).otherwise(F.lit(""))
        return F.struct(F.size(h).alias("halves"), groups(F.get(h, F.lit(0))).alias("a"), groups(second).alias("b"))

    found = let(F.split(tail(ip), "::", -1), lambda h: let(parts(h), words))
    return F.when(F.contains(ip, F.lit(":")), found)


def with_address(df: DataFrame, ip: str) -> DataFrame:
    """df with _family (4, 6, or 0), _hi and _lo, the signed words of the address; no Python runs."""
    zero = F.lit(0).cast("long")

    def told(x: Column) -> Column:
        family = F.when(x["a"].isNotNull(), 4).when(x["b"].isNotNull(), 6).otherwise(0)
        return F.struct(family.alias("_family"), F.coalesce(x["b"]["h"], zero).alias("_hi"), F.coalesce(x["a"], x["b"]["l"], zero).alias("_lo"))

    v4 = ipv4_to_long(F.col(ip))
    # A generator, so that filters on the result don't read the text again.
    both = F.struct(v4.alias("a"), F.when(F.contains(F.col(ip), F.lit(":")), ipv6_words(F.col(ip))).alias("b"))
    return df.select(*df.columns, F.inline(F.array(let(both, told))))


def word_bytes(hi: Column, lo: Column) -> Column:
    """Two signed words as 16 bytes, whose order is the order of addresses."""
    return F.concat(F.unhex(F.lpad(F.hex(hi), 16, "0")), F.unhex(F.lpad(F.hex(lo), 16, "0")))


def words_binary(hi: np.ndarray, lo: np.ndarray) -> pa.Array:
    both = np.empty((len(hi), 2), ">u8")
    both[:, 0], both[:, 1] = hi, lo
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
