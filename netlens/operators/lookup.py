"""Longest-prefix lookup as joins.

Leaves of a search tree never overlap, so at most one network holds an address. Four strategies give the same rows:
  tree  Arrow batches walk the file itself: no shuffle, each address of a batch once     [lookup(), and streams]
  equi  explode the address over the prefix lengths that occur, mask, equi-join on (depth, words); where the networks
        are too many to broadcast, distinct addresses only are exploded and shuffled     [default of lookup_join]
  range join on net_start <= address <= net_end                                          [few networks; beyond: equi]
  asof  union, last network at or before the address in its bucket of top bits           [where no task can read the file]
The networks side must be a scan with empty and aliased networks, as a miss still has a network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.ipfns import parse, with_address, word_bytes
from netlens.kinds import InvalidDatabaseError
from netlens.sources.files import open_database
from netlens.sources.netdb import read
from netlens.sources.scan import Records, arrow_type, as_dicts
from netlens.sources.scan import lookup as walk

BUCKET = 16
#: Bytes, as measured, up to which the networks are broadcast, and networks up to which a range join may loop over them.
BYTES, FEW = 32 << 20, 10_000
ADDED = ("found", "network", "record_offset", "error")


def networks_for_lookup(spark: SparkSession, path: str, record: str | None = None, variant: bool = False) -> DataFrame:
    return read(spark, path, includeEmpty=True, includeAliased=True, recordSchema=record, recordAs="variant" if variant else None)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _lengths(nets: DataFrame) -> list:
    """Prefix lengths with the number and bytes of their networks, at most 258 rows."""
    size = F.lit(200).cast("long")
    if "record" in nets.columns:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct("record"))), F.lit(0))
    return nets.groupBy("depth", F.col("network_v4").isNotNull().alias("v4")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()


def _by_length(addresses: DataFrame, nets: DataFrame, found: list) -> DataFrame:

    def masks(depths: set[int]) -> Column:
        out = []
        for d in sorted(depths):
            m = ((1 << 128) - 1) ^ ((1 << (128 - d)) - 1)
            out.append(F.struct(F.lit(d).alias("d"), F.lit(_signed(m >> 64)).cast("long").alias("mh"), F.lit(_signed(m & (1 << 64) - 1)).cast("long").alias("ml")))
        return F.array(*out) if out else F.array().cast("array<struct<d:int,mh:long,ml:long>>")

    # An IPv4 address only meets networks of the IPv4 part of the tree.
    lengths = F.when(F.col("_family") == 4, masks({r["depth"] for r in found if r["v4"]})).otherwise(masks({r["depth"] for r in found}))
    probe = addresses.withColumn("_m", F.explode(lengths))
    probe = probe.withColumn("_kh", F.col("_hi").bitwiseAND(F.col("_m.mh"))).withColumn("_kl", F.col("_lo").bitwiseAND(F.col("_m.ml")))
    # Sizes before the explode say nothing of the probes, which must never be the side that is broadcast.
    side = F.broadcast(nets) if sum(r["bytes"] for r in found) <= BYTES else nets.hint("merge")
    hit = probe.join(side, (F.col("_m.d") == F.col("depth")) & (F.col("_kh") == F.col("hi")) & (F.col("_kl") == F.col("lo")))
    return hit.drop("_m", "_kh", "_kl")


def _by_equi(addresses: DataFrame, nets: DataFrame) -> DataFrame:
    found = _lengths(nets)
    if sum(r["bytes"] for r in found) <= BYTES:
        return _by_length(addresses, nets, found)
    key = ["_family", "_hi", "_lo"]
    return addresses.join(_by_length(addresses.select(*key).distinct(), nets, found), key)


def _by_range(addresses: DataFrame, nets: DataFrame) -> DataFrame:
    at = word_bytes(F.col("_hi"), F.col("_lo"))
    return addresses.withColumn("_b", at).join(nets, (F.col("_b") >= F.col("net_start")) & (F.col("_b") <= F.col("net_end"))).drop("_b")


def _by_asof(addresses: DataFrame, nets: DataFrame, columns: list[str]) -> DataFrame:
    """Buckets are the top bits within each family's part of the space; networks wider than a bucket go to each."""
    v4 = lambda hi, lo: (hi == 0) & (F.shiftrightunsigned(lo, 32) == 0)
    bucket = lambda hi, lo: F.when(v4(hi, lo), F.shiftrightunsigned(lo, 32 - BUCKET)).otherwise(F.shiftrightunsigned(hi, 64 - BUCKET) + (1 << BUCKET))
    net = F.struct(*[F.col(c) for c in columns])
    a = addresses.select(word_bytes(F.col("_hi"), F.col("_lo")).alias("_at"), F.struct(*addresses.columns).alias("_row"), F.lit(None).cast(nets.select(net.alias("n")).schema["n"].dataType).alias("_net"), bucket(F.col("_hi"), F.col("_lo")).alias("_k"))
    span4, span6 = F.greatest(F.lit(0), F.lit(96 + BUCKET) - F.col("depth")), F.greatest(F.lit(0), F.lit(BUCKET) - F.col("depth"))
    own4 = F.sequence(bucket(F.lit(0).cast("long"), F.col("lo")), F.shiftrightunsigned("lo", 32 - BUCKET) + F.call_function("shiftleft", F.lit(1).cast("long"), span4.cast("int")) - 1)
    wide6 = F.sequence(F.shiftrightunsigned("hi", 64 - BUCKET) + (1 << BUCKET), F.shiftrightunsigned("hi", 64 - BUCKET) + (1 << BUCKET) + F.call_function("shiftleft", F.lit(1).cast("long"), span6.cast("int")) - 1)
    all4 = F.sequence(F.lit(0).cast("long"), F.lit((1 << BUCKET) - 1).cast("long"))
    inside, above = v4(F.col("hi"), F.col("lo")) & (F.col("depth") >= 96), v4(F.col("hi"), F.col("lo")) & (F.col("depth") < 96)
    keys = F.when(inside, own4).when(above, F.concat(all4, wide6)).otherwise(wide6)
    b = nets.select(F.col("net_start").alias("_at"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), net.alias("_net"), F.explode(keys).alias("_k"))
    last = Window.partitionBy("_k").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = a.unionByName(b).withColumn("_net", F.last("_net", ignorenulls=True).over(last)).where("_row is not null and _net is not null and _at <= _net.net_end")
    return hit.select("_row.*", "_net.*")


def lookup_join(df: DataFrame, ip: str, nets: DataFrame, strategy: str = "equi", ip_version: int = 6) -> DataFrame:
    """df with found, network, record_offset, error and, if nets has it, record, for the address texts in column ip.
    Every row of df stays, repeated rows and null addresses too."""
    record = [c for c in ("record",) if c in nets.columns]
    clash = [c for c in (*ADDED, *record) if c in df.columns]
    if clash:
        raise ValueError(f"columns {clash} are taken")
    cols = ["depth", "hi", "lo", "net_start", "net_end", "network_v4", "network_v6", "record_offset", "error", *record]
    side = nets.select(*cols)
    if any(c in df.columns for c in cols):
        raise ValueError(f"columns {sorted(set(cols) & set(df.columns))} are taken")
    keyed = with_address(df, ip)
    # The texts of addresses are parsed once: the rows that can't match are told apart here, not by a second join.
    usable = (F.col("_family") == 4) | ((F.col("_family") == 6) & F.lit(ip_version == 6))
    good = keyed.where(usable)
    few = strategy == "range" and side.limit(FEW + 1).count() <= FEW
    how = {"equi": lambda: _by_equi(good, side), "range": lambda: _by_range(good, side) if few else _by_equi(good, side), "asof": lambda: _by_asof(good, side, cols)}
    hit = how[strategy]().select(*df.columns, *_answer(record))
    bad = keyed.where(~usable)
    wrong = F.when(F.col("_family") == 6, F.concat(F.lit("error looking up '"), F.col(ip), F.lit("': you attempted to look up an IPv6 address in an IPv4-only database"))).otherwise(F.lit("invalid IP address"))
    null = [F.lit(None).cast(nets.schema[c].dataType).alias(c) for c in record]
    miss = bad.select(*df.columns, F.lit(False).alias("found"), F.lit(None).cast("string").alias("network"), F.lit(None).cast("long").alias("record_offset"), wrong.alias("error"), *null)
    return hit.unionByName(miss)


def _answer(record: list[str]) -> list[Column]:
    miss4 = F.when(F.col("depth") < 96, F.concat(F.lit("::/"), F.col("depth").cast("string"))).otherwise(F.col("network_v4"))
    shown = F.when((F.col("_family") == 4) & F.col("record_offset").isNull(), miss4).when(F.col("_family") == 4, F.col("network_v4")).otherwise(F.col("network_v6"))
    found = F.col("record_offset").isNotNull() & F.col("error").isNull()
    return [found.alias("found"), shown.alias("network"), F.col("record_offset"), F.col("error"), *(F.col(c) for c in record)]


def lookup_tree(df: DataFrame, ip: str, path: str, record: str | None = None) -> DataFrame:
    """The same rows by walking the file in Arrow batches: no shuffle, so it serves streams too."""
    from netlens.sources.netdb import _type

    kind = None if record is None else _type(record)
    schema = df.schema.jsonValue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = open_database(path)
        records = Records(db, kind)
        for b in batches:
            # Each address of a batch is read and looked up once, and so is each record.
            texts = pc.dictionary_encode(b.column(b.schema.names.index(ip)), null_encoding="encode")
            family, hi, lo = parse(texts.dictionary.to_pylist())
            at, _, nets, errors = walk(db, family, hi, lo)
            offsets, which = np.unique(at, return_inverse=True)
            got = [records.get(int(x)) if x >= 0 else (None, None) for x in offsets]
            errors = [e or got[w][1] for e, w in zip(errors, which.tolist(), strict=True)]
            more = [pa.array((at >= 0) & np.array([e is None for e in errors], bool)), pa.array(nets, pa.string()), pa.array(at, pa.int64(), mask=at < 0), pa.array(errors, pa.string())]
            more = [c.take(texts.indices) for c in more]
            names = [*b.schema.names, *ADDED]
            if kind is not None:
                values = pa.array([as_dicts(v, kind) for v, _ in got], arrow_type(kind))
                more.append(values.take(pa.array(which)).take(texts.indices))
                names.append("record")
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    out = T.StructType.fromJson(schema).add("found", "boolean").add("network", "string").add("record_offset", "long").add("error", "string")
    return df.mapInArrow(run, out if kind is None else out.add("record", kind))


def lookup(df: DataFrame, ip: str, path: str, record: str | None = None) -> DataFrame:
    """The default lookup: by walking the file, which every task that can read `path` does for itself."""
    return lookup_tree(df, ip, path, record)


def decode_offsets(df: DataFrame, offset: str, path: str, ddl: str, name: str = "value") -> DataFrame:
    """df with the value at an offset of the data section, be it a record or something inside one; null where the offset
    is. Each offset of a batch is decoded once."""
    from netlens.sources.netdb import _type

    kind = _type(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = Records(open_database(path), kind)
        for b in batches:
            at = pc.dictionary_encode(b.column(b.schema.names.index(offset)), null_encoding="encode")
            got = [records.get(x) for x in at.dictionary.to_pylist()]
            for _, wrong in got:
                if wrong:
                    raise InvalidDatabaseError(wrong)
            values = pa.array([as_dicts(v, kind) for v, _ in got], arrow_type(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, values.take(at.indices)], [*b.schema.names, name])

    return df.mapInArrow(run, T.StructType.fromJson(df.schema.jsonValue()).add(name, kind))


def with_records(networks: DataFrame, records: DataFrame) -> DataFrame:
    """Networks with the records that they point at, by an equi-join on the offset."""
    return networks.join(records.select("record_offset", "record"), "record_offset")
