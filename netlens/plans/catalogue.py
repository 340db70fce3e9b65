"""The registered queries over network databases and the SQL that recomputes them from the same tables.

No table holds addresses, so each query builds a database from a dimension table (nations, parts, customers, suppliers)
in the shared folder, reads it back through the source and looks up addresses made of event keys. Nations are 25 at every
scale and their database is made on the driver; the others are written by tasks. The SQL knows nothing of trees or
encodings.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens import writer as w
from netlens.codec import Database
from netlens.functions.paths import decode_path
from netlens.functions.values import decode_value, error_at, is_container, kind_at
from netlens.kinds import NetDbError
from netlens.operators.lookup import decode_offsets, lookup, lookup_join, networks_for_lookup, with_records
from netlens.operators.verify import verify
from netlens.plans.session import configure, register_functions
from netlens.reader import NetDb
from netlens.sources.files import checkpointed, open_database, place, publish, remove, shared_folder
from netlens.sources.netdb import _type, from_binary, read, write

COUNTRY = "country struct<geoname_id:long,iso_code:string>, region_id int"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str, version: int = 4, size: int = 24, shift: int = 0, **options: object) -> str:
    """Nation k holds 10.k.0.0/16; every third one only the lower half."""
    rows = sorted(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())
    nets = [(f"10.{k}.0.0/{17 if k % 3 == 0 else 16}", {"country": {"geoname_id": w.u32(k + shift), "iso_code": name}, "region_id": w.u16(region)}) for k, name, region in rows]
    return publish(spark, w.build(nets, version, size, database_type="Geo", build_epoch=1770245369, **options), "geo")


def _address(prefix: str = "10.") -> Column:
    return F.concat(F.lit(prefix), (F.col("user_id") % 32).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".0"))


def _events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", *more)


def _located(spark: SparkSession, sf_dir: str, *more: str, strategy: str = "tree", path: str | None = None, version: int = 4) -> DataFrame:
    path = path or _geo(spark, sf_dir, version)
    events = _events(spark, sf_dir, *more).withColumn("ip", _address())
    if strategy == "tree":
        return lookup(events, "ip", path, f"struct<{COUNTRY}>")
    return lookup_join(events, "ip", networks_for_lookup(spark, path, COUNTRY), strategy, version)


def lookup_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _located(spark, sf_dir)
    return got.select("event_id", decode_path(F.col("record"), got.schema["record"].dataType, "country", "iso_code").alias("iso_code"))


def lookup_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a join of DataFrames."""
    return _located(spark, sf_dir, strategy="equi").select("event_id", F.col("record.country.iso_code").alias("iso_code"))


def lookup_v6_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c))
    ip = F.concat(F.lit("2002:"), hexed(2560 + F.col("user_id") % 32), F.lit(":"), hexed((F.col("event_id") % 256) * 256), F.lit("::1"))
    got = lookup(_events(spark, sf_dir).withColumn("ip", ip), "ip", _geo(spark, sf_dir, 6, 28), f"struct<{COUNTRY}>")
    return got.select("event_id", F.when(F.col("found"), F.col("network")).alias("network"), F.col("record.country.iso_code").alias("iso_code"))


def lookup_v6_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = networks_for_lookup(spark, _geo(spark, sf_dir, 6, 32), COUNTRY)
    got = lookup_join(_events(spark, sf_dir).withColumn("ip", _address("::ffff:10.")), "ip", nets, "equi", 6)
    return got.select("event_id", F.when(F.col("found"), F.col("network")).alias("network"), F.col("record.country.geoname_id").alias("geoname_id"))


def lookup_miss_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).where(~F.col("found")).select("event_id", "network")


def lookup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a network holds: every event has one answer, so a semi-join is a filter on it."""
    return _located(spark, sf_dir).where("found").select("event_id")


def lookup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).where(~F.col("found")).select("event_id")


def lookup_strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that any strategy gives more often than another."""
    path, names = _geo(spark, sf_dir), ("tree", "equi", "range", "asof")
    cols = ["event_id", "found", "network", F.col("record.country.geoname_id").alias("geoname_id")]
    parts = [_located(spark, sf_dir, strategy=s, path=path).select(*cols, F.lit(s).alias("by")) for s in names]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    counts = rows.groupBy("event_id", "found", "network", "geoname_id").agg(*(F.count_if(F.col("by") == s).alias(s) for s in names))
    return counts.where(F.greatest(*names) > F.least(*names)).agg(F.count("*").alias("differences"))


def lookup_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that are none, or of a family that the database doesn't hold."""
    nets = networks_for_lookup(spark, _geo(spark, sf_dir), COUNTRY)
    ip = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.300."), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.lit("2001:db8::1"))
    got = lookup_join(_events(spark, sf_dir).withColumn("ip", ip), "ip", nets, "equi", 4)
    return got.select("event_id", "found", "error")


def scan_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, _geo(spark, sf_dir)).select("network", F.col("prefix_len").cast("long").alias("prefix_len"), "v4_start", "v4_end")


def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks with their rank in address order."""
    return read(spark, _geo(spark, sf_dir, 6)).select("network", F.row_number().over(Window.orderBy("net_start")).cast("long").alias("place"))


def scan_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _geo(spark, sf_dir)
    inside = read(spark, path, within="10.9.1.0/13").select(F.lit("range").alias("part"), "network")
    return inside.unionByName(read(spark, path, within="10.4.5.0/24").select(F.lit("containing").alias("part"), "network"))


def _suppliers(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("s_suppkey")
    network = F.concat_ws(".", F.lit("30"), F.shiftright(k, 8).cast("string"), k.bitwiseAND(F.lit(255)).cast("string"), F.lit("0/24"))
    rows = _table(spark, sf_dir, "supplier").select(network.alias("network"), F.struct(k.cast("int").alias("suppkey")).alias("record"))
    return write(rows, place(spark, "suppliers"), ip_version=4)


def scan_within_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _suppliers(spark, sf_dir)
    return read(spark, path, within="30.0.0.0/17", recordSchema="suppkey long").select("network", F.col("record.suppkey").alias("suppkey"))


def scan_include_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read(spark, _geo(spark, sf_dir), within="10.0.0.0/11", includeEmpty=True)
    return got.select("network", F.col("record_offset").isNotNull().alias("has_data"))


def scan_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, _geo(spark, sf_dir, 6), includeAliased=True).select("network")


def scan_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return read(spark, _geo(spark, sf_dir), pushdown=True).where((F.col("v4_start") >= 168296448) & (F.col("v4_end") <= 168689663)).select("network")


def scan_pushed_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on the 128-bit address, and the filter that hides empty networks, reach the scan."""
    configure(spark)
    nets = read(spark, _geo(spark, sf_dir, 6), pushdown=True, includeEmpty=True)
    low, high = (F.lit((10 << 24 | k << 16).to_bytes(16)) for k in (8, 14))
    return nets.where((F.col("net_start") >= low) & (F.col("net_end") < high) & F.col("record_offset").isNotNull()).select("network")


def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first networks in address order; the scan stops there."""
    return read(spark, _geo(spark, sf_dir)).select("network").limit(3)


def scan_uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, not mapped, and without a memory of records."""
    got = read(spark, _geo(spark, sf_dir), recordSchema=COUNTRY, cache=False, mapped=False)
    return got.select("network", F.col("record.country.iso_code").alias("iso_code"))


def scan_binary_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database out of a binary column."""
    files = spark.read.format("binaryFile").load(_geo(spark, sf_dir))
    return from_binary(files, "content", f"struct<{COUNTRY}>").select("network", F.col("record.country.geoname_id").alias("geoname_id"))


def scan_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return spark.sql(f"SELECT network, CAST(prefix_len AS BIGINT) AS prefix_len FROM networks_within('{_geo(spark, sf_dir)}', '10.8.0.0/13')")


def _customers(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("c_custkey")
    part = lambda n: F.shiftright(k, n).bitwiseAND(F.lit(255)).cast("string")
    network = F.concat_ws(".", (F.shiftright(k, 16) + 20).cast("string"), part(8), part(0), F.lit("0/24"))
    record = F.struct(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return write(_table(spark, sf_dir, "customer").select(network.alias("network"), record.alias("record")), place(spark, "customers"), ip_version=4)


def scan_skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, _customers(spark, sf_dir), skipEmptyValues=True, recordSchema="segment string").select("network", F.col("record.segment").alias("segment"))


def records_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = read(spark, _customers(spark, sf_dir))
    return nets.agg(F.count("*").alias("networks"), F.countDistinct("record_offset").alias("records"))


def offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _customers(spark, sf_dir)
    both = with_records(read(spark, path).select("network", "record_offset"), read(spark, path, "records", recordSchema="segment string"))
    return both.groupBy(F.coalesce("record.segment", F.lit("none")).alias("segment")).agg(F.count("*").alias("networks"))


def _parts(spark: SparkSession, sf_dir: str) -> str:
    k, name = F.col("p_partkey"), F.col("p_name")
    part = lambda n: F.shiftright(k, n).bitwiseAND(F.lit(255)).cast("string")
    whole = lambda n, digits: (k.cast("decimal(10,0)") * F.lit(Decimal(n))).cast(f"decimal({digits},0)")
    record = F.struct(
        whole(1 << 40, 20).alias("key"), name.alias("name"), F.col("p_size").cast("smallint").alias("size"), F.col("p_retailprice").cast("double").alias("price"),
        F.substring(name.cast("binary"), 1, 4).alias("raw"), (k % 2 == 1).alias("odd"), (-k).cast("int").alias("neg"), (k / 2).cast("float").alias("half"),
        whole(1 << 100, 38).alias("big"), F.slice(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda j: (k + j).cast("int")), 1, (1 + k % 3).cast("int")).alias("tags"),
        F.struct(F.array(F.struct(name.alias("v"))).alias("list")).alias("deep"),
    )
    network = F.concat_ws(".", F.lit("40"), part(16), part(8), F.concat(part(0), F.lit("/32")))
    return write(_table(spark, sf_dir, "part").select(network.alias("network"), record.alias("record")), place(spark, "parts"), pointers=True, ip_version=4, record_size=32)


PART = "key decimal(20,0), name string, size int, price double, raw binary, odd boolean, neg int, half float, big binary, tags array<long>, deep struct<list:array<struct<v:string>>>"


def decode_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, _parts(spark, sf_dir), recordSchema=PART).select("record.*")
    return r.select(
        (-F.col("neg")).cast("long").alias("partkey"), F.col("key").cast("string").alias("u64"), "name", F.col("size").cast("long").alias("size"), "price",
        F.decode("raw", "utf-8").alias("raw"), F.col("odd").cast("long").alias("odd"), F.col("half").cast("double").alias("half"), F.hex("big").alias("u128"),
    )


def decode_path_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, _parts(spark, sf_dir), recordSchema=PART)
    at = lambda *p: decode_path(F.col("record"), df.schema["record"].dataType, *p)
    return df.select((-at("neg")).cast("long").alias("partkey"), at("tags", 0).alias("first"), at("tags", 2).alias("third"), at("tags", -1).alias("last"), at("tags", -3).alias("minus3"), at("deep", "list", 0, "v").alias("v"), at("nothing", 1).cast("string").alias("absent"))


def decode_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, _parts(spark, sf_dir), recordAs="variant")
    at = lambda *p: decode_path(F.col("record"), _type("variant"), *p, strict=False)
    return df.select((-at("neg").cast("long")).alias("partkey"), at("tags", -1).cast("long").alias("last"), at("deep", "list", 0, "v").cast("string").alias("v"), at("name", 1).cast("string").alias("absent"))


def kinds_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, _parts(spark, sf_dir), recordSchema="tags array<long>, odd boolean")
    return df.groupBy(F.size("record.tags").cast("long").alias("tags"), F.col("record.odd").cast("long").alias("odd")).agg(F.count("*").alias("n"))


def _hexed(n: Column, digits: int) -> Column:
    return F.unhex(F.lpad(F.hex(n), digits, "0"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a column of encoded values: brand, size, whether it is odd, then the brand by pointers in a map, in a
    slice and plainly; `at` has where each begins."""
    brand, k = F.col("p_brand").cast("binary"), F.col("p_partkey")
    text = F.concat(_hexed(64 + F.length(brand), 2), brand)
    odd = F.when(k % 2 == 1, F.unhex(F.lit("0107"))).otherwise(F.unhex(F.lit("0007")))
    data = F.concat(text, F.unhex(F.lit("A2")), _hexed(F.col("p_size"), 4), odd, F.unhex(F.lit("E141612000")), F.unhex(F.lit("01042000")), F.unhex(F.lit("2000")))
    end = F.length(text)
    return _table(spark, sf_dir, "part").select(k, data.alias("data"), F.array(F.lit(0), end, end + 3, end + 5, end + 10, end + 14).alias("at"))


def kinds_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds at offsets, behind pointers; nothing is decoded."""
    rows = _encoded(spark, sf_dir).select("data", F.explode("at").alias("at"))
    return rows.groupBy(kind_at(F.col("data"), F.col("at")).alias("kind")).agg(F.count("*").alias("n")).withColumn("container", is_container(F.col("kind")).cast("long"))


def decode_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at offsets of a binary column."""
    at = lambda k, ddl: decode_value(F.col("data"), F.col("at")[k], ddl)
    return _encoded(spark, sf_dir).select(
        F.col("p_partkey").cast("long").alias("partkey"), at(0, "string").alias("brand"), at(1, "long").alias("size"), at(2, "boolean").cast("long").alias("odd"),
        F.element_at(at(3, "map<string,string>"), "a").alias("in_map"), F.get(at(4, "array<string>"), F.lit(0)).alias("in_slice"), at(5, "string").alias("pointed"),
    )


def decode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64- and 128-bit numbers, whole, of encoded values: one of 8 bytes, then one of 16."""
    k = F.col("o_orderkey")
    data = F.concat(F.unhex(F.lit("0802")), _hexed(k, 8), F.unhex(F.lit("000000071003")), _hexed(k, 16), _hexed(k, 16))
    rows = _table(spark, sf_dir, "orders").select(data.alias("data"))
    return rows.select(decode_value(F.col("data"), F.lit(0), "decimal(20,0)").cast("string").alias("u64"), decode_value(F.col("data"), F.lit(10), "decimal(38,0)").cast("string").alias("u128"))


def lazy_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a part of the record lies, decoded later."""
    path = _geo(spark, sf_dir)
    kind = T.StructType([T.StructField("country", T.LongType(), metadata={"as": "offset"})])
    nets = read(spark, path, recordSchema=kind.json()).select("network", F.col("record.country").alias("at"))
    return decode_offsets(nets, "at", path, "struct<iso_code:string>").select("network", F.col("value.iso_code").alias("iso_code"))


def _decoded(spark: SparkSession, path: str, *fields: T.StructField, **decoders: str) -> DataFrame:
    named = {k: f"netlens.functions.decoders:{v}" for k, v in decoders.items()}
    return read(spark, path, recordSchema=T.StructType(list(fields)).json(), decoders=json.dumps(named), mode="PERMISSIVE")


def decode_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom decoders, by name from the schema's metadata."""
    fields = [T.StructField("country", T.StringType(), metadata={"decoder": "json"}), T.StructField("region_id", T.StringType(), metadata={"decoder": "number"})]
    return _decoded(spark, _geo(spark, sf_dir), *fields, json="as_json", number="number_text").select("network", "record.country", "record.region_id")


def decode_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older kind of custom decoder, which gives way to the newer one where a field names both."""
    fields = [T.StructField("country", T.StringType(), metadata={"legacy_decoder": "old"}), T.StructField("n", T.StringType(), metadata={"key": "region_id", "decoder": "number", "legacy_decoder": "old"})]
    return _decoded(spark, _geo(spark, sf_dir), *fields, old="initials", number="number_text").select("network", F.col("record.country").alias("initial"), F.col("record.n").alias("region_id"))


def decode_custom_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder that meets another kind fails as decoding into its type does, with the place and the path."""
    inner = T.StructType([T.StructField("n", T.LongType(), metadata={"key": "iso_code", "decoder": "strict"})])
    got = _decoded(spark, _geo(spark, sf_dir), T.StructField("country", inner), strict="strict_long")
    return got.select("network", F.regexp_replace("error", "offset [0-9]+", "offset N").alias("error"))


def decode_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and numbers of entries by cursors that skip what is inside."""
    fields = [T.StructField(n, T.StringType(), metadata={"decoder": "shape"}) for n in ("country", "region_id")]
    return _decoded(spark, _geo(spark, sf_dir), *fields, shape="shape").select("network", "record.country", "record.region_id")


def decode_map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps whose keys are numbers, by a decoder of keys."""
    k = F.col("n_nationkey")
    record = F.struct(F.create_map(k.cast("string"), F.col("n_name"), (k + 100).cast("string"), F.lit("more")).alias("by"))
    rows = _table(spark, sf_dir, "nation").select(F.concat(F.lit("60."), k.cast("string"), F.lit(".0.0/16")).alias("network"), record.alias("record"))
    path = write(rows, place(spark, "keys"), ip_version=4, record_size=24)
    got = _decoded(spark, path, T.StructField("by", T.MapType(T.LongType(), T.StringType()), metadata={"key_decoder": "whole"}), whole="whole_key")
    return got.select("network", F.explode("record.by").alias("k", "v"))


def decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of bytes that break the format; a large container is refused as a whole, whatever comes before."""
    many = lambda n, one: bytes([30, 4]) + (n - 285).to_bytes(2) + one
    cases = [
        ("bool", b"\x02\x07"), ("depth", b"\x01\x04" * 600 + b"\x41a"), ("double", b"\x64abcd"), ("end", b"\x45ab"), ("impossible", bytes([31, 4, 255, 255, 255])),
        ("key", b"\xe1\xa1\x05\x41a"), ("large", many(1024, b"\x41a" * 1023 + b"\xa3abc")), ("large_end", many(1100, b"\x41a" * 600)), ("large_key", bytes([7 << 5 | 30]) + (600 - 285).to_bytes(2) + b"\x41a\x41a" * 599 + b"\x01\x07\x41a"),
        ("pointer", b"\x20\x02\x20\x04\x41a"), ("sound", many(1024, b"\x41a" * 1024)), ("uint16", b"\xa3abc"), ("unknown", b"\x00\x05"),
    ]
    rows = spark.createDataFrame([(name, bytearray(data)) for name, data in cases], "name string, data binary")
    return rows.select("name", error_at(F.col("data"), F.lit(0)).alias("error"))


def _bent(spark: SparkSession, data: bytes, name: str, side: int) -> str:
    """A database whose first record that leads to data leads beyond it."""
    db, out = Database(data), bytearray(data)
    n, width = db.metadata.node_count, db.metadata.record_size // 8
    node = int((db.tree[side] > n).argmax())
    at = (2 * node + side) * width
    out[at : at + width] = (n + 5000).to_bytes(width)
    return publish(spark, bytes(out), name)


def _two(description: dict | None = None, second: object = "c") -> bytes:
    return w.build([("1.0.0.0/8", {"a": "b"}), ("2.0.0.0/8", {"a": second})], 4, 24, description=description)


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a scan as rows: a tree that leads nowhere, and a value that the wanted type can't hold."""
    bent = read(spark, _bent(spark, _two(), "bent", 1), mode="PERMISSIVE", recordSchema="a string").select(F.lit("tree").alias("part"), "network", "error", F.col("record.a").alias("a"))
    path = publish(spark, _two(second=w.u32(5)), "two")
    kept = read(spark, path, mode="PERMISSIVE", recordSchema="a string").select(F.lit("kind").alias("part"), "network", "error", F.col("record.a").alias("a"))
    return bent.unionByName(kept)


def open_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening and using a database says, in one process."""
    good, closed = _two(), NetDb.from_bytes(_two())
    closed.close()
    nodes = Database(good).metadata.node_count
    field = lambda n: w.encode("node_count") + w.encode(w.u32(n))
    folder = publish(spark, b"", "nothing")
    cases = {
        "bytes": lambda: NetDb.from_bytes(good).lookup("1.2.3.4").decode_path("a"), "closed": lambda: closed.lookup("1.2.3.4"), "empty": lambda: open_database(folder), "no_metadata": lambda: NetDb.from_bytes(b"no database"),
        "offset": lambda: NetDb.from_bytes(good).lookup_offset(0).decode_path("a"), "too_many_nodes": lambda: NetDb.from_bytes(good.replace(field(nodes), field(nodes + 1000))),
    }

    def said(case: Callable[[], object]) -> str:
        try:
            return str(case())
        except NetDbError as e:
            return str(e)

    return spark.createDataFrame([(name, said(case)) for name, case in cases.items()], "name string, said string")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, _geo(spark, sf_dir), "metadata")
    return m.select(
        "database_type", F.col("ip_version").cast("long").alias("ip_version"), F.col("record_size").cast("long").alias("record_size"), F.col("build_epoch").cast("long").alias("build_epoch"),
        F.date_format("build_time", "yyyy-MM-dd HH:mm:ss").alias("build_time"), F.col("description")["en"].alias("description"), F.element_at("languages", 1).alias("language"),
        (F.col("search_tree_bytes") - F.col("node_count") * 6).alias("rest"),
    )


def verify_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(spark, _geo(spark, sf_dir, 6, 28)).agg(F.count("*").alias("findings"))


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database without description, with a byte in the separator and a value that nothing points to."""
    data = bytearray(_two({}))
    tree = Database(bytes(data)).tree_bytes
    data[tree] = 1
    at = data.rfind(b"\xab\xcd\xef")
    broken = bytes(data[:at]) + w.encode({"stray": [1, "x"]}) + bytes(data[at:])
    return verify(spark, publish(spark, broken, "broken")).select(F.col("rank").cast("long").alias("rank"), "name", "message")


def verify_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree that leads beyond the data, and a text that is no UTF-8."""
    tree = verify(spark, _bent(spark, _two(), "bent", 1)).select(F.lit("tree").alias("part"), "message")
    text = verify(spark, publish(spark, _two(second="\udcff"), "text")).select(F.lit("text").alias("part"), "message")
    return tree.unionByName(text)


def agg_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _located(spark, sf_dir, "value").where("found")
    return got.groupBy(F.col("record.country.iso_code").alias("iso_code")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("value").alias("most"))


def cube_country_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _located(spark, sf_dir, "event_type").where("found").select(F.col("record.region_id").cast("long").alias("region_id"), "event_type")
    return got.cube("region_id", "event_type").agg(F.count("*").alias("n"))


def topk_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _located(spark, sf_dir).where("found").groupBy(F.col("record.country.iso_code").alias("iso_code")).agg(F.count("*").alias("n"))
    return got.orderBy(F.desc("n"), "iso_code").limit(5)


def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy("v4_start")  # one row per network of a small table
    nets = read(spark, _geo(spark, sf_dir)).select("v4_end", F.lead("v4_start").over(order).alias("next"))
    return nets.where("next > v4_end + 1").select((F.col("v4_end") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"))


def db_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks whose record differs between two builds, both ways."""
    old = read(spark, _geo(spark, sf_dir), recordSchema=COUNTRY).select("network", F.col("record.country.geoname_id").alias("geoname_id"))
    new = read(spark, _geo(spark, sf_dir, shift=100), recordSchema=COUNTRY).select("network", F.col("record.country.geoname_id").alias("geoname_id"))
    gone = old.exceptAll(new).withColumn("change", F.lit("removed"))
    return gone.unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def stream_enrich_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, located by walking the file, counted by hour and country."""
    from netlens.streaming.enrich import enrich, windowed_counts

    folder = f"{shared_folder(spark)}/netlens-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    got = enrich(stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ip", _address()), "ip", _geo(spark, sf_dir), f"struct<{COUNTRY}>").where("found")
    counts = windowed_counts(got.withColumn("iso_code", F.col("record.country.iso_code")), "ts", ["iso_code"], "1 hour", "10 minutes")
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "iso_code", "n")
    sink = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out")
    flat.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = checkpointed(spark.read.schema("hour string, iso_code string, n long").parquet(f"{folder}/out"))
    remove(spark, folder)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lookup_country, lookup_equi, lookup_v6_alias, lookup_v6_mapped, lookup_miss_network, lookup_semi, lookup_anti, lookup_strategies_agree, lookup_errors, scan_networks, scan_ordered,
        scan_within, scan_within_suppliers, scan_include_empty, scan_aliased, scan_pushed, scan_pushed_v6, scan_limit, scan_uncached, scan_binary_column, scan_udtf, scan_skip_empty, records_dedup, offset_join, decode_types, decode_path_array,
        decode_variant, kinds_histogram, kinds_of_values, decode_at_offset, decode_orders, lazy_offset, decode_custom, decode_legacy, decode_custom_errors, decode_shapes, decode_map_keys,
        decode_errors, error_rows, open_errors, metadata, verify_clean, verify_findings, verify_broken, agg_by_country, cube_country_type, topk_country, gap_detection, db_diff, stream_enrich_window,
    )
}

_ON = "n.n_nationkey = e.user_id % 32 AND (n.n_nationkey % 3 <> 0 OR e.event_id % 256 < 128)"
_HALF = "n_nationkey % 3 = 0"
_NETS = f"SELECT n_nationkey AS k, '10.' || n_nationkey || '.0.0/' || CASE WHEN {_HALF} THEN 17 ELSE 16 END AS network FROM nation"
_IP = "(10 * 16777216 + n_nationkey * 65536)"

_END = "unexpected end of database"

ORACLE_SQL: dict[str, str] = {
    "lookup_equi": f"SELECT e.event_id, n.n_name AS iso_code FROM events e LEFT JOIN nation n ON {_ON}",
    "scan_pushed_v6": f"SELECT network FROM ({_NETS}) WHERE k BETWEEN 8 AND 13",
    "scan_limit": f"SELECT network FROM ({_NETS}) ORDER BY k LIMIT 3",
    "scan_uncached": f"SELECT network, n_name AS iso_code FROM ({_NETS}) JOIN nation ON n_nationkey = k",
    "scan_binary_column": f"SELECT network, CAST(k AS BIGINT) AS geoname_id FROM ({_NETS})",
    "kinds_of_values": "SELECT kind, n * (SELECT count(*) FROM part) AS n, CAST(c AS BIGINT) AS container FROM (VALUES ('String', 2, 0), ('Uint16', 1, 0), ('Bool', 1, 0), ('Map', 1, 1), ('Slice', 1, 1)) t(kind, n, c)",
    "decode_at_offset": "SELECT CAST(p_partkey AS BIGINT) AS partkey, p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 2 AS BIGINT) AS odd, p_brand AS in_map, p_brand AS in_slice, p_brand AS pointed FROM part",
    "lazy_offset": f"SELECT network, n_name AS iso_code FROM ({_NETS}) JOIN nation ON n_nationkey = k",
    "decode_custom": f"""SELECT network, '{{"geoname_id": ' || k || ', "iso_code": "' || n_name || '"}}' AS country, CAST(n_regionkey AS VARCHAR) AS region_id FROM ({_NETS}) JOIN nation ON n_nationkey = k""",
    "decode_legacy": f"SELECT network, n_name[:1] AS initial, CAST(n_regionkey AS VARCHAR) AS region_id FROM ({_NETS}) JOIN nation ON n_nationkey = k",
    "decode_custom_errors": f"SELECT network, 'at offset N, path /country/iso_code: cannot unmarshal String (Kind) into type bigint' AS error FROM ({_NETS})",
    "decode_shapes": f"SELECT network, 'Map(2)' AS country, 'Uint16' AS region_id FROM ({_NETS})",
    "decode_map_keys": "SELECT '60.' || n_nationkey || '.0.0/16' AS network, CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation UNION ALL SELECT '60.' || n_nationkey || '.0.0/16', CAST(n_nationkey + 100 AS BIGINT), 'more' FROM nation",
    "decode_errors": f"SELECT * FROM (VALUES ('bool', 'the bool size of 2 is invalid'), ('depth', 'exceeded maximum data structure depth; database is likely corrupt'), ('double', 'the float size of 4 is invalid'), ('end', '{_END}'), ('impossible', '{_END}'), ('key', 'map key must be a string, found Uint16'), ('large', 'invalid Uint16 size: 3'), ('large_end', '{_END}'), ('large_key', 'unexpected map key type: Bool'), ('pointer', 'invalid pointer to pointer at offset 0'), ('sound', NULL), ('uint16', 'the Uint16 size of 3 is invalid'), ('unknown', 'unknown type: 12')) t(name, error)",
    "error_rows": "SELECT * FROM (VALUES ('tree', '1.0.0.0/8', 'the database file''s search tree is corrupt', NULL), ('tree', '2.0.0.0/8', NULL, 'c'), ('kind', '1.0.0.0/8', NULL, 'b'), ('kind', '2.0.0.0/8', 'at offset 5, path /a: cannot unmarshal 5 (Uint32) into type string', NULL)) t(part, network, error, a)",
    "open_errors": "SELECT * FROM (VALUES ('bytes', 'b'), ('closed', 'cannot call Lookup on a closed database'), ('empty', 'file is empty'), ('no_metadata', 'invalid database file: it has no metadata'), ('offset', 'b'), ('too_many_nodes', 'the database contains invalid metadata')) t(name, said)",
    "verify_broken": "SELECT * FROM (VALUES ('tree', 'the database file''s search tree is corrupt'), ('tree', 'found data (map[a:b]) at 0 that the search tree does not point to'), ('text', 'received validation error (invalid UTF-8 string) at offset of 5'), ('text', 'found 1 pointers (of 2) in the search tree that we did not see in the data section')) t(part, message)",
    "lookup_country": f"SELECT e.event_id, n.n_name AS iso_code FROM events e LEFT JOIN nation n ON {_ON}",
    "lookup_v6_alias": f"SELECT e.event_id, printf('2002:%x::/%d', 2560 + n.n_nationkey, CASE WHEN {_HALF} THEN 33 ELSE 32 END) AS network, n.n_name AS iso_code FROM events e LEFT JOIN nation n ON {_ON}",
    "lookup_v6_mapped": f"SELECT e.event_id, '::ffff:10.' || n.n_nationkey || '.0.0/' || CASE WHEN {_HALF} THEN 113 ELSE 112 END AS network, CAST(n.n_nationkey AS BIGINT) AS geoname_id FROM events e LEFT JOIN nation n ON {_ON}",
    "lookup_miss_network": f"SELECT e.event_id, CASE WHEN user_id % 32 >= 28 THEN '10.28.0.0/14' WHEN user_id % 32 >= 26 THEN '10.26.0.0/15' WHEN user_id % 32 = 25 THEN '10.25.0.0/16' ELSE '10.' || (user_id % 32) || '.128.0/17' END AS network FROM events e LEFT JOIN nation n ON {_ON} WHERE n.n_nationkey IS NULL",
    "lookup_semi": f"SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM nation n WHERE {_ON})",
    "lookup_anti": f"SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE {_ON})",
    "lookup_strategies_agree": "SELECT CAST(0 AS BIGINT) AS differences",
    "lookup_errors": "SELECT event_id, false AS found, CASE WHEN event_id % 3 = 1 THEN 'error looking up ''2001:db8::1'': you attempted to look up an IPv6 address in an IPv4-only database' ELSE 'invalid IP address' END AS error FROM events",
    "scan_networks": f"SELECT network, CAST(CASE WHEN k % 3 = 0 THEN 17 ELSE 16 END AS BIGINT) AS prefix_len, CAST(167772160 + k * 65536 AS BIGINT) AS v4_start, CAST(167772160 + k * 65536 + CASE WHEN k % 3 = 0 THEN 32767 ELSE 65535 END AS BIGINT) AS v4_end FROM ({_NETS})",
    "scan_ordered": f"SELECT network, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS place FROM ({_NETS})",
    "scan_within": f"SELECT 'range' AS part, network FROM ({_NETS}) WHERE k BETWEEN 8 AND 15 UNION ALL SELECT 'containing', network FROM ({_NETS}) WHERE k = 4",
    "scan_within_suppliers": "SELECT '30.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) || '.0/24' AS network, s_suppkey AS suppkey FROM supplier WHERE s_suppkey < 128",
    "scan_include_empty": f"SELECT network, true AS has_data FROM ({_NETS}) UNION ALL SELECT '10.' || n_nationkey || '.128.0/17', false FROM nation WHERE {_HALF} UNION ALL SELECT x, false FROM (VALUES ('10.25.0.0/16'), ('10.26.0.0/15'), ('10.28.0.0/14')) t(x)",
    "scan_aliased": f"SELECT network FROM ({_NETS}) UNION ALL SELECT '::ffff:10.' || n_nationkey || '.0.0/' || CASE WHEN {_HALF} THEN 113 ELSE 112 END FROM nation UNION ALL SELECT printf('2001:0:%x::/%d', 2560 + n_nationkey, CASE WHEN {_HALF} THEN 49 ELSE 48 END) FROM nation UNION ALL SELECT printf('2002:%x::/%d', 2560 + n_nationkey, CASE WHEN {_HALF} THEN 33 ELSE 32 END) FROM nation",
    "scan_pushed": f"SELECT network FROM ({_NETS}) WHERE 167772160 + k * 65536 >= 168296448 AND 167772160 + k * 65536 + CASE WHEN k % 3 = 0 THEN 32767 ELSE 65535 END <= 168689663",
    "scan_udtf": f"SELECT network, CAST(CASE WHEN k % 3 = 0 THEN 17 ELSE 16 END AS BIGINT) AS prefix_len FROM ({_NETS}) WHERE k BETWEEN 8 AND 15",
    "scan_skip_empty": "SELECT (20 + c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) || '.0/24' AS network, c_mktsegment AS segment FROM customer WHERE c_acctbal >= 0",
    "records_dedup": "SELECT count(*) AS networks, count(DISTINCT CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END) AS records FROM customer",
    "offset_join": "SELECT CASE WHEN c_acctbal < 0 THEN 'none' ELSE c_mktsegment END AS segment, count(*) AS networks FROM customer GROUP BY 1",
    "decode_types": "SELECT p_partkey AS partkey, CAST(CAST(p_partkey AS HUGEINT) * 1099511627776 AS VARCHAR) AS u64, p_name AS name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, p_name[:4] AS raw, p_partkey % 2 AS odd, CAST(CAST(p_partkey AS FLOAT) / 2 AS DOUBLE) AS half, upper(lpad(printf('%x', p_partkey * 16), 8, '0')) || repeat('0', 24) AS u128 FROM part",
    "decode_path_array": "SELECT p_partkey AS partkey, p_partkey AS \"first\", CASE WHEN p_partkey % 3 = 2 THEN p_partkey + 2 END AS third, p_partkey + p_partkey % 3 AS \"last\", CASE WHEN p_partkey % 3 = 2 THEN p_partkey END AS minus3, p_name AS v, CAST(NULL AS VARCHAR) AS absent FROM part",
    "decode_variant": "SELECT p_partkey AS partkey, p_partkey + p_partkey % 3 AS \"last\", p_name AS v, CAST(NULL AS VARCHAR) AS absent FROM part",
    "kinds_histogram": "SELECT 1 + p_partkey % 3 AS tags, p_partkey % 2 AS odd, count(*) AS n FROM part GROUP BY 1, 2",
    "decode_orders": "SELECT CAST(CAST(o_orderkey AS HUGEINT) * 4294967296 + 7 AS VARCHAR) AS u64, CAST(CAST(o_orderkey AS HUGEINT) * 18446744073709551616 + o_orderkey AS VARCHAR) AS u128 FROM orders",
    "metadata": "SELECT 'Geo' AS database_type, CAST(4 AS BIGINT) AS ip_version, CAST(24 AS BIGINT) AS record_size, CAST(1770245369 AS BIGINT) AS build_epoch, '2026-02-04 22:49:29' AS build_time, 'Test Database' AS description, 'en' AS language, CAST(0 AS BIGINT) AS rest",
    "verify_clean": "SELECT CAST(0 AS BIGINT) AS findings",
    "verify_findings": "SELECT CAST(r AS BIGINT) AS rank, n AS name, m AS message FROM (VALUES (6, 'metadata', 'description - Expected: non-empty map Actual: map[]'), (200, 'separator', 'unexpected byte in data separator: [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]'), (301, 'data', 'found data (map[stray:[1 x]]) at 10 that the search tree does not point to')) t(r, n, m)",
    "agg_by_country": f"SELECT n.n_name AS iso_code, count(*) AS n, count(DISTINCT user_id) AS users, max(value) AS most FROM events e JOIN nation n ON {_ON} GROUP BY 1",
    "cube_country_type": f"SELECT CAST(n_regionkey AS BIGINT) AS region_id, event_type, count(*) AS n FROM events e JOIN nation n ON {_ON} GROUP BY CUBE (CAST(n_regionkey AS BIGINT), event_type)",
    "topk_country": f"SELECT n.n_name AS iso_code, count(*) AS n FROM events e JOIN nation n ON {_ON} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "gap_detection": "SELECT CAST(167772160 + n_nationkey * 65536 + 32768 AS BIGINT) AS gap_start, CAST(167772160 + n_nationkey * 65536 + 65535 AS BIGINT) AS gap_end FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < (SELECT max(n_nationkey) FROM nation)",
    "db_diff": f"SELECT network, CAST(k AS BIGINT) AS geoname_id, 'removed' AS change FROM ({_NETS}) UNION ALL SELECT network, CAST(k + 100 AS BIGINT), 'added' FROM ({_NETS})",
    "stream_enrich_window": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, n.n_name AS iso_code, count(*) AS n FROM events e JOIN nation n ON {_ON} GROUP BY 1, 2",
}
