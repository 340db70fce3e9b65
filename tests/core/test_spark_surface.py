import pytest
from pyspark.sql import functions as F

from netlens import writer as w
from netlens.functions.ipfns import ipv4_to_long, ipv6_words, long_to_ipv4, mask_v4
from netlens.functions.paths import decode_path
from netlens.operators import lookup as lk
from netlens.operators.lookup import decode_offsets, lookup, lookup_join, lookup_tree, networks_for_lookup
from netlens.operators.verify import shown, verify
from netlens.plans.session import create_views
from netlens.sources.files import open_database, place, publish
from netlens.sources.netdb import _type, from_binary, read, write

NETS = [("198.18.0.1/32", {"ip": "198.18.0.1"}), ("198.18.0.2/31", {"ip": "198.18.0.2"}), ("10.0.0.0/8", {"ip": "ten"}), ("10.9.0.0/16", {"ip": "ten.nine"}), ("2001:db8::/32", {"ip": "doc"}), ("fe80::1/128", {})]
IPS = ["198.18.0.1", "198.18.0.3", "198.18.0.4", "10.1.2.3", "10.9.255.255", "::ffff:10.9.0.1", "2001:db8::5", "2001:db9::", "fe80::1", "fe80::2", "255.255.255.255", "0.0.0.0", "x", "", None, "1.2.3", "01.2.3.4", "10.1.2.3"]


@pytest.fixture(scope="module")
def path(spark):
    return publish(spark, w.build(NETS, 6, 28), "surface")


def rows(df):
    return sorted(((r["k"], r["ip"], r["found"], r["network"], r["error"], None if r["record"] is None else r["record"]["ip"]) for r in df.collect()), key=str)


def test_strategies_agree_in_128_bits(spark, path):
    df = spark.createDataFrame(list(enumerate(IPS)), "k long, ip string")
    want = rows(lookup_tree(df, "ip", path, "struct<ip:string>"))
    assert len(want) == len(IPS)
    nets = networks_for_lookup(spark, path, "ip string")
    for s in ("equi", "range", "asof"):
        assert rows(lookup_join(df, "ip", nets, s)) == want, s
    by = {r[1]: r for r in want}
    assert by["::ffff:10.9.0.1"][3] == "::ffff:10.9.0.0/112" and by["198.18.0.4"][2:4] == (False, "198.18.0.4/30") and by["x"][4] == "invalid IP address" and by["01.2.3.4"][4] == "invalid IP address"


def test_v6_texts_as_the_library_reads_them(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", ":::", "1:::2", ":1::2", "1::2::3", "1:2", "12345::", "g::", "::ffff:1.2.3.4", "::1.2.3", "1.2.3.4::", "::1.2.3.4:5",
             "FE80::ABCD", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "fe80::1%eth0", " ::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "8000::", "::8000:0:0:0", ":", "1:", "::256.1.1.1", "64:ff9b::192.0.2.33", "a:b:c:d:e:f::"]
    got = {r["ip"]: r["w"] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ipv6_words(F.col("ip")).alias("w")).collect()}
    for t in texts:
        try:
            n = None if "%" in t else int(ipaddress.IPv6Address(t))
        except ValueError:
            n = None
        have = None if got[t] is None else (got[t]["h"] % 2**64) << 64 | got[t]["l"] % 2**64
        assert have == n, t


def test_v4_columns(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("255.255.255.255",), ("256.1.1.1",), ("a",), (None,)], "ip string").withColumn("n", ipv4_to_long(F.col("ip")))
    got = df.select("ip", "n", long_to_ipv4(F.col("n")).alias("back"), mask_v4(F.col("n"), 8).alias("net")).collect()
    assert [r["n"] for r in got] == [16909060, 4294967295, None, None, None]
    assert got[0]["back"] == "1.2.3.4" and got[0]["net"] == 16777216


def test_equi_join_plan_is_a_hash_join_without_python_on_v4(spark, path):
    df = spark.createDataFrame([("198.18.0.1",)], "ip string")
    plan = lookup_join(df, "ip", networks_for_lookup(spark, path), "equi")._jdf.queryExecution().executedPlan().toString()
    assert ("HashJoin" in plan or "SortMergeJoin" in plan) and "EvalPython" not in plan and "MapInArrow" not in plan


def test_views_options_and_partitions(spark, path):
    assert read(spark, path).count() == 13  # the /16 cuts its /8 into eight more
    assert read(spark, path, skipEmptyValues=True).count() == 12
    assert read(spark, path, "records").count() == 6
    assert read(spark, path, within="10.0.0.0/8").count() == len([n for n in read(spark, path).collect() if n["v4_start"] is not None and 10 << 24 <= n["v4_start"] < 11 << 24])
    create_views(spark, path, "t", "ip string")
    assert spark.sql("SELECT count(*) c FROM t_networks JOIN t_records USING (record_offset)").first()["c"] == 13
    with pytest.raises(Exception, match="IPv4-only|invalid prefix"):
        read(spark, path, within="bad").count()


def test_large_tree_is_split_into_subtrees(spark):
    nets = [(f"{k >> 16 & 255}.{k >> 8 & 255}.{k & 255}.0/24", {"k": w.u32(k)}) for k in range(0, 1 << 24, 257)]
    df = read(spark, publish(spark, w.build(nets, 4, 28), "large"), recordSchema="k long")
    assert df.rdd.getNumPartitions() > 8
    assert df.agg(F.count("*"), F.sum("record.k")).first() == (len(nets), sum(range(0, 1 << 24, 257)))


def test_binary_column(spark, path):
    files = spark.read.format("binaryFile").load(path)
    got = from_binary(files, record="ip string").select("network", "record.ip")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in read(spark, path, recordSchema="ip string").select("network", "record.ip").collect()}


def test_errors_by_mode(spark):
    bad = publish(spark, w.build([("1.0.0.0/8", {"a": w.u32(70000)}), ("2.0.0.0/8", {"a": w.u32(7)})], 4, 24), "mode")
    got = {r["network"]: r for r in read(spark, bad, recordSchema="a smallint", mode="PERMISSIVE").collect()}
    assert "cannot unmarshal 70000" in got["1.0.0.0/8"]["error"] and got["2.0.0.0/8"]["record"]["a"] == 7
    with pytest.raises(Exception, match="cannot unmarshal 70000"):
        read(spark, bad, recordSchema="a smallint").collect()


def test_paths_over_variant(spark, path):
    df = spark.sql("SELECT parse_json('{\"a\": [1, {\"b\": \"x\"}], \"c d\": null}') AS v")
    at = lambda *p, **k: decode_path(F.col("v"), _type("variant"), *p, **k).cast("string")
    r = df.select(at("a", 0).alias("p"), at("a", -1, "b").alias("q"), at("a", 5).alias("r"), at("zz").alias("s"), at("a", "x", strict=False).alias("t")).first()
    assert tuple(r) == ("1", "x", None, None, None)
    with pytest.raises(Exception, match="expected a slice for 0 but found OBJECT"):
        df.select(at(0)).collect()
    with pytest.raises(ValueError, match="expected a map"):
        decode_path(F.col("v"), _type("array<long>"), "x")


def test_verify_findings(spark):
    assert verify(spark, publish(spark, w.build(NETS, 6, 32), "ok")).count() == 0
    bad = w.build([("1.0.0.0/8", "\udcff")], 4, 24, description={}, database_type="")
    got = [r["message"] for r in verify(spark, publish(spark, bad, "bad")).orderBy("rank").collect()]
    assert got[0].startswith("database_type - Expected: non-empty string") and got[1].startswith("description - Expected") and "invalid UTF-8" in got[2]
    with pytest.raises(Exception, match="database_type - Expected"):
        verify(spark, publish(spark, bad, "bad"), strict=True)


def test_streaming_sessions_and_batches(spark, path, tmp_path):
    from netlens.streaming.enrich import enrich_batches, session_counts

    spark.createDataFrame([("198.18.0.1", "2024-01-01 00:00:00"), ("10.1.1.1", "2024-01-01 00:01:00"), ("198.18.0.1", "2024-01-01 05:00:00")], "ip string, t string").select("ip", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("ip string, ts timestamp").parquet(str(tmp_path / "in"))
    out = []
    enrich_batches(src(), "ip", lambda: path, lambda b, e: out.extend(b.collect()), "struct<ip:string>").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["record"]["ip"] for r in out) == ["198.18.0.1", "198.18.0.1", "ten"]
    q = session_counts(src(), "ts", ["ip"], "10 minutes", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 1, 1]


def test_custom_decoders_and_cache_option(spark):
    from pyspark.sql import types as T

    big = publish(spark, w.build([("1.0.0.0/8", {"a": w.u128(10**38 + 1), "b": {"x": [1, "é"]}})], 4, 24), "decoders")
    field = lambda n, d: T.StructField(n, T.StringType(), metadata={"decoder": d})
    named = '{"json": "netlens.functions.decoders:as_json", "text": "netlens.functions.decoders:number_text"}'
    schema = T.StructType([field("a", "text"), field("b", "json")]).json()
    for view in ("networks", "records"):
        r = read(spark, big, view, recordSchema=schema, decoders=named, cache=False).first()["record"]
        assert (r["a"], r["b"]) == (str(10**38 + 1), '{"x": [1, "é"]}')
    with pytest.raises(Exception, match="unexpected kind Map"):
        read(spark, big, recordSchema=T.StructType([field("b", "text")]).json(), decoders=named).collect()


def test_encoded_columns(spark):
    from netlens.functions.values import decode_value, kind_at

    rows = [(bytearray(w.encode({"a": w.u16(5), "b": ["x", "y"]})), 0), (bytearray(b"\x00" + w.encode({"a": w.u16(7)})), 1), (None, 0)]
    df = spark.createDataFrame(rows, "raw binary, at int")
    r = df.select(decode_value(F.col("raw"), F.col("at"), "a int, b array<string>").alias("v"), kind_at(F.col("raw"), F.col("at")).alias("k")).collect()
    assert [(x["v"] and tuple(x["v"]), x["k"]) for x in r] == [((5, ["x", "y"]), "Map"), ((7, None), "Map"), (None, None)]
    n = spark.createDataFrame([(bytearray(w.encode(w.u32(9))), 0)], "raw binary, at int").select(decode_value(F.col("raw"), F.col("at"), "long").alias("n"))
    assert n.first()["n"] == 9


def test_lookups_beyond_the_bounds_of_broadcasts_and_loops(spark, path, monkeypatch):
    df = spark.createDataFrame(list(enumerate(IPS * 3)), "k long, ip string")
    nets = networks_for_lookup(spark, path, "ip string")
    want = rows(lookup(df, "ip", path, "struct<ip:string>"))
    monkeypatch.setattr(lk, "BYTES", 0)
    monkeypatch.setattr(lk, "FEW", 3)
    for s in ("equi", "range"):
        got = lookup_join(df, "ip", nets, s)
        assert rows(got) == want
    assert "Nested" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_default_lookup_shuffles_nothing(spark, path):
    df = spark.range(10).select(F.lit("10.1.2.3").alias("ip"))
    plan = lookup(df, "ip", path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_values_at_offsets(spark, path):
    nets = read(spark, path, includeEmpty=True).where("network in ('10.9.0.0/16', '0.0.0.0/5')").select("network", "record_offset")
    got = {r["network"]: r["value"] for r in decode_offsets(nets.union(nets), "record_offset", path, "struct<ip:string>").collect()}
    assert got["10.9.0.0/16"]["ip"] == "ten.nine" and [v for k, v in got.items() if k != "10.9.0.0/16"] in ([], [None])
    with pytest.raises(Exception, match="cannot unmarshal"):
        decode_offsets(nets.where("record_offset is not null"), "record_offset", path, "struct<ip:long>").collect()


def test_written_databases(spark, tmp_path):
    data = [(f"10.{k // 256}.{k % 256}.0/24", {"name": "n%d" % (k % 7), "again": "n%d" % (k % 7) + "-long", "n": k % 5, "list": ["n%d-long" % (k % 7)]}) for k in range(3000)]
    df = spark.createDataFrame(data, "network string, record struct<name:string,again:string,n:int,list:array<string>>").repartition(6)
    for pointers in (False, True):
        at = write(df, f"file://{tmp_path}/{pointers}.netdb", pointers=pointers, ip_version=6, record_size=32, database_type="Own", description={"de": "ü"}, build_epoch=5)
        got = read(spark, at, recordSchema="name string, again string, n int, list array<string>")
        assert {r["network"]: tuple(r["record"]) for r in got.collect()} == {n: tuple(r.values()) for n, r in data}
        assert read(spark, at, "records").count() == 35
        m = read(spark, at, "metadata").first()
        assert (m["database_type"], m["description"], m["build_epoch"], m["ip_version"], m["record_size"]) == ("Own", {"de": "ü"}, 5, 6, 32)
        assert verify(spark, at).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["False.netdb", "True.netdb"]
    assert (tmp_path / "True.netdb").stat().st_size < (tmp_path / "False.netdb").stat().st_size
    empty = write(df.limit(0), str(tmp_path / "none.netdb"), ip_version=4, record_size=24)
    assert read(spark, empty).count() == 0 and read(spark, empty, includeEmpty=True).count() == 2
    with pytest.raises(Exception, match="no network of an IPv4"):
        write(spark.createDataFrame([("2001:db8::/32", (1,))], "network string, record struct<a:int>"), str(tmp_path / "bad.netdb"), ip_version=4)
    assert not list(tmp_path.glob("bad*"))


def test_kinds_that_are_written(spark):
    import decimal

    row = ("1.0.0.0/8", (3, -4, 5, 2**40, decimal.Decimal(2**63 + 1), decimal.Decimal(2**100), 0.5, 0.25, True, bytearray(b"ab"), "x", None, {"k": 7}))
    kind = "network string, record struct<a:smallint,b:int,c:int,d:bigint,e:decimal(20,0),f:decimal(38,0),g:float,h:double,i:boolean,j:binary,k:string,l:string,m:map<string,int>>"
    at = write(spark.createDataFrame([row], kind), place(spark, "kinds"), ip_version=4, record_size=24)
    fields = [(c, d) for c, d in zip("abcdefghijkm", ["Uint16", "Int32", "Uint32", "Uint64", "Uint64", "Uint128", "Float32", "Float64", "Bool", "Bytes", "String", "Map(1)"], strict=True)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(c, T.StringType(), metadata={"decoder": "shape"}) for c in "abcdefghijklm"])
    got = read(spark, at, recordSchema=schema.json(), decoders='{"shape": "netlens.functions.decoders:shape"}').first()["record"].asDict()
    assert got == {**dict(fields), "l": None}


def test_pushed_bounds_prune_subtrees(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    nets = [(f"2001:db8:{k:x}::/48", {"k": w.u32(k)}) for k in range(30_000)]
    at = publish(spark, w.build(nets, 6, 28), "pushed")
    assert open_database(at).metadata.node_count < 1 << 16
    from netlens.sources import netdb

    small, netdb.SMALL = netdb.SMALL, 1
    try:
        from netlens.sources.netdb import PushingReader
        from netlens.sources.scan import Options
        from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

        low, high = (int.from_bytes(bytes.fromhex(f"20010db8{k:04x}0000")) << 64 for k in (256, 512))
        whole, some = PushingReader(at, Options(empty=True), None, 40, {}), PushingReader(at, Options(empty=True), None, 40, {})
        list(some.pushFilters([GreaterThanOrEqual(("net_start",), low.to_bytes(16)), LessThan(("net_end",), high.to_bytes(16)), IsNotNull(("record_offset",))]))
        count = lambda r: sum(len(p.nodes) for p in r.partitions())
        assert count(some) < count(whole) / 20 and not some.options.empty and whole.options.empty
        seen = [x for p in some.partitions() for b in some.read(p) for x in b.column("network").to_pylist()]
        assert {f"2001:db8:{k:x}::/48" for k in range(256, 512)} <= set(seen) and len(seen) < 3000
    finally:
        netdb.SMALL = small


def test_values_in_messages():
    assert shown({"b": [1, 2.5, True, b"\x01\x02"], "a": "x"}) == "map[a:x b:[1 2.5 true [1 2]]]"
    assert [shown(x) for x in (100.0, 1e21, 1e20, 0.0001, 0.00001, 42.123456, -0.5, 2**127, [], {})] == ["100", "1e+21", "100000000000000000000", "0.0001", "1e-05", "42.123456", "-0.5", str(2**127), "[]", "map[]"]


def test_files_that_are_not_mapped(spark, path, monkeypatch):
    import mmap

    assert open_database(path, False).metadata == open_database(path).metadata and not isinstance(open_database(path, False).view.obj, mmap.mmap)
    again = publish(spark, w.build(NETS, 6, 28), "fallback")
    monkeypatch.setattr(mmap, "mmap", lambda *a, **k: (_ for _ in ()).throw(OSError("no mapping")))
    assert open_database(again).metadata.node_count > 0


def test_records_of_a_large_tree_come_in_parts(spark, path, monkeypatch):
    from netlens.sources import netdb
    from netlens.sources.netdb import RecordsReader
    from netlens.sources.scan import Options

    monkeypatch.setattr(netdb, "SMALL", 1)
    r = RecordsReader(path, Options(), None, 12, {})
    parts = r.partitions()
    got = [x for p in parts for b in r.read(p) for x in b.column("record_offset").to_pylist()]
    assert len(parts) == 16 and len(got) == len(set(got)) == 6 and got == sorted(got)


def test_crowded_networks_are_dealt_out(spark):
    """Networks in one corner of the tree are read by as many tasks as others, each once and in order."""
    nets = [(f"40.0.{k >> 8}.{k & 255}/32", {"k": w.u32(k)}) for k in range(20_000)] + [("200.0.0.0/8", {"k": w.u32(1 << 20)})]
    for version in (4, 6):
        at = publish(spark, w.build(nets, version, 32), "crowd")
        df = read(spark, at, recordSchema="k long")
        sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert len(sizes) >= 4 and max(sizes) < 3 * 4096
        assert [r["k"] for r in df.select("record.k").collect()] == [*range(20_000), 1 << 20]
        for kind, sql in (("long", "record"), ("variant", "CAST(record AS STRING)")):
            same = read(spark, at, recordSchema="k long") if kind == "long" else read(spark, at, recordAs="variant")
            assert same.selectExpr("network", f"{sql} AS r").distinct().count() == len(nets)
        whole = read(spark, at, includeEmpty=True, includeAliased=True).agg(F.count("*"), F.countDistinct("net_start")).first()
        from netlens.sources.scan import Options, leaves, start_nodes

        every = leaves(open_database(at), start_nodes(open_database(at), None), Options(aliased=True, empty=True))
        assert whole[0] == whole[1] == len(every)


def test_rows_of_one_file_are_encoded_by_several_tasks(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.concat_ws(".", F.lit("10"), F.lit("1"), F.shiftright("id", 8).cast("string"), (F.col("id") % 256).cast("string")).alias("network"), F.struct(*(F.sha2(F.concat(F.col("id"), F.lit(k)), 512).alias(k) for k in "abc")).alias("record"))
    sc = spark.sparkContext
    sc.setJobGroup("dealt", "")
    at = write(rows, place(spark, "dealt"), ip_version=4, record_size=32, pointers=True)
    sc.setJobGroup("rest", "")
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("dealt") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    got = read(spark, at, recordSchema="a string, b string, c string").selectExpr("network", "struct(record.*) AS record")
    assert got.join(rows.withColumn("network", F.concat("network", F.lit("/32"))), ["network", "record"]).count() == 30_000


def test_of_equal_networks_the_last_row_counts(spark):
    rows = [("2.0.0.0/8", ("x",)), ("1.0.0.0/8", ("y",)), ("1.0.0.0/8", ("x",)), ("3.0.0.0/8", ("x",)), ("3.0.0.0/8", ("y",))]
    for n in (1, 3):
        at = write(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "network string, record struct<a:string>"), place(spark, "last"), ip_version=4, record_size=24)
        assert {r["network"]: r["record"]["a"] for r in read(spark, at, recordSchema="a string").collect()} == {"1.0.0.0/8": "x", "2.0.0.0/8": "x", "3.0.0.0/8": "y"}
