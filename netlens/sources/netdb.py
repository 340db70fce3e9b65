"""The data source "netdb": a database file as DataFrames.

Views: networks (default; one row per network, in address order within net_start), records (one row per distinct
record), metadata (one row), data (the values of the data section as they follow one another).
Options: path, view, within, includeAliased, includeEmpty, skipEmptyValues, recordSchema (DDL or JSON of a type),
recordAs (variant | none), mode (FAILFAST | PERMISSIVE), partitionDepth, cache (false: no decoded record is remembered),
decoders (JSON of names to "module:function", for fields whose metadata names a decoder), mapped (false: the file is read,
not mapped), pushdown (comparisons of v4_start, v4_end, net_start and net_end prune subtrees, and "record_offset IS NOT
NULL" hides empty networks before they become rows).

Writing takes columns network and record; see write().
"""

from __future__ import annotations

import contextlib
import hashlib
import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from netlens import writer as w
from netlens.kinds import InvalidDatabaseError
from netlens.sources.files import open_database
from netlens.sources.scan import BATCH, NETWORK_COLUMNS, Leaves, Options, Records, data_values, leaves, record_array, scan, split, start_nodes

METADATA = (
    "binary_format_major_version int, binary_format_minor_version int, build_epoch decimal(20,0), build_time timestamp, database_type string, "
    "description map<string,string>, ip_version int, languages array<string>, node_count long, record_size int, "
    "search_tree_bytes long, data_section_bytes long, ipv4_start long, ipv4_start_bit_depth int"
)
#: Nodes of a tree from which on it is read by several tasks, and the most tasks.
SMALL, MOST = 1 << 13, 256


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text) if "{" not in text else T._parse_datatype_json_string(text)


class Part(InputPartition):
    def __init__(self, nodes: list[tuple[int, int, int, int]]):
        self.nodes = nodes


class NetDbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netdb"

    def _flag(self, name: str, default: bool = False) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def _record(self) -> T.DataType | None:
        if self.options.get("recordAs", "").lower() == "variant":
            return T.VariantType()
        text = self.options.get("recordSchema")
        return None if text is None else T.StructType.fromJson(json.loads(text)) if text.lstrip().startswith("{") else _type(text)

    def schema(self) -> T.StructType:
        view = self.options.get("view", "networks")
        record = self._record()
        if view == "metadata":
            return _struct(METADATA)
        if view == "data":
            return _struct("offset long, end_offset long, error string")
        if view == "records":
            out = _struct("record_offset long, error string")
        elif view == "networks":
            out = _struct(NETWORK_COLUMNS)
        else:
            raise ValueError(f"no view {view}")
        return out if record is None else out.add("record", record)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        view = self.options.get("view", "networks")
        kinds = {"metadata": MetadataReader, "data": DataReader, "records": RecordsReader}
        options = Options(self.options.get("within"), self._flag("includeAliased"), self._flag("includeEmpty"), self._flag("skipEmptyValues"), self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE", self._flag("cache", True))
        make = kinds.get(view, PushingReader if self._flag("pushdown") else NetworksReader)
        return make(self.options["path"], options, self._record(), int(self.options.get("partitionDepth", 12)), json.loads(self.options.get("decoders", "{}")), self._flag("mapped", True))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NetDbWriter(self.options["path"], schema, json.loads(self.options.get("head", "{}")), self._flag("aliases", True), self._flag("pointers"))


_TYPES = {"string": "StringType", "int": "IntegerType", "long": "LongType", "bigint": "LongType", "double": "DoubleType", "float": "FloatType", "boolean": "BooleanType", "binary": "BinaryType", "variant": "VariantType", "timestamp": "TimestampType", "smallint": "ShortType", "tinyint": "ByteType"}


def _type(text: str) -> T.DataType:
    """A type from DDL text. Parsed here, as data sources run where there is no session to parse it."""
    import re

    text = text.strip()
    low = text.lower()
    if low in _TYPES:
        return getattr(T, _TYPES[low])()
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", low):
        return T.DecimalType(int(m[1]), int(m[2]))
    if low.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if low.startswith("map<"):
        key, value = _split(text[4:-1])
        return T.MapType(_type(key), _type(value))
    return _struct(text[7:-1] if low.startswith("struct<") else text)


def _split(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


def _struct(text: str) -> T.StructType:
    import re

    out = T.StructType()
    for part in _split(text):
        m = re.fullmatch(r"\s*(`[^`]+`|\w+)\s*[:\s]\s*(.+)", part, re.S)
        out.add(m[1].strip("`"), _type(m[2]))
    return out


class NetworksReader(DataSourceReader):
    def __init__(self, path: str, options: Options, record: T.DataType | None, levels: int, decoders: dict[str, str], mapped: bool = True):
        self.path, self.options, self.record, self.levels, self.named, self.mapped = path, options, record, levels, decoders, mapped
        self.low, self.high = 0, (1 << 32) - 1
        self.first, self.last = 0, (1 << 128) - 1

    def database(self):
        return open_database(self.path, self.mapped)

    def decoders(self) -> dict:
        """The custom decoders, imported where they run."""
        places = {name: at.split(":") for name, at in self.named.items()}
        return {name: getattr(importlib.import_module(module), function) for name, (module, function) in places.items()}

    def partitions(self) -> list[InputPartition]:
        db = self.database()
        try:
            start = start_nodes(db, self.options.within)
        except ValueError as e:
            raise InvalidDatabaseError(str(e)) from e
        whole, weights = (start, np.ones(1, np.int64)) if db.metadata.node_count < SMALL else split(db, start, self.options, self.levels, MOST)
        nodes = list(zip(*(x.tolist() for x in (whole.pointer, whole.hi, whole.lo, whole.depth)), strict=True))
        if (self.low, self.high, self.first, self.last) != (0, (1 << 32) - 1, 0, (1 << 128) - 1):
            keep = [self._meets(p, db.v4_depth) for p in nodes]
            nodes, weights = [p for p, k in zip(nodes, keep, strict=True) if k], weights[keep]
        total = int(weights.sum())
        tasks = min(MOST, -(-total // BATCH))
        share = (np.cumsum(weights) - weights) * tasks // max(1, total)
        ends = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(nodes)]
        return [Part(nodes[a:b]) for a, b in zip(ends, ends[1:], strict=False) if a < b] or [Part([])]

    def _meets(self, node: tuple[int, int, int, int], v4_depth: int) -> bool:
        """Whether a subtree can hold networks that the pushed bounds let through."""
        _, hi, lo, depth = node
        start = hi << 64 | lo
        if start > self.last or start + (1 << (128 - depth)) - 1 < self.first:
            return False
        if depth < v4_depth or (self.low, self.high) == (0, (1 << 32) - 1):
            return True
        first = lo & 0xFFFFFFFF
        return not hi and not lo >> 32 and first <= self.high and first + (1 << (128 - depth)) - 1 >= self.low

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        db = self.database()
        if partition.nodes:
            pointer, hi, lo, depth = (np.array(x, t) for x, t in zip(zip(*partition.nodes, strict=True), (np.int64, np.uint64, np.uint64, np.int64), strict=True))
            yield from scan(db, Leaves(pointer, hi, lo, depth), self.options, self.record, self.decoders())


class PushingReader(NetworksReader):
    """Prunes subtrees by comparisons of the bounds of networks; needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            up, down = isinstance(f, GreaterThan | GreaterThanOrEqual), isinstance(f, LessThan | LessThanOrEqual)
            if name in (("v4_start",), ("v4_end",)) and isinstance(value, int):
                self.low = max(self.low, value) if up else self.low
                self.high = min(self.high, value) if down else self.high
            if name in (("net_start",), ("net_end",)) and isinstance(value, bytes | bytearray) and len(value) == 16:
                self.first = max(self.first, int.from_bytes(value)) if up else self.first
                self.last = min(self.last, int.from_bytes(value)) if down else self.last
            if isinstance(f, IsNotNull) and name == ("record_offset",):
                self.options = replace(self.options, empty=False)
            yield f  # bounds prune subtrees only; Spark still filters the rows


class RecordsReader(NetworksReader):
    """One row per distinct record, dealt by ranges of offsets."""

    def partitions(self) -> list[InputPartition]:
        return [Part([(k, 16, 0, 0)]) for k in range(16)] if self.database().metadata.node_count >= SMALL else [Part([(0, 1, 0, 0)])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        db = self.database()
        k, of = partition.nodes[0][:2]
        low, high = (db.values.size * x // of for x in (k, k + 1))
        found = []
        for side in db.tree:  # a partition's share of the data section is picked out before anything is sorted
            at, inside = db.data_offset(side)
            found.append(at[inside & (at >= low) & (at < high)])
        own, records = np.unique(np.concatenate(found)).tolist(), Records(db, self.record, self.decoders(), self.options.remember)
        for lo in range(0, len(own), 4096):
            part = own[lo : lo + 4096]
            got = [records.get(x) for x in part]
            for _, wrong in got:
                if wrong and not self.options.permissive:
                    raise InvalidDatabaseError(wrong)
            cols, names = [pa.array(part, pa.int64()), pa.array([w for _, w in got], pa.string())], ["record_offset", "error"]
            if self.record is not None:
                cols.append(record_array([v for v, _ in got], self.record))
                names.append("record")
            yield pa.RecordBatch.from_arrays(cols, names)


class MetadataReader(NetworksReader):
    def partitions(self) -> list[InputPartition]:
        return [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        from datetime import UTC, datetime
        from decimal import Decimal

        db = self.database()
        m = db.metadata
        try:
            built = datetime.fromtimestamp(m.build_epoch, UTC)
        except (OverflowError, ValueError, OSError):
            built = None
        yield (
            m.binary_format_major_version, m.binary_format_minor_version, Decimal(m.build_epoch), built, m.database_type, m.description, m.ip_version,
            m.languages, m.node_count, m.record_size, db.tree_bytes, db.values.size, db.v4_start, db.v4_depth,
        )


class DataReader(MetadataReader):
    def read(self, partition: Part) -> Iterator[tuple]:
        yield from data_values(self.database())


@dataclass
class Staged(WriterCommitMessage):
    """The files of one task: its networks, its records, and how long and what hash each record is."""

    networks: str
    records: str
    lengths: str


class NetDbWriter(DataSourceArrowWriter):
    """Tasks parse networks and encode records, each distinct record of a task once, into Arrow files beside the target.
    At commit the records are appended one after the other, equal ones once, and the tree is laid out, all over arrays: of
    some hundred bytes a network, and a batch of records at a time. So the driver holds the index of the file, never its
    records or rows. What a task that ran again left behind is not in any message and goes with the folder."""

    def __init__(self, path: str, schema: T.StructType, head: dict, aliases: bool, pointers: bool):
        self.path, self.kind, self.head, self.aliases, self.pointers = path, schema["record"].dataType, head, aliases, pointers
        self.at, self.folder = schema.fieldNames(), f"{path}-staging-{uuid.uuid4().hex}"

    def _open(self, uri: str):
        from pyarrow.fs import FileSystem

        if uri.startswith("file:") or "://" not in uri:
            uri = "file:///" + uri.removeprefix("file:").lstrip("/")
        return FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = self._open(self.folder)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        schemas = (
            pa.schema([("hi", pa.uint64()), ("lo", pa.uint64()), ("depth", pa.uint8()), ("record", pa.int64()), ("place", pa.int64())]),
            pa.schema([("body", pa.binary()), ("fixes", pa.list_(pa.int32()))]),
            pa.schema([("key", pa.binary(16)), ("length", pa.int64())]),
        )
        seen: dict[bytes, int] = {}
        count, put = 0, w.putter(self.kind)
        with contextlib.ExitStack() as open_:
            streams = [open_.enter_context(fs.open_output_stream(f"{root}/{name}-{x}")) for x in "nrl"]
            nets, bodies, lengths = (open_.enter_context(pa.ipc.new_stream(f, schema)) for f, schema in zip(streams, schemas, strict=True))
            for b in iterator:
                records, new = [], ([], [], [])
                for value in b.column(self.at.index("record")).to_pylist():
                    e = w.Encoder(self.pointers, True)
                    put(e, w.present(value))
                    key = hashlib.md5(e.out, usedforsecurity=False).digest()
                    at = seen.get(key)
                    if at is None:
                        if len(seen) >= 1 << 18:  # what a task remembers is bounded; equal records meet again at commit
                            seen.clear()
                        at = seen[key] = count
                        count += 1
                        for to, v in zip(new, (key, bytes(e.out), e.fixes), strict=True):
                            to.append(v)
                    records.append(at)
                hi, lo, depth = w.network_words(b.column(self.at.index("network")).to_pylist(), self.head.get("ip_version", 6))
                place = b.column(self.at.index("place")) if "place" in self.at else pa.nulls(len(hi), pa.int64())
                nets.write_batch(pa.record_batch([pa.array(hi), pa.array(lo), pa.array(depth.astype(np.uint8)), pa.array(records, pa.int64()), place], schema=schemas[0]))
                bodies.write_batch(pa.record_batch([pa.array(new[1], pa.binary()), pa.array(new[2], pa.list_(pa.int32()))], schema=schemas[1]))
                lengths.write_batch(pa.record_batch([pa.array(new[0], pa.binary(16)), pa.array([len(x) for x in new[1]], pa.int64())], schema=schemas[2]))
        return Staged(*(f"{self.folder}/{name}-{x}" for x in "nrl"))

    def _batches(self, uri: str) -> Iterator[pa.RecordBatch]:
        fs, name = self._open(uri)
        with fs.open_input_stream(name) as f:
            yield from pa.ipc.open_stream(f)

    def _offsets(self, staged: list[Staged]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of the records of all tasks, one after the other: where each lies in the data section, whether it is the first of
        its equals, and where each task's begin."""
        keys, lengths, begin = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], [0]
        for m in staged:
            for b in self._batches(m.lengths):
                keys.append(np.frombuffer(b.column(0).buffers()[1], np.uint64, 2 * len(b), 16 * b.column(0).offset).reshape(-1, 2))
                lengths.append(b.column(1).to_numpy())
            begin.append(sum(map(len, lengths)))
        key, length = np.concatenate(keys), np.concatenate(lengths)
        del keys
        order = np.lexsort((key[:, 1], key[:, 0]))  # stable, so the first of equal records comes first
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
        del key
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        length[~first] = 0
        offset = np.cumsum(length) - length
        offset[order] = offset[order[new]][np.cumsum(new) - 1]
        return offset, first, begin

    def _bodies(self, b: pa.RecordBatch, offset: np.ndarray, first: np.ndarray) -> bytes:
        """The records of a batch that are to be stored, with their pointers moved to where they come to lie."""
        b, offset = b.filter(pa.array(first)), offset[first]
        if not len(b):
            return b""
        body, fixes = b.column(0), b.column(1)
        start = np.frombuffer(body.buffers()[1], np.int32, len(b) + 1, 4 * body.offset).astype(np.int64)
        data = np.frombuffer(body.buffers()[2], np.uint8)[start[0] : start[-1]].copy()
        at = fixes.flatten().to_numpy().astype(np.int64)
        if len(at):
            of = np.repeat(np.arange(len(b)), fixes.value_lengths().to_numpy())
            at += start[of] - start[0]
            target = offset[of]
            for k in range(4):
                target = target + (data[at + k].astype(np.int64) << 24 - 8 * k)
            if int(target.max()) >> 32:
                raise ValueError("pointers are too short for this database")
            for k in range(4):
                data[at + k] = target >> 24 - 8 * k & 255
        return data.tobytes()

    def _tree(self, staged: list[Staged], offset: np.ndarray, begin: list[int]) -> np.ndarray:
        cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.uint8, np.int64, np.int64)]
        for m, base in zip(staged, begin, strict=False):
            for b in self._batches(m.networks):
                for k in range(3):
                    cols[k].append(b.column(k).to_numpy())
                cols[3].append(offset[b.column(3).to_numpy() + base])
                if not b.column(4).null_count:
                    cols[4].append(b.column(4).to_numpy())
        hi, lo, depth, at, place = (np.concatenate(c) for c in cols)
        del cols
        if len(place) == len(hi):  # of equal networks the last row counts, in any order of tasks
            order = np.argsort(place, kind="stable")
            hi, lo, depth, at = hi[order], lo[order], depth[order], at[order]
        return w.layout(hi, lo, depth, at, self.head.get("ip_version", 6), self.aliases)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, target = self._open(self.path)
        staged = [m for m in messages if m is not None]
        root = self._open(self.folder)[1]
        fs.create_dir(root, recursive=True)
        offset, first, begin = self._offsets(staged)
        tree = self._tree(staged, offset, begin)
        nodes = len(tree)
        with fs.open_output_stream(f"{root}/whole") as out:
            for lo in range(0, nodes, 1 << 20):
                out.write(w.pack(tree[lo : lo + (1 << 20)], self.head.get("record_size", 28)))
            del tree
            out.write(bytes(16))
            for m, at in zip(staged, begin, strict=False):
                for b in self._batches(m.records):
                    out.write(self._bodies(b, offset[at : at + len(b)], first[at : at + len(b)]))
                    at += len(b)
            out.write(w.head(nodes, **self.head))
        fs.move(f"{root}/whole", target)
        fs.delete_dir(root)

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = self._open(self.folder)
        with contextlib.suppress(OSError):
            fs.delete_dir(root)


def write(df: DataFrame, path: str, aliases: bool = True, pointers: bool = False, **head: object) -> str:
    """A database at path of the rows network (text), record (any type that typed() of the writer takes). head: metadata
    as ip_version, record_size, database_type, description, languages, build_epoch. Of networks that repeat the last row
    counts. A table of one file may come as one task, so the rows are dealt anew to be encoded."""
    register(df.sparkSession)
    rows = df.select("network", "record", F.monotonically_increasing_id().alias("place")).repartition("network", "place")
    out = rows.write.format("netdb").option("head", json.dumps(head)).option("aliases", str(aliases).lower()).option("pointers", str(pointers).lower())
    out.mode("overwrite").save(path)
    return path


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NetDbSource)


def read(spark: SparkSession, path: str, view: str = "networks", **options: str | bool | int) -> DataFrame:
    """A view of the database at path."""
    register(spark)
    r = spark.read.format("netdb").option("view", view)
    for k, v in options.items():
        if v is not None:
            r = r.option(k, str(v).lower() if isinstance(v, bool) else v)
    return r.load(path)


def from_binary(df: DataFrame, column: str = "content", record: str | None = None, **options: bool) -> DataFrame:
    """The networks view of databases held in a binary column, as spark.read.format("binaryFile") gives them; one task
    reads one database."""
    from netlens.codec import Database

    kind, chosen = None if record is None else _type(record), Options(**options)
    schema = _struct(NETWORK_COLUMNS)
    schema = schema if kind is None else schema.add("record", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                db = Database(raw.as_py())
                yield from scan(db, start_nodes(db, chosen.within), chosen, kind)

    return df.select(column).mapInArrow(run, schema)


__all__ = ["NetDbSource", "from_binary", "leaves", "read", "register", "write"]
