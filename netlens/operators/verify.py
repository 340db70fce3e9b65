"""Integrity checks as a DataFrame of findings, in the order of the checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.kinds import RECORD_SIZES, InvalidDatabaseError
from netlens.sources.files import open_database
from netlens.sources.netdb import read

SCHEMA = "rank int, name string, message string"


def _utf8(*texts: str) -> bool:
    try:
        "".join(texts).encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def metadata_findings(path: str) -> list[tuple[int, str, str]]:
    m = open_database(path).metadata
    show = lambda field, want, got: f"{field} - Expected: {want} Actual: {got}"
    checks = [
        (m.binary_format_major_version == 2, show("binary_format_major_version", 2, m.binary_format_major_version)),
        (m.binary_format_minor_version == 0, show("binary_format_minor_version", 0, m.binary_format_minor_version)),
        (m.database_type != "", show("database_type", "non-empty string", m.database_type)),
        (_utf8(m.database_type), "database_type contains invalid UTF-8"),
        (_utf8(*(str(x) for kv in m.description.items() for x in kv)), "description contains invalid UTF-8"),
        (_utf8(*map(str, m.languages)), "languages contains invalid UTF-8"),
        (len(m.description) > 0, show("description", "non-empty map", "map[]")),
        (m.ip_version in (4, 6), show("ip_version", "4 or 6", m.ip_version)),
        (m.record_size in RECORD_SIZES, show("record_size", "24, 28, or 32", m.record_size)),
        (m.node_count > 0, show("node_count", "positive integer", m.node_count)),
    ]
    return [(k, "metadata", text) for k, (ok, text) in enumerate(checks) if not ok]


def separator_findings(path: str) -> list[tuple[int, str, str]]:
    raw = open_database(path).separator
    if len(raw) < 16:
        return [(200, "separator", "unexpected end of database while reading data section separator")]
    return [(200, "separator", f"unexpected byte in data separator: {list(raw)}")] if any(raw) else []


def shown(value: object) -> str:
    """A decoded value as the messages of verification show it: maps by key, lists, and bytes as numbers, in brackets."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{shown(v)}" for k, v in sorted(value.items())) + "]"
    if isinstance(value, list | bytes):
        return "[" + " ".join(shown(v) for v in value) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            return "NaN" if math.isnan(value) else "+Inf" if value > 0 else "-Inf"
        digits, exponent = f"{Decimal(repr(value)).normalize():e}".split("e")
        power = int(exponent)
        if value and not -4 <= power < 21:
            return f"{digits}e{'+' if power > 0 else '-'}{abs(power):02d}"
        return f"{Decimal(repr(value)).normalize():f}"
    return str(value)


def _stray(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = open_database(path).values
        for b in batches:
            texts = [f"found data ({shown(values.decode(at)[0])}) at {at} that the search tree does not point to" for at in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([301] * len(texts), pa.int32()), pa.array(["data"] * len(texts), pa.string()), pa.array(texts, pa.string())], ["rank", "name", "message"])

    return run


def verify(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Findings (rank, name, message), none for a sound file; strict raises the first."""
    first = metadata_findings(path)
    out = spark.createDataFrame(first + separator_findings(path), SCHEMA)
    if not any(x[2].startswith(("record_size", "node_count", "ip_version")) for x in first):
        nets = read(spark, path, mode="PERMISSIVE").select("record_offset", "error")
        data = read(spark, path, "data").select("offset", "error")
        tree = nets.where("error is not null").select(F.lit(100).alias("rank"), F.lit("tree").alias("name"), F.col("error").alias("message"))
        seen = nets.where("record_offset is not null").select(F.col("record_offset").alias("offset")).distinct()
        broken = data.where("error is not null").select(F.lit(300).alias("rank"), F.lit("data").alias("name"), F.col("error").alias("message"))
        stray = data.where("error is null").join(seen, "offset", "left_anti")
        stray = stray.select("offset").mapInArrow(_stray(path), SCHEMA)
        kept = data.where("error is null").select("offset", F.lit(True).alias("kept"))
        lost = seen.join(kept, "offset", "left").agg(F.count("*").alias("all"), F.count_if(F.col("kept").isNull()).alias("n")).where("n > 0")
        text = F.concat(F.lit("found "), F.col("n").cast("string"), F.lit(" pointers (of "), F.col("all").cast("string"), F.lit(") in the search tree that we did not see in the data section"))
        lost = lost.select(F.lit(302).alias("rank"), F.lit("data").alias("name"), text.alias("message"))
        out = out.unionByName(tree).unionByName(broken).unionByName(stray).unionByName(lost)
    if strict and (row := out.orderBy("rank", "message").first()):
        raise InvalidDatabaseError(row["message"])
    return out
