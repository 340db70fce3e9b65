"""SQL surface: views and table functions over a database."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from netlens.sources.netdb import read, register


def configure(spark: SparkSession) -> SparkSession:
    """The data source, and filter pushdown into it."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def create_views(spark: SparkSession, path: str, prefix: str, record: str | None = None) -> None:
    """Temporary views prefix_networks, prefix_records and prefix_metadata."""
    for view in ("networks", "records", "metadata"):
        read(spark, path, view, recordSchema=record if view != "metadata" else None).createOrReplaceTempView(f"{prefix}_{view}")


@udtf(returnType="network string, prefix_len int, record_offset long")
class NetworksWithin:
    """networks_within(path, cidr): the networks that meet a prefix."""

    def eval(self, path: str, cidr: str) -> Iterator[tuple]:
        from netlens.reader import NetDb

        for r in NetDb.open(path).networks_within(cidr):
            yield r.prefix, int(r.prefix.rpartition("/")[2]), r.offset


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("networks_within", NetworksWithin)
