"""Streams enriched with the network of an address.

A lookup keeps no state: it is a stream-static step, by the join strategies or by walking the file in Arrow batches.
A newer build of a database is picked up by the next micro-batch in `enrich_batches`, which resolves the path anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from netlens.operators.lookup import lookup_tree


def enrich(stream: DataFrame, ip: str, path: str, record: str | None = None) -> DataFrame:
    return lookup_tree(stream, ip, path, record)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide), *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def enrich_batches(stream: DataFrame, ip: str, resolve: Callable[[], str], sink: Callable[[DataFrame, int], None], record: str | None = None) -> DataStreamWriter:
    """A writer that looks up each micro-batch in the build that resolve() names then."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(lookup_tree(batch, ip, resolve(), record), epoch)

    return stream.writeStream.foreachBatch(run)
