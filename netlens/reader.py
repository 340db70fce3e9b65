"""One database in one process: open, look up, scan, decode, verify, close."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np

from netlens.codec import Cursor, Database, Metadata, compile_schema, infer_schema
from netlens.functions.ipfns import parse
from netlens.kinds import ClosedDatabaseError, InvalidDatabaseError, NetDbError
from netlens.sources.files import open_database
from netlens.sources.scan import Options, leaves, lookup, network_batch, start_nodes


@dataclass
class Result:
    """What a lookup or a scan found; nothing is decoded before it is asked for."""

    db: NetDb
    offset: int | None
    prefix: str | None
    error: str | None = None

    @property
    def found(self) -> bool:
        return self.offset is not None and self.error is None

    def _ready(self, call: str) -> bool:
        self.db._check(call)
        if self.error:
            raise InvalidDatabaseError(self.error)
        return self.offset is not None

    def decode(self, schema=None, decoders: dict | None = None) -> object:
        """The record, whole or by a Spark type; None without one."""
        if not self._ready("Decode"):
            return None
        values = self.db._db.values
        return values.record(self.offset, None if schema is None else compile_schema(schema, values, None, decoders))

    def decode_path(self, *path: str | int) -> object:
        return self.db._db.values.path(self.offset, *path) if self._ready("DecodePath") else None

    def cursor(self) -> Cursor:
        self._ready("Decode")
        return Cursor(self.db._db.values, self.offset)


class NetDb:
    def __init__(self, db: Database, path: str | None = None):
        self._db, self.path, self._closed = db, path, False

    @classmethod
    def open(cls, path: str) -> NetDb:
        return cls(open_database(path), path)

    @classmethod
    def from_bytes(cls, data: bytes) -> NetDb:
        return cls(Database(data))

    def close(self) -> None:
        self._closed = True

    def _check(self, call: str) -> None:
        if self._closed:
            raise ClosedDatabaseError(call)

    @property
    def metadata(self) -> Metadata:
        return self._db.metadata

    @property
    def build_time(self) -> datetime | None:
        try:
            return datetime.fromtimestamp(self.metadata.build_epoch, UTC)
        except (OverflowError, ValueError, OSError):
            return None

    def lookup(self, ip: str | ipaddress.IPv4Address | ipaddress.IPv6Address) -> Result:
        self._check("Lookup")
        family, hi, lo = parse([str(ip)])
        at, _, nets, errors = lookup(self._db, family, hi, lo)
        return Result(self, int(at[0]) if at[0] >= 0 else None, nets[0], errors[0])

    def lookup_offset(self, offset: int) -> Result:
        self._check("LookupOffset")
        return Result(self, offset, None)

    def networks(self, aliased: bool = False, empty: bool = False, skip_empty_values: bool = False) -> Iterator[Result]:
        yield from self.networks_within(None, aliased, empty, skip_empty_values)

    def networks_within(self, within: str | None, aliased: bool = False, empty: bool = False, skip_empty_values: bool = False) -> Iterator[Result]:
        """Networks in address order."""
        self._check("Networks")
        options = Options(within, aliased, empty, skip_empty_values, True)
        found = leaves(self._db, start_nodes(self._db, within), options)
        for lo in range(0, len(found), 1024):
            cols, offsets, errors = network_batch(self._db, found.take(np.arange(lo, min(lo + 1024, len(found)))), options)
            for at, text, wrong in zip(offsets, cols["network"].to_pylist(), errors, strict=True):
                if at is not None and skip_empty_values and self._db.values.is_empty(at):
                    continue
                yield Result(self, at, text, wrong)

    def infer_schema(self, sample: int = 1000):
        """The type that holds the first distinct records."""
        seen: dict[int, object] = {}
        for r in self.networks():
            if r.found and r.offset not in seen:
                seen[r.offset] = r.decode()
                if len(seen) >= sample:
                    break
        return infer_schema(list(seen.values()))


__all__ = ["NetDb", "NetDbError", "Result"]
