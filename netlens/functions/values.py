"""Columns over encoded values: decoding and kinds at an offset of a binary column, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_value(data: Column, offset: Column, ddl: str) -> Column:
    """The value at an offset of encoded bytes as a Spark type; null bytes or offset give null, bytes that break the
    format an error."""
    from netlens.sources.netdb import _type

    kind = _type(ddl)

    @F.arrow_udf(kind)
    def run(raw: pa.Array, at: pa.Array) -> pa.Array:
        from netlens.codec import Values, compile_schema
        from netlens.sources.scan import arrow_type, as_dicts

        held, out = Values(b""), []
        step = compile_schema(kind, held)  # one decoder for all rows, which looks at one after the other
        for b, k in zip(raw.to_pylist(), at.to_pylist(), strict=True):
            if b is None or k is None:
                out.append(None)
                continue
            held.data, held.size = memoryview(b), len(b)
            out.append(as_dicts(held.record(k, step), kind))
        return pa.array(out, arrow_type(kind))

    return run(data, offset.cast("long"))


def kind_at(data: Column, offset: Column) -> Column:
    """The name of the kind at an offset, behind a pointer if there is one; nothing is decoded."""

    @F.arrow_udf("string")
    def run(raw: pa.Array, at: pa.Array) -> pa.Array:
        from netlens.codec import Values
        from netlens.kinds import kind_name

        both = zip(raw.to_pylist(), at.to_pylist(), strict=True)
        return pa.array([None if b is None or k is None else kind_name(Values(b).resolve(k)[0]) for b, k in both], pa.string())

    return run(data, offset.cast("long"))


def error_at(data: Column, offset: Column) -> Column:
    """The text of the error that decoding the value at an offset gives, null where it decodes."""

    @F.arrow_udf("string")
    def run(raw: pa.Array, at: pa.Array) -> pa.Array:
        from netlens.codec import Values
        from netlens.kinds import NetDbError

        def one(b: bytes | None, k: int | None) -> str | None:
            try:
                if b is not None and k is not None:
                    Values(b).decode(k)
            except NetDbError as e:
                return str(e)
            return None

        return pa.array([one(b, k) for b, k in zip(raw.to_pylist(), at.to_pylist(), strict=True)], pa.string())

    return run(data, offset.cast("long"))


def is_container(kind: Column) -> Column:
    """Whether a kind's name, as kind_at gives it, is one of those that hold other values."""
    from netlens.kinds import CONTAINERS, kind_name

    return kind.isin(*map(kind_name, sorted(CONTAINERS)))


def is_scalar(kind: Column) -> Column:
    from netlens.kinds import SCALARS, kind_name

    return kind.isin(*map(kind_name, sorted(SCALARS)))
