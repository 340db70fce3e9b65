"""Path projection over typed and VARIANT columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_path(col: Column, kind: T.DataType, *path: str | int, strict: bool = True) -> Column:
    """The value at a path of a column of the given type: a name steps into a map, a number into a slice, negative
    ones from its end. Missing keys and indexes give null. A step into the wrong kind is an error, or null if not
    strict; for typed columns it is found before the query runs."""
    for k, step in enumerate(path):
        if isinstance(step, bool) or not isinstance(step, str | int):
            raise TypeError(f"unexpected path element at index {k} ({step}): {type(step).__name__}")
        want = "map" if isinstance(step, str) else "slice"
        if isinstance(kind, T.VariantType):
            col = _variant_step(col, step, strict)
        elif isinstance(step, str) and isinstance(kind, T.StructType):
            if step not in kind.fieldNames():
                return F.lit(None)
            col, kind = col.getField(step), kind[step].dataType
        elif isinstance(step, str) and isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(step)), kind.valueType
        elif isinstance(step, int) and isinstance(kind, T.ArrayType):
            col, kind = F.get(col, F.lit(step)) if step >= 0 else F.try_element_at(col, F.lit(step)), kind.elementType
        elif strict:
            raise ValueError(f"expected a {want} for {step} but found {kind.simpleString()}")
        else:
            return F.lit(None)
    return col


def _variant_step(col: Column, step: str | int, strict: bool) -> Column:
    shape = F.schema_of_variant(col)
    if isinstance(step, str):
        name = re.sub(r"(['\\])", r"\\\1", step)
        got, fits, want = F.variant_get(col, f"$['{name}']", "variant"), shape.startswith("OBJECT"), "map"
    else:
        got = F.variant_get(col, f"$[{step}]", "variant") if step >= 0 else F.try_element_at(F.variant_get(col, "$", "array<variant>"), F.lit(step))
        fits, want = shape.startswith("ARRAY"), "slice"
    wrong = F.raise_error(F.concat(F.lit(f"expected a {want} for {step} but found "), shape)).cast("variant") if strict else F.lit(None).cast("variant")
    return F.when(col.isNull(), F.lit(None).cast("variant")).when(fits, got).otherwise(wrong)
