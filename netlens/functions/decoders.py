"""Custom decoders ready to be named in a record schema: each reads at a cursor and gives the value and the cursor
behind it."""

from __future__ import annotations

import json

from netlens import kinds as K
from netlens.codec import Cursor, Decoder, to_json_value


def as_json(cursor: Cursor) -> tuple[str, Cursor]:
    """Any value as JSON text."""
    value, after = cursor.read()
    return json.dumps(to_json_value(value), ensure_ascii=False, sort_keys=True), after


def number_text(cursor: Cursor) -> tuple[str, Cursor]:
    """A whole number of any width as decimal text."""
    value, after = cursor.read(K.UINT16, K.UINT32, K.UINT64, K.UINT128, K.INT32)
    return str(value), after


def whole_key(cursor: Cursor) -> tuple[int, Cursor]:
    """A map key of decimal digits as a number."""
    text, after = cursor.read_string()
    if not text.isascii() or not text.isdigit():
        raise K.UnmarshalTypeError(text, "String", "long")
    return int(text), after


def shape(cursor: Cursor) -> tuple[str, Cursor]:
    """The kind of a value, with the number of entries of a map or slice; nothing inside is decoded."""
    kind = cursor.kind()
    return K.kind_name(kind) + (f"({cursor.size()})" if K.is_container(kind) else ""), cursor.skip()


def strict_long(cursor: Cursor) -> tuple[int, Cursor]:
    """A whole number; any other kind is the error that decoding into a long gives."""
    try:
        return cursor.read_integer()
    except K.UnexpectedKindError as e:
        raise K.unmarshal_error(e, "bigint") from e


def initials(decoder: Decoder) -> str:
    """The first letters of a map's texts, by their keys; the older way of decoding."""
    return "".join(str(at.read())[:1] for _, at in sorted(decoder.items(), key=lambda x: x[0]) if at.kind() == K.STRING)
