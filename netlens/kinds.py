"""Value kinds, wire constants and errors of network database files."""

from __future__ import annotations

# Kind numbers and names of the wire format.
EXTENDED, POINTER, STRING, DOUBLE, BYTES, UINT16, UINT32, MAP = range(8)
INT32, UINT64, UINT128, SLICE, CONTAINER, END_MARKER, BOOL, FLOAT = range(8, 16)
NAMES = (
    "Extended", "Pointer", "String", "Float64", "Bytes", "Uint16", "Uint32", "Map",
    "Int32", "Uint64", "Uint128", "Slice", "Container", "EndMarker", "Bool", "Float32",
)
# The marker before the metadata, the zero bytes after the tree, pointer biases, size thresholds.
MARKER = b"\xab\xcd\xefMaxMind.com"
SEPARATOR = 16
POINTER_BIAS = (0, 2048, 526336, 0)
SIZE_BIAS = (29, 285, 65821)
RECORD_SIZES = (24, 28, 32)
MAX_DEPTH = 512
#: Values of a container from which on its structure is checked as a whole before any of it is decoded.
LARGE = 1024
#: Most payload bytes of the integer kinds.
WIDTH = {UINT16: 2, UINT32: 4, INT32: 4, UINT64: 8, UINT128: 16}

CONTAINERS = frozenset((MAP, SLICE))
SCALARS = frozenset((STRING, DOUBLE, BYTES, UINT16, UINT32, INT32, UINT64, UINT128, BOOL, FLOAT))


def kind_name(kind: int) -> str:
    return NAMES[kind] if 0 <= kind < len(NAMES) else f"Unknown({kind})"


def kind_set_name(kinds: frozenset[int]) -> str:
    """ "A or B" in kind order, "none" without kinds."""
    return " or ".join(kind_name(k) for k in sorted(kinds)) or "none"


class NetDbError(Exception):
    """Base of all errors here."""


class InvalidDatabaseError(NetDbError):
    """The file breaks the format."""


class ClosedDatabaseError(NetDbError):
    def __init__(self, call: str):
        super().__init__(f"cannot call {call} on a closed database")


class UnmarshalTypeError(NetDbError):
    """A value that the wanted type can't hold."""

    def __init__(self, value: object, kind: str, wanted: str):
        super().__init__(f"cannot unmarshal {value} ({kind}) into type {wanted}")


class UnexpectedKindError(NetDbError):
    def __init__(self, found: int, wanted: frozenset[int]):
        self.found, self.wanted = found, wanted
        super().__init__(f"unexpected kind {kind_name(found)}, expected {kind_set_name(wanted)}")


class ContextualError(NetDbError):
    """An error with the offset of the value decoded and the path inside it."""

    def __init__(self, offset: int, path: str, cause: Exception):
        super().__init__(f"at offset {offset}" + (f", path {path}" if path else "") + f": {cause}")
        self.offset, self.path, self.cause = offset, path, cause


def unmarshal_error(error: NetDbError, wanted: str) -> NetDbError:
    """For custom decoders: a mismatch of kinds as the error that decoding into the type `wanted` gives, in its context.
    Any other error, also one further inside, is what it was."""
    if isinstance(error, UnexpectedKindError):
        return UnmarshalTypeError(kind_name(error.found), "Kind", wanted)
    if isinstance(error, ContextualError) and isinstance(error.cause, UnexpectedKindError):
        return ContextualError(error.offset, error.path, unmarshal_error(error.cause, wanted))
    return error


def is_container(kind: int) -> bool:
    return kind in CONTAINERS


def is_scalar(kind: int) -> bool:
    return kind in SCALARS


def end_of_data() -> InvalidDatabaseError:
    return InvalidDatabaseError("unexpected end of database")
