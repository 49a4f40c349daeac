"""The data model: a fact is (entity, attribute, value, transaction, operation)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value tags, in the order values of different types compare in. Fixed values.
KEYWORD, STRING, LONG, DOUBLE, BOOL, INSTANT, UUID, BYTES, REF, BIGINT, BIGDEC = range(1, 12)
TAG_NAMES = {
    KEYWORD: "keyword",
    STRING: "string",
    LONG: "long",
    DOUBLE: "double",
    BOOL: "boolean",
    INSTANT: "instant",
    UUID: "uuid",
    BYTES: "bytes",
    REF: "ref",
    BIGINT: "bigint",
    BIGDEC: "bigdec",
}
ASSERT, RETRACT = 0, 1

V_COLS = ["v_tag", "v_str", "v_long", "v_dbl", "v_bin"]
TX_COLS = ["tx_phys", "tx_log", "tx_node"]
ID_COLS = ["e", "a", *V_COLS, *TX_COLS, "op"]

#: The four sort orders. Each is a permutation of the identity columns.
EAVT = ["e", "a", *V_COLS, *TX_COLS, "op"]
AEVT = ["a", "e", *V_COLS, *TX_COLS, "op"]
VAET = [*V_COLS, "a", "e", *TX_COLS, "op"]
AVET = ["a", *V_COLS, "e", *TX_COLS, "op"]
ORDERS = {"eavt": EAVT, "aevt": AEVT, "vaet": VAET, "avet": AVET}

DATOM_SCHEMA = T.StructType(
    [
        T.StructField("e", T.BinaryType()),
        T.StructField("a", T.StringType()),
        T.StructField("v_tag", T.ByteType()),
        T.StructField("v_str", T.StringType()),
        T.StructField("v_long", T.LongType()),
        T.StructField("v_dbl", T.DoubleType()),
        T.StructField("v_bin", T.BinaryType()),
        T.StructField("tx_phys", T.LongType()),
        T.StructField("tx_log", T.LongType()),
        T.StructField("tx_node", T.BinaryType()),
        T.StructField("op", T.ByteType()),
        T.StructField("epoch", T.LongType()),
    ]
)

_LANE = {KEYWORD: "v_str", STRING: "v_str", LONG: "v_long", DOUBLE: "v_dbl", BOOL: "v_long", INSTANT: "v_long", UUID: "v_bin", BYTES: "v_bin", REF: "v_bin", BIGINT: "v_bin", BIGDEC: "v_bin"}
_LANE_TYPE = {"v_str": "string", "v_long": "bigint", "v_dbl": "double", "v_bin": "binary"}


class FactError(Exception):
    """Base of all errors of the engine."""


class StorageError(FactError):
    pass


class CorruptionError(StorageError):
    pass


class ValidationError(FactError):
    pass


class UnknownAttribute(ValidationError):
    pass


class SchemaViolation(ValidationError):
    pass


class EmptyTransaction(ValidationError):
    pass


class SchemaIncompatible(FactError):
    pass


class Backpressure(FactError):
    pass


class SignatureInvalid(FactError):
    pass


class PeerUnreachable(FactError):
    pass


class ChunkError(FactError):
    pass


class QueryError(FactError):
    pass


def lane(tag: int) -> str:
    """The column that holds values of a type."""
    return _LANE[tag]


def value_columns(tag: int, value: Column) -> list[Column]:
    """The five value columns for a value expression of type `tag`; unused ones are null."""
    out = [F.lit(tag).cast("tinyint").alias("v_tag")]
    for name, kind in _LANE_TYPE.items():
        held = value.cast(kind) if name == _LANE[tag] else F.lit(None).cast(kind)
        if name == "v_dbl" and tag == DOUBLE:
            held = held + F.lit(0.0)  # -0.0 becomes 0.0
        out.append(held.alias(name))
    return out


def same_value(left: str, right: str) -> Column:
    """Null-safe equality of the value columns of two aliased frames."""
    out = F.lit(True)
    for c in V_COLS:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


@dataclass(frozen=True, order=True)
class TxId:
    """Hybrid logical time: milliseconds, counter, node; ordered in that sequence."""

    phys: int
    log: int = 0
    node: bytes = bytes(16)

    def __post_init__(self):
        if not 0 <= self.phys < 2**63 or not 0 <= self.log < 2**32 or len(self.node) != 16:
            raise ValidationError(f"no transaction id: {self.phys}, {self.log}, {self.node!r}")


def node_id(seed: int) -> bytes:
    """A 16-byte node id from a small number."""
    return seed.to_bytes(16, "big")


def big_bytes(value: int) -> bytes:
    """A 128-bit integer as 16 bytes whose order is the numbers' order."""
    if not -(2**127) <= value < 2**127:
        raise ValidationError("beyond 128 bits")
    return (value + 2**127).to_bytes(16, "big")


def big_int(data: bytes) -> int:
    return int.from_bytes(data, "big") - 2**127
