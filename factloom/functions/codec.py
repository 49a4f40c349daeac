"""Digests and canonical bytes as column expressions, and the strict decoder."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BIGDEC, BIGINT, BOOL, BYTES, CorruptionError, DOUBLE, INSTANT, KEYWORD, LONG, REF, STRING, UUID, ValidationError, big_bytes, big_int

Hash = Callable[[Column], Column]


def hash256(data: Column) -> Column:
    """SHA-256 as 32 bytes, inside code generation."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def entity_id(content: Column) -> Column:
    """An entity's id is the digest of its content."""
    return hash256(content)


def hex_of(data: Column) -> Column:
    return F.lower(F.hex(data))


def _le(x: Column, width: int) -> Column:
    """An integer as little-endian bytes."""
    digits = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


def _double_le(x: Column) -> Column:
    """IEEE bits of a double, little-endian, built from sign, exponent and fraction."""
    v = F.abs(x)
    exponent = F.floor(F.log2(v)).cast("bigint")
    # log2 may round up to the next power of two or down below it
    exponent = F.when(F.pow(F.lit(2.0), exponent) > v, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= v, exponent + 1).otherwise(exponent)
    normal = exponent >= -1022
    scale_a, scale_b = F.pow(F.lit(2.0), F.floor((F.lit(52) - exponent) / 2)), F.pow(F.lit(2.0), F.lit(52) - exponent - F.floor((F.lit(52) - exponent) / 2))
    fraction = (v * scale_a * scale_b).cast("bigint") - F.lit(1 << 52)
    tiny = (v * F.pow(F.lit(2.0), F.lit(537)) * F.pow(F.lit(2.0), F.lit(537))).cast("bigint")
    bits = F.when(v == 0, F.lit(0)).when(v == float("inf"), F.lit(0x7FF << 52)).when(normal, F.shiftleft(exponent + 1023, 52) + fraction).otherwise(tiny)
    return _le(F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits), 8)


def value_bytes(prefix: str = "") -> Column:
    """Tag byte and payload of the value columns."""
    tag, s, n, d, b = (F.col(f"{prefix}{c}") for c in ("v_tag", "v_str", "v_long", "v_dbl", "v_bin"))
    text = s.cast("binary")
    # 128-bit lanes are big-endian with the sign flipped; canonical bytes are little-endian.
    flipped = F.unhex(F.concat(*[F.substring(F.hex(b), 31 - 2 * i, 2) for i in range(15)], F.lpad(F.hex(F.conv(F.substring(F.hex(b), 1, 2), 16, 10).cast("int").bitwiseXOR(F.lit(128))), 2, "0")))
    payload = (
        F.when(tag == KEYWORD, F.concat(_le(F.length(text), 2), text))
        .when(tag == STRING, F.concat(_le(F.length(text), 4), text))
        .when(tag.isin(LONG, INSTANT), _le(n, 8))
        .when(tag == DOUBLE, _double_le(d))
        .when(tag == BOOL, _le(n, 1))
        .when(tag.isin(UUID, REF), b)
        .when(tag == BYTES, F.concat(_le(F.length(b), 4), b))
        .when(tag.isin(BIGINT, BIGDEC), flipped)
    )
    return F.concat(_le(tag, 1), payload)


def tx_bytes(prefix: str = "") -> Column:
    """28 bytes of a transaction id."""
    return F.concat(_le(F.col(f"{prefix}tx_phys"), 8), _le(F.col(f"{prefix}tx_log"), 4), F.col(f"{prefix}tx_node"))


def canonical_bytes(prefix: str = "") -> Column:
    """The whole fact: entity, attribute, value, transaction, operation."""
    return F.concat(signing_fields(prefix, op=False), tx_bytes(prefix), _le(F.col(f"{prefix}op"), 1))


def signing_fields(prefix: str = "", op: bool = True) -> Column:
    """Entity, attribute and value (and operation), without the transaction."""
    a = F.col(f"{prefix}a").cast("binary")
    parts = [F.col(f"{prefix}e"), _le(F.length(a), 2), a, value_bytes(prefix)]
    return F.concat(*parts, *([_le(F.col(f"{prefix}op"), 1)] if op else []))


def content_hash(prefix: str = "", digest: Hash = hash256) -> Column:
    return digest(canonical_bytes(prefix))


def crc32_of(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def valid_attribute(a: Column) -> Column:
    return a.isNotNull() & (F.octet_length(a) <= 65535)


def encode_fact(e: bytes, a: str, tag: int, value, tx: tuple[int, int, bytes], op: int) -> bytes:
    """Canonical bytes of one fact on the driver, for round trips and tests."""
    name = a.encode()
    if len(name) > 65535:
        raise ValidationError("attribute longer than 65535 bytes")
    out = e + struct.pack("<H", len(name)) + name + bytes([tag])
    if tag == KEYWORD:
        out += struct.pack("<H", len(value.encode())) + value.encode()
    elif tag == STRING:
        out += struct.pack("<I", len(value.encode())) + value.encode()
    elif tag in (LONG, INSTANT):
        out += struct.pack("<q", value)
    elif tag == DOUBLE:
        if value != value:
            raise ValidationError("NaN is no value")
        out += struct.pack("<d", value + 0.0)
    elif tag == BOOL:
        out += bytes([bool(value)])
    elif tag in (UUID, REF):
        out += value
    elif tag == BYTES:
        out += struct.pack("<I", len(value)) + value
    elif tag in (BIGINT, BIGDEC):
        big_bytes(value)
        out += value.to_bytes(16, "little", signed=True)
    else:
        raise ValidationError(f"unknown tag {tag}")
    return out + struct.pack("<QI", tx[0], tx[1]) + tx[2] + bytes([op])


def decode_fact(data: bytes) -> tuple:
    """(e, a, tag, value, tx, op) from canonical bytes; anything but exactly one fact is corrupt."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise CorruptionError("fact ends early")
        at += n
        return data[at - n : at]

    try:
        e = take(32)
        a = take(struct.unpack("<H", take(2))[0]).decode()
        tag = take(1)[0]
        if tag in (KEYWORD, STRING):
            value = take(struct.unpack(*(("<H", take(2)) if tag == KEYWORD else ("<I", take(4))))[0]).decode()
        elif tag in (LONG, INSTANT):
            value = struct.unpack("<q", take(8))[0]
        elif tag == DOUBLE:
            value = struct.unpack("<d", take(8))[0]
            if value != value:
                raise CorruptionError("NaN")
        elif tag == BOOL:
            value = take(1)[0]
            if value > 1:
                raise CorruptionError("boolean beyond 0 and 1")
            value = bool(value)
        elif tag in (UUID, REF):
            value = take(16 if tag == UUID else 32)
        elif tag == BYTES:
            value = take(struct.unpack("<I", take(4))[0])
        elif tag in (BIGINT, BIGDEC):
            value = big_int(big_bytes(int.from_bytes(take(16), "little", signed=True)))
        else:
            raise CorruptionError(f"unknown tag {tag}")
        phys, log = struct.unpack("<QI", take(12))
        node, op = take(16), take(1)[0]
    except UnicodeDecodeError as err:
        raise CorruptionError("text is not UTF-8") from err
    if op > 1 or at != len(data):
        raise CorruptionError("bad operation or trailing bytes")
    return e, a, tag, value, (phys, log, node), op
