"""The trust boundary: facts from outside become facts of the engine only if each is well formed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import decode_fact, valid_attribute
from ..types import BIGDEC, BIGINT, BOOL, DATOM_SCHEMA, DOUBLE, KEYWORD, REF, UUID, CorruptionError, big_bytes, lane

_BYTES = {UUID: 16, REF: 32, BIGINT: 16, BIGDEC: 16}


def problem() -> Column:
    """What is wrong with a row of facts, null if nothing is."""
    tag = F.col("v_tag")
    held = F.lit(False)
    for t in range(KEYWORD, BIGDEC + 1):
        fits = F.lit(True)
        for c in ("v_str", "v_long", "v_dbl", "v_bin"):
            fits = fits & (F.col(c).isNotNull() if c == lane(t) else F.col(c).isNull())
        held = held | ((tag == t) & fits)
    sizes = F.lit(True)
    for t, n in _BYTES.items():
        sizes = sizes & ((tag != t) | (F.octet_length("v_bin") == n))
    bad = [
        (F.col("e").isNull() | (F.octet_length("e") != 32), "entity"),
        (~valid_attribute(F.col("a")), "attribute"),
        (tag.isNull() | ~tag.between(KEYWORD, BIGDEC), "value type"),
        (~held, "value"),
        (~sizes, "value length"),
        ((tag == DOUBLE) & F.isnan("v_dbl"), "not a number"),
        ((tag == BOOL) & ~F.col("v_long").isin(0, 1), "boolean"),
        (F.col("tx_phys").isNull() | (F.col("tx_phys") < 0) | F.col("tx_log").isNull() | ~F.col("tx_log").between(0, 2**32 - 1) | F.col("tx_node").isNull() | (F.octet_length("tx_node") != 16), "transaction"),
        (F.col("op").isNull() | ~F.col("op").isin(0, 1), "operation"),
    ]
    out = F.lit(None).cast("string")
    for wrong, name in reversed(bad):
        out = F.when(wrong, F.lit(name)).otherwise(out)
    return out


def rejected(rows: DataFrame) -> DataFrame:
    """The rows that are no facts, with `problem`."""
    return rows.withColumn("problem", problem()).where("problem is not null")


def into_trusted(rows: DataFrame) -> DataFrame:
    """`rows` as facts: the first one that isn't well formed stops the run that reads it."""
    bad = problem()
    checked = rows.where(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("no fact: "), bad)).cast("boolean")))
    zero = F.when(F.col("v_dbl") == 0, F.lit(0.0)).otherwise(F.col("v_dbl"))  # -0.0 is 0.0
    return checked.select(*[zero.alias(f.name) if f.name == "v_dbl" else F.col(f.name).cast(f.dataType).alias(f.name) for f in DATOM_SCHEMA.fields])


def decode_facts(payloads: DataFrame, column: str = "data", epoch: str | None = None) -> DataFrame:
    """Facts out of a column of canonical bytes, each strictly one fact; anything else is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    raise CorruptionError("no bytes")
                e, a, tag, value, (phys, log, node), op = decode_fact(data)
                if phys >= 2**63:
                    raise CorruptionError("time beyond 63 bits")
                values = dict.fromkeys(("v_str", "v_long", "v_dbl", "v_bin"))
                values[lane(tag)] = big_bytes(value) if tag in (BIGINT, BIGDEC) else int(value) if lane(tag) == "v_long" else value
                rows.append((e, a, tag, *values.values(), phys, log, node, op, at))
            kinds = [pa.binary(), pa.string(), pa.int8(), pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int8(), pa.int64()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], DATOM_SCHEMA.names)

    at = F.col(epoch).cast("bigint") if epoch else F.lit(None).cast("bigint")
    return payloads.select(F.col(column), at.alias("_epoch")).mapInArrow(run, DATOM_SCHEMA)


