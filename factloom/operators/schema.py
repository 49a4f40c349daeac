"""Schemas are facts: genesis attributes, evolution, validation, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ASSERT, KEYWORD, TAG_NAMES, SchemaIncompatible, SchemaViolation, UnknownAttribute

TAG_OF_TYPE = {f"db.type/{name}": tag for tag, name in TAG_NAMES.items()}
CARDINALITIES = ["one", "many"]
MODES = ["lww", "multivalue"]

# The attributes every store starts with: name, type, cardinality, resolution. Fixed values.
GENESIS = [
    ("db/cardinality", "keyword", "one", "lww"),
    ("db/doc", "string", "one", "lww"),
    ("db/ident", "keyword", "one", "lww"),
    ("db/isComponent", "boolean", "one", "lww"),
    ("db/latticeOrder", "ref", "one", "lww"),
    ("db/lwwClock", "keyword", "one", "lww"),
    ("db/resolutionMode", "keyword", "one", "lww"),
    ("db/unique", "keyword", "one", "lww"),
    ("db/valueType", "keyword", "one", "lww"),
    ("lattice/bottom", "keyword", "one", "lww"),
    ("lattice/comparator", "string", "one", "lww"),
    ("lattice/elements", "string", "one", "lww"),
    ("lattice/ident", "keyword", "one", "lww"),
    ("lattice/top", "keyword", "one", "lww"),
    ("tx/derivation-input", "ref", "many", "multivalue"),
    ("tx/derivation-rule", "keyword", "one", "lww"),
    ("tx/derivation-source", "keyword", "one", "lww"),
    ("tx/origin", "ref", "one", "lww"),
    ("tx/predecessor", "ref", "many", "multivalue"),
    ("tx/provenance", "keyword", "one", "lww"),
    ("tx/rationale", "string", "one", "lww"),
    ("tx/signature", "bytes", "one", "lww"),
    ("tx/signer", "bytes", "one", "lww"),
    ("tx/time", "instant", "one", "lww"),
    ("tx/validation-override", "string", "one", "lww"),
]

SCHEMA_TYPE = T.StructType(
    [
        T.StructField("attr", T.StringType()),
        T.StructField("value_type", T.IntegerType()),
        T.StructField("cardinality", T.IntegerType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("doc", T.StringType()),
    ]
)
DEFINITION = ["value_type", "cardinality", "mode", "doc"]


def genesis(spark: SparkSession) -> DataFrame:
    tags = {name: tag for tag, name in TAG_NAMES.items()}
    return spark.createDataFrame([(a, tags[t], CARDINALITIES.index(c), MODES.index(m), None) for a, t, c, m in GENESIS], SCHEMA_TYPE)


def definitions(datoms: DataFrame) -> DataFrame:
    """(tx columns, e, attr, value_type, cardinality, problem) of entities that define an attribute.

    An entity defines one if, in one transaction, it asserts db/ident, db/valueType and
    db/cardinality as keywords; several or unknown values of one of them are a problem.
    """
    parts = datoms.where((F.col("op") == ASSERT) & (F.col("v_tag") == KEYWORD) & F.col("a").isin("db/ident", "db/valueType", "db/cardinality"))
    values = [F.collect_set(F.when(F.col("a") == a, F.col("v_str"))).alias(c) for a, c in (("db/ident", "_i"), ("db/valueType", "_t"), ("db/cardinality", "_c"))]
    per = parts.groupBy("tx_phys", "tx_log", "tx_node", "e").agg(*values).where("size(_i) > 0 and size(_t) > 0 and size(_c) > 0")
    kinds = F.create_map(*[F.lit(x) for k, v in TAG_OF_TYPE.items() for x in (k, v)])
    cards = F.create_map(F.lit("db.cardinality/one"), F.lit(0), F.lit("db.cardinality/many"), F.lit(1))
    tag, card = F.try_element_at(kinds, F.element_at("_t", 1)), F.try_element_at(cards, F.element_at("_c", 1))
    problem = F.when((F.size("_i") > 1) | (F.size("_t") > 1) | (F.size("_c") > 1), "conflicting values").when(tag.isNull(), "unknown type").when(card.isNull(), "unknown cardinality")
    return per.select("tx_phys", "tx_log", "tx_node", "e", F.array_min("_i").alias("attr"), tag.alias("value_type"), card.alias("cardinality"), problem.alias("problem"))


def evolve(datoms: DataFrame, base: DataFrame | None = None, check: bool = False) -> DataFrame:
    """The schema after `datoms`: later transactions win; within one the least definition."""
    found = definitions(datoms)
    if check and not found.where("problem is not null").isEmpty():
        raise SchemaViolation("a definition has conflicting or unknown values")
    good = found.where("problem is null").withColumns({"mode": F.lit(0), "doc": F.lit(None).cast("string")})
    # Latest transaction first, then the least definition.
    latest = good.groupBy("attr", "tx_phys", "tx_log", "tx_node").agg(F.min(F.struct(*DEFINITION)).alias("d"))
    latest = latest.groupBy("attr").agg(F.max_by("d", F.struct("tx_phys", "tx_log", "tx_node")).alias("d")).select("attr", "d.*")
    if base is None:
        return latest
    return base.join(latest, "attr", "left_anti").unionByName(latest)


def violations(datoms: DataFrame, schema: DataFrame) -> DataFrame:
    """Facts whose attribute is unknown or whose value has another type, with `problem`."""
    types = schema.select(F.col("attr").alias("_attr"), F.col("value_type").alias("_type"))
    rows = datoms.join(types, datoms.a == types._attr, "left")
    problem = F.when(F.col("_attr").isNull(), "unknown attribute").when(F.col("_type") != F.col("v_tag"), "wrong type")
    return rows.withColumn("problem", problem).where("problem is not null").drop("_attr", "_type")


def validate(datoms: DataFrame, schema: DataFrame) -> None:
    """Raises on the first violation in fact order."""
    first = violations(datoms, schema).orderBy("e", "a", "v_tag").select("a", "problem").head(1)
    if first:
        kind = UnknownAttribute if first[0]["problem"] == "unknown attribute" else SchemaViolation
        raise kind(f"{first[0]['a']}: {first[0]['problem']}")


def merge_schemas(left: DataFrame, right: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(schema, conflicts): the union; where both define an attribute differently the least stays.

    conflicts has attr and the kept and discarded definition as text; strict raises on any.
    """
    a, b = (x.select(F.col("attr").alias(f"_{p}"), F.struct(*DEFINITION).alias(f"_{p}d")) for x, p in ((left, "l"), (right, "r")))
    both = a.join(b, F.col("_l") == F.col("_r"), "full_outer")
    merged = both.select(F.coalesce("_l", "_r").alias("attr"), F.least("_ld", "_rd").alias("d")).select("attr", "d.*")
    clash = both.where(F.col("_ld").isNotNull() & F.col("_rd").isNotNull() & ~F.col("_ld").eqNullSafe(F.col("_rd")))

    def text(d):
        names = F.create_map(*[F.lit(x) for k, v in TAG_NAMES.items() for x in (k, v)])
        return F.concat_ws(" ", F.element_at(names, d["value_type"]), F.when(d["cardinality"] == 0, "one").otherwise("many"), F.when(d["mode"] == 0, "lww").otherwise("multivalue"))

    conflicts = clash.select(F.col("_l").alias("attr"), text(F.least("_ld", "_rd")).alias("kept"), text(F.greatest("_ld", "_rd")).alias("discarded"))
    if strict and not conflicts.isEmpty():
        raise SchemaIncompatible("attributes are defined differently")
    return merged, conflicts
