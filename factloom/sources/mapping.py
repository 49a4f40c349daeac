"""Relational rows as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import entity_id
from ..types import ASSERT, DATOM_SCHEMA, DOUBLE, ID_COLS, INSTANT, LONG, REF, RETRACT, STRING, value_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_of(seed: Column) -> Column:
    return F.unhex(F.lpad(F.hex(seed.cast("bigint")), 32, "0"))


def facts(rows: DataFrame, entity: Column, attribute: Column, tag: int, value: Column, phys: Column, log: Column, node: Column, op: Column, epoch: Column | None = None) -> DataFrame:
    """A fact for each row of `rows`."""
    return rows.select(
        entity_id(entity).alias("e"),
        attribute.alias("a"),
        *value_columns(tag, value),
        phys.cast("bigint").alias("tx_phys"),
        log.cast("bigint").alias("tx_log"),
        node_of(node).alias("tx_node"),
        op.cast("tinyint").alias("op"),
        (F.lit(None) if epoch is None else epoch).cast("bigint").alias("epoch"),
    )


def millis(ts: str) -> Column:
    """Milliseconds since 1970; truncated from microseconds."""
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-varying numbers with retractions from the events table."""
    ev = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 5 == 0, RETRACT).otherwise(ASSERT)
    return facts(
        ev,
        F.concat(F.lit("user/"), F.col("user_id").cast("string")),
        F.concat(F.lit("event/"), F.col("event_type")),
        LONG,
        F.floor("value"),
        millis("ts"),
        F.col("event_id"),
        F.col("event_id") % 4,
        op,
        F.floor(F.col("event_id") / 1000),
    )


def _edge(rows: DataFrame, attribute: str, source: str, source_key: str, target: str, target_key: str) -> DataFrame:
    to = entity_id(F.concat(F.lit(f"{target}/"), F.col(target_key).cast("string")))
    return facts(rows, F.concat(F.lit(f"{source}/"), F.col(source_key).cast("string")), F.lit(attribute), REF, to, F.lit(1), F.lit(0), F.lit(0), F.lit(ASSERT))


def reference_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as references: order -> customer -> nation -> region, and supplier -> nation."""
    out = _edge(table(spark, sf_dir, "orders"), "order/customer", "order", "o_orderkey", "customer", "o_custkey")
    out = out.unionByName(_edge(table(spark, sf_dir, "customer"), "customer/nation", "customer", "c_custkey", "nation", "c_nationkey"))
    out = out.unionByName(_edge(table(spark, sf_dir, "supplier"), "supplier/nation", "supplier", "s_suppkey", "nation", "s_nationkey"))
    return out.unionByName(_edge(table(spark, sf_dir, "nation"), "nation/region", "nation", "n_nationkey", "region", "n_regionkey"))


def scalar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain attributes of orders and customers, each order's in its own transaction."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    when, key = millis("o_orderdate"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    ck = F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))
    parts = [
        facts(o, key, F.lit("order/status"), STRING, F.col("o_orderstatus"), when, F.lit(0), F.lit(1), F.lit(ASSERT)),
        facts(o, key, F.lit("order/total"), DOUBLE, F.col("o_totalprice"), when, F.lit(0), F.lit(1), F.lit(ASSERT)),
        facts(o, key, F.lit("order/date"), INSTANT, when, when, F.lit(0), F.lit(1), F.lit(ASSERT)),
        facts(c, ck, F.lit("customer/segment"), STRING, F.col("c_mktsegment"), F.lit(1), F.lit(0), F.lit(1), F.lit(ASSERT)),
        facts(c, ck, F.lit("customer/balance"), DOUBLE, F.col("c_acctbal"), F.lit(1), F.lit(0), F.lit(1), F.lit(ASSERT)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping replicas of the event facts; tx_log is the event's number."""
    d = event_facts(spark, sf_dir)
    return d.where(F.col("tx_log") % 3 != 0), d.where(F.col("tx_log") % 3 != 1)


def canonical(datoms: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct facts, range-partitioned by entity and sorted within partitions."""
    out = datoms.dropDuplicates(ID_COLS)
    out = out.repartitionByRange(partitions, "e") if partitions else out.repartitionByRange("e")
    return out.sortWithinPartitions(*ID_COLS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DATOM_SCHEMA)
