"""Merge, selective merge, differences, equality and shards of fact sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import ID_COLS
from .filters import All, FactFilter


def merge(*stores: DataFrame) -> DataFrame:
    """Set union: commutative, associative and idempotent. Facts in several stores keep the least epoch."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.groupBy(*ID_COLS).agg(F.min("epoch").alias("epoch"))


def _flagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct fact once, with whether it is in either side; one shuffle, combined before it."""
    both = left.select(*ID_COLS, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*ID_COLS, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*ID_COLS).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))


def selective_merge(local: DataFrame, remote: DataFrame, accepts: FactFilter | None = None) -> DataFrame:
    """`local` with the remote facts that a filter accepts; the filter runs at the remote scan."""
    return merge(local, (accepts or All()).apply(remote))


def merge_receipt(local: DataFrame, remote: DataFrame, accepts: FactFilter | None = None) -> DataFrame:
    """One row: transferred, filtered_out and already_present facts of a selective merge."""
    ok = (accepts or All()).column()
    flags = _flagged(local, remote).where("_r = 1")
    return flags.agg(
        F.coalesce(F.sum(F.when(ok & (F.col("_l") == 0), 1).otherwise(0)), F.lit(0)).alias("transferred"),
        F.coalesce(F.sum(F.when(~ok, 1).otherwise(0)), F.lit(0)).alias("filtered_out"),
        F.coalesce(F.sum(F.when(ok & (F.col("_l") == 1), 1).otherwise(0)), F.lit(0)).alias("already_present"),
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(identity columns, side): facts of one side only, `left` or `right`."""
    flags = _flagged(left, right).where("_l <> _r")
    return flags.select(*ID_COLS, F.when(F.col("_l") == 1, "left").otherwise("right").alias("side"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return _flagged(left, right).where("_l = 1 and _r = 1").select(*ID_COLS)


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: equal, and how many facts differ."""
    return difference(left, right).agg(F.count("*").alias("n_different")).select((F.col("n_different") == 0).alias("equal"), "n_different")


def keyed_diff(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, kind): entries of a key-value table that only one side has, or that differ."""
    a, b = left.select(F.col(key).alias("_a"), F.col(value).alias("_av")), right.select(F.col(key).alias("_b"), F.col(value).alias("_bv"))
    both = a.join(b, a._a == b._b, "full_outer")
    kind = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(~F.col("_av").eqNullSafe(F.col("_bv")), "modified")
    return both.select(F.coalesce("_a", "_b").alias(key), kind.alias("kind")).where("kind is not null")


def shard_of(n: int) -> Column:
    """A fact's shard: the little-endian number in its entity's first eight bytes, modulo n."""
    digits = F.hex("e")
    swapped = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % n).cast("int")


def shard(datoms: DataFrame, n: int) -> DataFrame:
    """`datoms` with a `shard` column; shards are disjoint and cover everything."""
    return datoms.withColumn("shard", shard_of(n))


def unshard(*shards: DataFrame) -> DataFrame:
    return merge(*[s.drop("shard") for s in shards])
