"""Bringing two stores to the same facts: chunk fingerprints tell where they differ, facts follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import Hash, hash256
from ..types import ID_COLS
from .fingerprint import SLICES, _joined, _xor, fact_hashes
from .setops import merge

#: Buckets of facts, by the first digits of the digest of their entity; one fingerprint each.
DIGITS = 3


def summary(datoms: DataFrame, digits: int = DIGITS, digest: Hash = hash256) -> DataFrame:
    """(bucket, fingerprint, n): what a peer is sent first; at most 16 ** digits rows, whatever the facts.

    A fact's bucket depends on its entity alone, so both sides deal alike without agreeing on
    positions first.
    """
    rows = fact_hashes(datoms, digest).withColumn("bucket", _bucket(digits))
    return rows.groupBy("bucket").agg(*_xor("_h"), F.count("*").alias("n")).select("bucket", _joined().alias("fingerprint"), "n")


def _bucket(digits: int):
    return F.substring(F.md5(F.col("e")), 1, digits)


def differing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(bucket) of two summaries whose fingerprints differ; a bucket that one lacks is empty there."""
    zero = F.lit("0" * sum(n for _, n in SLICES))
    a, b = local.select("bucket", F.col("fingerprint").alias("_a")), remote.select("bucket", F.col("fingerprint").alias("_b"))
    return a.join(b, "bucket", "full_outer").where(F.coalesce("_a", zero) != F.coalesce("_b", zero)).select("bucket")


def diff(local: DataFrame, remote_summary: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The facts of `local` that a peer with this summary may lack: those of differing buckets only."""
    buckets = F.broadcast(differing(summary(local, digits), remote_summary))  # at most 16 ** digits rows
    return local.withColumn("_bucket", _bucket(digits)).join(buckets, F.col("_bucket") == F.col("bucket"), "left_semi").drop("_bucket")


def apply_diff(store: DataFrame, payload: DataFrame) -> DataFrame:
    """The store with a received diff; it never loses facts, and applying a diff again changes nothing."""
    return merge(store, payload)


def reconcile(a: DataFrame, b: DataFrame, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """Both stores after one exchange in both directions: equal, and the union."""
    for_b, for_a = diff(a, summary(b, digits), digits), diff(b, summary(a, digits), digits)
    return apply_diff(a, for_a), apply_diff(b, for_b)


class NoExchange:
    """Anti-entropy of a single node: nothing to send, and what comes is ignored."""

    @staticmethod
    def diff(local: DataFrame) -> DataFrame:
        return local.limit(0)

    @staticmethod
    def apply_diff(store: DataFrame, payload: DataFrame) -> DataFrame:
        return store


def partitioned(frontiers: DataFrame, now_ms: int, silent_ms: int) -> DataFrame:
    """(tx_node, last, silent) of a frontier: nodes not heard of for longer count as cut off.

    Nothing is refused while nodes are cut off, as facts only add up; recovery is `reconcile`.
    """
    last = F.col("tx_phys")
    return frontiers.select("tx_node", last.alias("last"), (F.lit(now_ms) - last > silent_ms).alias("silent"))


def provenance_kept(merged: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row (lost, foreign): facts of the parts that the merge lacks, transactions included, and the reverse."""
    every = merge(*parts).select(*ID_COLS, F.lit(1).alias("_p"), F.lit(0).alias("_m")).unionByName(merged.select(*ID_COLS, F.lit(0).alias("_p"), F.lit(1).alias("_m")))
    flags = every.groupBy(*ID_COLS).agg(F.max("_p").alias("_p"), F.max("_m").alias("_m"))
    return flags.agg(F.coalesce(F.sum(F.when(F.col("_m") == 0, 1).otherwise(0)), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.when(F.col("_p") == 0, 1).otherwise(0)), F.lit(0)).alias("foreign"))
