"""Transactions: building, stamping, metadata, bundles, receipts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import entity_id, tx_bytes
from ..types import ASSERT, BYTES, DATOM_SCHEMA, INSTANT, KEYWORD, REF, RETRACT, TX_COLS, EmptyTransaction, TxId, big_bytes, lane, value_columns
from .schema import validate

BUNDLE_META = ["tx/time", "tx/origin", "tx/predecessor", "tx/provenance", "tx/signature", "tx/signer"]


@dataclass
class Transaction:
    """Collects assertions and retractions; commit() checks all of them or refuses all."""

    node: bytes
    rows: list[tuple] = field(default_factory=list)

    def assert_fact(self, e: bytes, a: str, tag: int, value) -> Transaction:
        return self._add(e, a, tag, value, ASSERT)

    def retract_fact(self, e: bytes, a: str, tag: int, value) -> Transaction:
        return self._add(e, a, tag, value, RETRACT)

    def _add(self, e: bytes, a: str, tag: int, value, op: int) -> Transaction:
        held = {"v_str": None, "v_long": None, "v_dbl": None, "v_bin": None}
        if lane(tag) == "v_bin" and isinstance(value, int):
            value = big_bytes(value)
        held[lane(tag)] = int(value) if lane(tag) == "v_long" else value + 0.0 if lane(tag) == "v_dbl" else value
        self.rows.append((e, a, tag, held["v_str"], held["v_long"], held["v_dbl"], held["v_bin"], 0, 0, bytes(16), op, None))
        return self

    def facts(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, DATOM_SCHEMA)

    def commit(self, spark: SparkSession, schema: DataFrame) -> DataFrame:
        if not self.rows:
            raise EmptyTransaction("no facts")
        out = self.facts(spark)
        validate(out, schema)
        return out

    def commit_unchecked(self, spark: SparkSession) -> DataFrame:
        """The facts as they are, for tests of what validation keeps out."""
        return self.facts(spark)


def together(spark: SparkSession, txs: Sequence[Transaction]) -> DataFrame:
    """The facts of several transactions in one frame, with the number `n_tx` of theirs; none may be empty."""
    if not all(tx.rows for tx in txs):
        raise EmptyTransaction("no facts")
    return spark.createDataFrame([(*row, i) for i, tx in enumerate(txs) for row in tx.rows], T.StructType([*DATOM_SCHEMA.fields, T.StructField("n_tx", T.IntegerType())]))


def stamped(facts: DataFrame, ids: Sequence[TxId], epoch: int) -> DataFrame:
    """What `together` gives as parts of transactions with these ids and consecutive epochs."""
    names = facts.sparkSession.createDataFrame([(i, x.phys, x.log, x.node, epoch + i) for i, x in enumerate(ids)], "n_tx int, tx_phys long, tx_log long, tx_node binary, epoch long")
    out = facts.drop(*TX_COLS, "epoch").join(F.broadcast(names), "n_tx")  # a row a transaction of one commit
    return out.select(*DATOM_SCHEMA.names)


def stamp(datoms: DataFrame, tx: TxId, epoch: int | None = None) -> DataFrame:
    """`datoms` as part of one transaction."""
    return datoms.withColumns({"tx_phys": F.lit(tx.phys).cast("bigint"), "tx_log": F.lit(tx.log).cast("bigint"), "tx_node": F.lit(tx.node), "epoch": F.lit(epoch).cast("bigint")})


def tx_entity(prefix: str = "") -> Column:
    """The entity that stands for a transaction."""
    return entity_id(tx_bytes(prefix))


def _meta(txs: DataFrame, attribute: str, tag: int, value: Column) -> DataFrame:
    epoch = F.col("epoch") if "epoch" in txs.columns else F.lit(None)
    return txs.select(tx_entity().alias("e"), F.lit(attribute).alias("a"), *value_columns(tag, value), *TX_COLS, F.lit(ASSERT).cast("tinyint").alias("op"), epoch.cast("bigint").alias("epoch"))


def tx_metadata(txs: DataFrame) -> DataFrame:
    """For every transaction (tx columns) its time and its origin node."""
    return _meta(txs, "tx/time", INSTANT, F.col("tx_phys")).unionByName(_meta(txs, "tx/origin", REF, entity_id(F.col("tx_node"))))


def federation_metadata(txs: DataFrame, frontier: DataFrame | None = None, provenance: str = "observed", signature: bytes | None = None, signer: bytes | None = None) -> DataFrame:
    """Provenance, a predecessor for each frontier node, and signature and signer if signed."""
    out = _meta(txs, "tx/provenance", KEYWORD, F.lit(f"provenance/{provenance}"))
    if frontier is not None:
        before = frontier.select(*[F.col(c).alias(f"p_{c}") for c in TX_COLS])
        pairs = txs.crossJoin(F.broadcast(before))  # a frontier has a row a node, txs a row a transaction of this commit
        out = out.unionByName(_meta(pairs, "tx/predecessor", REF, tx_entity("p_")))
    if signature is not None:
        out = out.unionByName(_meta(txs, "tx/signature", BYTES, F.lit(signature))).unionByName(_meta(txs, "tx/signer", BYTES, F.lit(signer)))
    return out


def transactions(datoms: DataFrame) -> DataFrame:
    return datoms.select(*TX_COLS).distinct()


def splice(batches: Sequence[tuple[DataFrame, TxId]], epoch: int) -> DataFrame:
    """Several transactions as one append with consecutive epochs from `epoch` and their metadata."""
    out = None
    for i, (rows, tx) in enumerate(batches):
        rows = stamp(rows, tx, epoch + i)
        rows = rows.unionByName(tx_metadata(rows.select(*TX_COLS, "epoch").limit(1)))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise EmptyTransaction("no transactions")
    return out


def bundles(datoms: DataFrame) -> DataFrame:
    """One row a transaction: n_facts of the user's, n_meta, time, provenance, signer, n_predecessors, signed."""
    meta = F.col("a").startswith("tx/")

    def held(attribute: str, column: str) -> Column:
        return F.max(F.when(F.col("a") == attribute, F.col(column)))

    return datoms.groupBy(*TX_COLS).agg(
        F.sum(F.when(meta, 0).otherwise(1)).alias("n_facts"),
        F.sum(F.when(meta, 1).otherwise(0)).alias("n_meta"),
        held("tx/time", "v_long").alias("time"),
        F.coalesce(F.regexp_replace(held("tx/provenance", "v_str"), "^provenance/", ""), F.lit("observed")).alias("provenance"),
        F.max(F.when(F.col("a") == "tx/signer", F.hex("v_bin"))).alias("signer"),
        F.sum(F.when(F.col("a") == "tx/predecessor", 1).otherwise(0)).alias("n_predecessors"),
        (F.max(F.when(F.col("a") == "tx/signature", 1).otherwise(0)) == 1).alias("signed"),
    )


def bundle_contents(datoms: DataFrame) -> DataFrame:
    """(tx columns, facts, signature, signer, predecessors): each transaction's user facts and what its metadata holds.

    The facts of one transaction are together in a row, so this is for transactions, not for bulk loads.
    """
    meta = F.col("a").startswith("tx/")
    content = F.struct("e", "a", "v_tag", "v_str", "v_long", "v_dbl", "v_bin", "op")

    def held(attribute: str) -> Column:
        return F.max(F.when(F.col("a") == attribute, F.col("v_bin")))

    return datoms.groupBy(*TX_COLS).agg(
        F.array_sort(F.collect_list(F.when(~meta, content))).alias("facts"),
        held("tx/signature").alias("signature"),
        held("tx/signer").alias("signer"),
        F.array_sort(F.collect_list(F.when(F.col("a") == "tx/predecessor", F.col("v_bin")))).alias("predecessors"),
    )


def matching_transactions(datoms: DataFrame, accepts) -> DataFrame:
    """Facts of the transactions of which the filter accepts a user fact: those facts, and all
    metadata; `complete` tells whether every user fact of the transaction came along."""
    meta = F.col("a").startswith("tx/")
    ok = datoms.withColumn("_ok", accepts.column() & ~meta)
    per = ok.groupBy(*TX_COLS).agg(F.sum(F.when(F.col("_ok"), 1).otherwise(0)).alias("_n"), F.sum(F.when(meta, 0).otherwise(1)).alias("_all"))
    per = per.where("_n > 0").select(*TX_COLS, (F.col("_n") == F.col("_all")).alias("complete"))
    return ok.where(F.col("_ok") | meta).drop("_ok").join(per, TX_COLS)


@dataclass(frozen=True)
class Receipt:
    """What a commit wrote, its metadata facts included."""

    epoch: int
    tx: TxId
    facts: DataFrame
