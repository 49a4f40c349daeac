"""LIVE resolution: fold assertions and retractions in causal order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import TX_COLS, V_COLS, TxId

EAV = ["e", "a", *V_COLS]
#: Nodes (replicas) up to which their ranks are handed to every executor.
BROADCAST_NODES = 10_000


@dataclass(frozen=True)
class TxOrder:
    """Packs a transaction id and the operation into one number that orders like them.

    With the ranges known, time, counter and node rank mostly fit 63 bits, and the maximum of a
    BIGINT is a hash aggregate; beyond that the key is a struct. The lowest part is set for
    assertions, so of one transaction's assertion and retraction of one value the assertion wins.
    """

    base: int
    log_bits: int
    node_bits: int
    wide: bool
    nodes: DataFrame

    @staticmethod
    def of(datoms: DataFrame) -> TxOrder:
        """One pass over the three transaction columns."""
        s = datoms.agg(F.min("tx_phys").alias("lo"), F.max("tx_phys").alias("hi"), F.max("tx_log").alias("log"), F.count_distinct("tx_node").alias("nodes")).first()
        lo, span = s["lo"] or 0, (s["hi"] or 0) - (s["lo"] or 0)
        log_bits, node_bits = max(1, (s["log"] or 0).bit_length()), max(1, int(s["nodes"]).bit_length())
        # Ranked, and read, only if there are few: more nodes are compared by their ids in the wide key.
        nodes = datoms.select("tx_node").distinct().select("tx_node", (F.row_number().over(Window.orderBy("tx_node")) - 1).alias("_node"))
        wide = span.bit_length() + log_bits + node_bits + 1 > 63 or s["nodes"] > BROADCAST_NODES
        return TxOrder(lo, log_bits, node_bits, wide, nodes)

    def _ranks(self) -> DataFrame:
        return F.broadcast(self.nodes)  # BROADCAST_NODES rows at most

    def keyed(self, datoms: DataFrame) -> DataFrame:
        """`datoms` with the key `_k`."""
        if self.wide:
            return datoms.withColumn("_k", F.struct("tx_phys", "tx_log", "tx_node", (1 - F.col("op")).alias("ok")))
        k = F.col("tx_phys") - self.base
        for more, bits in ((F.col("tx_log"), self.log_bits), (F.col("_node"), self.node_bits), (1 - F.col("op"), 1)):
            k = F.shiftleft(k, bits) + more
        return datoms.join(self._ranks(), "tx_node").withColumn("_k", k).drop("_node")

    def asserted(self) -> Column:
        """Whether the event behind `_k` is an assertion."""
        return F.col("_k")["ok"] == 1 if self.wide else F.col("_k").bitwiseAND(F.lit(1)) == 1

    def unpacked(self, rows: DataFrame) -> DataFrame:
        """The transaction columns back from `_k`."""
        if self.wide:
            return rows.withColumns({c: F.col("_k")[c] for c in TX_COLS})

        def part(bits: int, shift: int) -> Column:
            return F.shiftright("_k", shift).bitwiseAND(F.lit((1 << bits) - 1))

        node, log = part(self.node_bits, 1), part(self.log_bits, 1 + self.node_bits)
        phys = F.shiftright("_k", 1 + self.node_bits + self.log_bits) + self.base
        out = rows.withColumns({"_node": node.cast("int"), "tx_log": log.cast("bigint"), "tx_phys": phys.cast("bigint")})
        return out.join(self._ranks(), "_node").drop("_node")


def causal(datoms: DataFrame, order: TxOrder | None = None) -> tuple[DataFrame, TxOrder]:
    """The latest event of every (e, a, v), dead values included, as `_k`."""
    order = order or TxOrder.of(datoms)
    return order.keyed(datoms).groupBy(*EAV).agg(F.max("_k").alias("_k")), order


def live_set(datoms: DataFrame, order: TxOrder | None = None) -> DataFrame:
    """(e, a, v columns, tx columns) of every value whose latest event is an assertion."""
    latest, order = causal(datoms, order)
    return order.unpacked(latest.where(order.asserted())).drop("_k")


def retracted_set(datoms: DataFrame, order: TxOrder | None = None) -> DataFrame:
    """Values whose latest event is a retraction."""
    latest, order = causal(datoms, order)
    return order.unpacked(latest.where(~order.asserted())).drop("_k")


def live_values(datoms: DataFrame, entity: Column | None = None, attribute: str | None = None) -> DataFrame:
    """All LIVE values, of one entity or attribute if given; the filters reach the scan."""
    if entity is not None:
        datoms = datoms.where(F.col("e") == entity)
    if attribute is not None:
        datoms = datoms.where(F.col("a") == attribute)
    return live_set(datoms)


def live_resolve(datoms: DataFrame, order: TxOrder | None = None) -> DataFrame:
    """One LIVE value for each (e, a): that of the latest transaction, of equals the greatest value.

    Rows are dealt by (e, a) once, which serves both the fold and the choice.
    """
    order = order or TxOrder.of(datoms)
    latest = order.keyed(datoms).repartition("e", "a").groupBy(*EAV).agg(F.max("_k").alias("_k"))
    w = Window.partitionBy("e", "a").orderBy(F.desc("_k"), *[F.desc(c) for c in V_COLS])
    chosen = latest.where(order.asserted()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return order.unpacked(chosen).drop("_k", "_rn")


def resolve_by_provenance(datoms: DataFrame, weights: DataFrame) -> DataFrame:
    """Like live_resolve, but the transaction's provenance rank (tx columns, rank) decides first."""
    live = live_set(datoms).join(weights, TX_COLS, "left")
    w = Window.partitionBy("e", "a").orderBy(F.desc(F.coalesce("rank", F.lit(3))), *[F.desc(c) for c in TX_COLS], *[F.desc(c) for c in V_COLS])
    return live.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "rank")


def as_of(datoms: DataFrame, tx: TxId) -> DataFrame:
    """The facts up to a transaction."""
    p, log, node = F.col("tx_phys"), F.col("tx_log"), F.col("tx_node")
    return datoms.where((p <= tx.phys) & ((p < tx.phys) | (log < tx.log) | ((log == tx.log) & (node <= F.lit(tx.node)))))


def tx_range(datoms: DataFrame, low: TxId, high: TxId) -> DataFrame:
    """The facts of the transactions from `low` to `high`, both included."""
    p, log, node = F.col("tx_phys"), F.col("tx_log"), F.col("tx_node")
    from_ = (p >= low.phys) & ((p > low.phys) | (log > low.log) | ((log == low.log) & (node >= F.lit(low.node))))
    return as_of(datoms, high).where(from_)


def snapshot(datoms: DataFrame, epoch: int) -> DataFrame:
    """The facts that were visible at a commit."""
    return datoms.where(F.col("epoch") <= epoch)


def live_counts(datoms: DataFrame) -> DataFrame:
    """One row: n_triples LIVE (e, a, v), n_pairs (e, a) with any."""
    return live_set(datoms).groupBy("e", "a").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"), F.count("*").alias("n_pairs"))


def merge_causal(left: DataFrame, right: DataFrame) -> tuple[DataFrame, TxOrder]:
    """Latest events of two replicas together; the fold is associative and commutative."""
    return causal(left.unionByName(right, allowMissingColumns=True))
