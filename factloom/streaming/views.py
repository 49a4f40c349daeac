"""Commit streams, observers and incrementally kept LIVE views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import All, FactFilter
from ..operators.live import EAV
from ..scratch import materialize
from ..types import DATOM_SCHEMA, FactError


def commit_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Facts of a folder of commit batches as a stream; `max_files` a trigger is the backpressure."""
    reader = spark.readStream.schema(DATOM_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def observe(stream: DataFrame, on_commit: Callable[[int, DataFrame], None], checkpoint: str, accepts: FactFilter | None = None, once: bool = True):
    """Calls on_commit(batch, facts) for every micro-batch, empty filtered ones included.

    Delivery is at least once; the batch number is the key to ignore repeats by.
    """
    rows = (accepts or All()).apply(stream)
    writer = rows.writeStream.foreachBatch(lambda df, epoch: on_commit(epoch, df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def delta_since(datoms: DataFrame, epoch: int) -> DataFrame:
    """Exactly the facts committed after an epoch."""
    return datoms.where(F.col("epoch") > epoch)


@dataclass
class Observer:
    """A subscriber in the writing process: each commit once, gaps closed from the store."""

    on_commit: Callable[[int, DataFrame], None]
    on_catchup: Callable[[int, DataFrame], None] | None = None
    accepts: FactFilter = field(default_factory=All)
    last_epoch: int = 0

    def register(self, db) -> Observer:
        """Catches up on what is there, then follows."""
        if db.epoch > 0:
            self._catch_up(db.epoch, db)
        db.observers.append(self)
        return self

    def _catch_up(self, epoch: int, db) -> None:
        rows = self.accepts.apply(delta_since(db.datoms(), self.last_epoch))
        (self.on_catchup or self.on_commit)(epoch, rows)
        self.last_epoch = epoch

    def publish(self, epoch: int, facts: DataFrame, db) -> None:
        """Once for each commit; missed ones come from the writer's recent commits, older ones from the store."""
        if epoch <= self.last_epoch:
            return
        if epoch > self.last_epoch + 1:
            missed = [(i, f) for i, f in db.recent if self.last_epoch < i < epoch]
            if [i for i, _ in missed] != list(range(self.last_epoch + 1, epoch)):
                self._catch_up(epoch, db)
                return
            for i, f in missed:
                self.on_commit(i, self.accepts.apply(f))
        self.on_commit(epoch, self.accepts.apply(facts))
        self.last_epoch = epoch

    def observe(self, epoch: int) -> None:
        if epoch < self.last_epoch:
            raise FactError("epochs never go back")
        self.last_epoch = epoch


def causal_key():
    """A comparable key of transaction and operation as text; assertions win ties."""
    return F.concat(F.lpad(F.hex("tx_phys"), 16, "0"), F.lpad(F.hex("tx_log"), 16, "0"), F.hex("tx_node"), F.when(F.col("op") == 0, "1").otherwise("0"))


def live_stream(stream: DataFrame) -> DataFrame:
    """Streaming LIVE: for every (e, a, v) its latest event, updated as facts arrive in any order.

    The maximum over transactions doesn't depend on the order of arrival, so late facts need no
    watermark; state holds a row for each value that ever was.
    """
    key = causal_key()
    latest = stream.groupBy(*EAV).agg(F.max(key).alias("_key"))
    return latest.withColumn("live", F.col("_key").endswith("1"))


def keep_live(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Runs live_stream into a folder: each batch writes the values it changed, under its own number.

    A batch that is run again replaces what it wrote, so each counts once. Nothing passes the driver.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.select(*EAV, "_key").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = live_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kept_live(spark: SparkSession, path: str) -> DataFrame:
    """(e, a, v columns, live) of what keep_live wrote: each value's latest batch decides."""
    rows = spark.read.parquet(path).groupBy(*EAV).agg(F.max("_key").alias("_key"))
    return rows.withColumn("live", F.col("_key").endswith("1"))


def apply_delta(latest: DataFrame, delta: DataFrame) -> DataFrame:
    """A materialised (e, a, v, _key) table after more facts: only values that the delta touches are folded anew.

    The table itself is read once and not shuffled where Spark broadcasts the delta's values.
    """
    new = materialize(delta.groupBy(*EAV).agg(F.max(causal_key()).alias("_key")), "live-delta")
    value = F.struct(*EAV)
    touched = new.select(value.alias("_v"))
    old = latest.select(*EAV, "_key")
    same = value.eqNullSafe(F.col("_v"))
    changed = old.join(touched, same, "left_semi").unionByName(new).groupBy(*EAV).agg(F.max("_key").alias("_key"))
    return old.join(touched, same, "left_anti").unionByName(changed)


def windowed_counts(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Facts by attribute and event-time window of their transactions, with a watermark."""
    timed = stream.withColumn("at", F.timestamp_millis("tx_phys")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "a").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "a", "n")
