"""A store in a folder: commit batches as Parquet, made visible by an atomically replaced manifest."""

from __future__ import annotations

import json
import threading
import uuid
from collections import deque
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import HybridClock, frontier
from ..functions.codec import canonical_bytes, signing_fields
from ..functions.signing import public_key, sign, signing_message
from ..operators import schema as schemas
from ..operators.filters import All, FactFilter
from ..operators.fingerprint import fingerprint
from ..operators.live import live_set, snapshot
from ..operators.schema import validate
from ..operators.setops import merge
from ..operators.state import FactStore
from ..operators.txn import Receipt, Transaction, federation_metadata, stamp, stamped, together, tx_metadata
from ..types import DATOM_SCHEMA, ID_COLS, TX_COLS, V_COLS, Backpressure, CorruptionError, EmptyTransaction, StorageError, TxId, same_value

MAX_WRITERS = 64
#: Commits that late observers catch up on without reading the store.
RECENT = 1024


class Files:
    """Small files and renames through the session's file system, local or not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(name))] if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as err:
            if "ChecksumException" in str(err):
                raise CorruptionError(f"{name} fails its checksum") from err
            raise StorageError(f"{name} can't be read") from err
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes beside and renames, so a reader sees all of it or nothing; refuses to replace."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(beside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self.path(beside), self.path(name)):
            self.fs.delete(self.path(beside), False)
            raise StorageError(f"{name} exists already")


@dataclass(frozen=True)
class Manifest:
    """One commit's view: the batches that are visible, and since which checkpoint."""

    epoch: int
    batches: tuple[str, ...]
    checkpoint: str | None
    last: tuple[int, int, str] | None

    def text(self) -> str:
        return json.dumps({"epoch": self.epoch, "batches": self.batches, "checkpoint": self.checkpoint, "last": self.last})

    @staticmethod
    def parse(text: str) -> Manifest:
        try:
            x = json.loads(text)
            return Manifest(x["epoch"], tuple(x["batches"]), x["checkpoint"], tuple(x["last"]) if x["last"] else None)
        except (ValueError, KeyError, TypeError) as err:
            raise CorruptionError("the manifest can't be read") from err


class Database:
    """Readers see the latest manifest; writers append a batch and then a manifest, one at a time.

    Files of a commit that died before its manifest are never read. Old manifests stay, so any
    epoch can be read as it was.
    """

    def __init__(self, spark: SparkSession, root: str, node: bytes = bytes(16), now=None):
        self.spark, self.files = spark, Files(spark, root)
        self.node, self.clock = node, HybridClock(node, now)
        self._lock, self._writers = threading.Lock(), threading.Semaphore(MAX_WRITERS)
        self.observers: list = []
        self.recent: deque[tuple[int, DataFrame]] = deque(maxlen=RECENT)
        last = self.manifest.last
        if last:
            self.clock.receive(TxId(last[0], last[1], bytes.fromhex(last[2])))

    # reading

    @property
    def manifest(self) -> Manifest:
        """The latest readable manifest; a damaged one counts as not committed."""
        for name in sorted(self.files.names("_commits"), reverse=True):
            if name.endswith(".json"):
                try:
                    return Manifest.parse(self.files.read(f"_commits/{name}"))
                except CorruptionError:
                    continue
        return Manifest(0, (), None, None)

    @property
    def epoch(self) -> int:
        return self.manifest.epoch

    def _read(self, m: Manifest) -> DataFrame:
        paths = [f"{self.files.root}/{b}" for b in m.batches]
        out = self.spark.read.schema(DATOM_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], DATOM_SCHEMA)
        if m.checkpoint:
            kept = self.spark.read.parquet(f"{self.files.root}/{m.checkpoint}/datoms")
            out = kept.select(*DATOM_SCHEMA.names).unionByName(out)
        return out

    def datoms(self) -> DataFrame:
        return self._read(self.manifest)

    def _checkpointed(self, m: Manifest, live: bool) -> DataFrame:
        kept = self.spark.read.parquet(f"{self.files.root}/{m.checkpoint}/datoms")
        return kept.where(f"is_live = {int(live)}").select(*DATOM_SCHEMA.names)

    def live_first(self) -> DataFrame:
        """Enough for current values: the checkpoint's LIVE partition, later batches, and of the
        checkpoint's history only what concerns values that these batches touch."""
        m = self.manifest
        later = self._read(Manifest(m.epoch, m.batches, None, m.last))
        if not m.checkpoint:
            return later
        out = self._checkpointed(m, True).unionByName(later)
        if not m.batches:
            return out
        value = F.struct("e", "a", *V_COLS)
        touched = later.select(value.alias("_touched")).distinct()
        return out.unionByName(self._checkpointed(m, False).join(touched, value.eqNullSafe(F.col("_touched")), "left_semi"))

    def history(self) -> DataFrame:
        """The checkpoint's facts that are not LIVE in it; with its LIVE ones and later batches, everything."""
        m = self.manifest
        return self._checkpointed(m, False) if m.checkpoint else self.spark.createDataFrame([], DATOM_SCHEMA)

    def batches(self) -> list[tuple[int, DataFrame]]:
        """(epoch, facts) of the commits since the checkpoint, in order, to be replayed."""
        m = self.manifest
        rows = self._read(Manifest(m.epoch, m.batches, None, m.last))
        epochs = sorted(r["epoch"] for r in rows.select("epoch").distinct().collect())  # a row a commit since the checkpoint
        return [(i, rows.where(F.col("epoch") == i)) for i in epochs]

    def state(self) -> FactStore:
        """The whole store as a value."""
        return FactStore(self.datoms(), self.schema(), self.epoch, self.node)

    def snapshot(self, epoch: int | None = None) -> DataFrame:
        return self.datoms() if epoch is None else snapshot(self.datoms(), epoch)

    def schema(self) -> DataFrame:
        return schemas.evolve(self.datoms(), schemas.genesis(self.spark))

    def frontier(self) -> DataFrame:
        return frontier(self.datoms())

    # writing

    def transact(self, tx: Transaction, provenance: str = "observed", secret: bytes | None = None, checked: bool = True) -> Receipt:
        """Validates, stamps, adds metadata, writes, publishes, then tells the observers; not `checked`, facts aren't validated."""
        return self._commit([tx], provenance, secret, checked)[0]

    def batch_transact(self, txs: list[Transaction]) -> list[Receipt]:
        """Several transactions, each with its epoch, in one append."""
        return self._commit(txs, None, None)

    def _commit(self, txs: list[Transaction], provenance: str | None, secret: bytes | None, validated: bool = True) -> list[Receipt]:
        if not txs:
            raise EmptyTransaction("no transactions")
        if not self._writers.acquire(blocking=False):
            raise Backpressure(f"{MAX_WRITERS} writers already")
        try:
            if not self._lock.acquire(blocking=False):
                raise Backpressure("another commit is under way")
            try:
                m, schema = self.manifest, self.schema()
                facts = together(self.spark, txs)
                if validated:
                    validate(facts.drop("n_tx"), schema)
                ids = [self.clock.tick() for _ in txs]
                facts = stamped(facts, ids, m.epoch + 1)
                rows = facts.unionByName(tx_metadata(facts.select(*TX_COLS, "epoch").distinct()))
                if provenance is not None:
                    rows = rows.unionByName(self._federation(facts, ids[0], m.epoch + 1, provenance, secret))
                schemas.evolve(rows, check=True)
                batch = f"batches/epoch-{m.epoch + 1:012d}-{uuid.uuid4().hex[:8]}"
                rows.dropDuplicates(ID_COLS).sortWithinPartitions(*ID_COLS).write.parquet(f"{self.files.root}/{batch}")
                last = ids[-1]
                new = Manifest(m.epoch + len(txs), (*m.batches, batch), m.checkpoint, (last.phys, last.log, last.node.hex()))
                self.files.write(f"_commits/{new.epoch:012d}.json", new.text())
            finally:
                self._lock.release()
        finally:
            self._writers.release()
        written = self.spark.read.schema(DATOM_SCHEMA).parquet(f"{self.files.root}/{batch}")
        receipts = [Receipt(m.epoch + 1 + i, tx, written.where(F.col("epoch") == m.epoch + 1 + i)) for i, tx in enumerate(ids)]
        for r in receipts:
            self.recent.append((r.epoch, r.facts))
            for observer in list(self.observers):
                observer.publish(r.epoch, r.facts, self)
        return receipts

    def _federation(self, facts: DataFrame, tx: TxId, epoch: int, provenance: str, secret: bytes | None) -> DataFrame:
        one = stamp(facts, tx, epoch).select(*TX_COLS, "epoch").limit(1)
        before, signature, signer = self.frontier(), None, None
        if secret is not None:
            from ..functions.codec import tx_bytes

            signer = public_key(secret)
            own = [bytes(r[0]) for r in facts.select(signing_fields()).collect()]  # one transaction
            prior = [bytes(r[0]) for r in before.select(tx_bytes()).collect()]  # a row a node
            state = bytes.fromhex(fingerprint(self.datoms()).first()[0])
            message = signing_message(own, bytes(one.select(tx_bytes()).first()[0]), prior, state, signer)
            signature = sign(secret, message)
        return federation_metadata(one, before, provenance, signature, signer)

    def novel(self, rows: DataFrame) -> DataFrame:
        """The facts of `rows`, each once, that the store lacks; a summary of its digests spares most a look."""
        known = self.datoms()
        rows = rows.dropDuplicates(ID_COLS)
        marked = DedupFilter(self.spark).insert(known).probably_contains(rows)
        maybe = marked.where("maybe").select(*rows.columns)
        on = [F.col(f"m.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ID_COLS]
        return marked.where("not maybe").select(*rows.columns).unionByName(maybe.alias("m").join(known.alias("k"), on, "left_anti"))

    # checkpoints

    def checkpoint(self) -> str:
        """Folds all batches into one sorted table partitioned by is_live, and publishes it."""
        m = self.manifest
        return self._write_checkpoint(self.datoms(), m.epoch, m.last)

    def _write_checkpoint(self, rows: DataFrame, epoch: int, last: tuple[int, int, str] | None) -> str:
        live = live_set(rows).select("e", "a", *V_COLS, *TX_COLS).withColumn("_live", F.lit(True))
        on = [F.col("d.e") == F.col("l.e"), F.col("d.a") == F.col("l.a"), same_value("d", "l"), *[F.col(f"d.{c}") == F.col(f"l.{c}") for c in TX_COLS], F.col("d.op") == 0]
        marked = rows.alias("d").join(live.alias("l"), on, "left").select("d.*", F.when(F.col("l._live"), 1).otherwise(0).alias("is_live"))
        name = f"checkpoints/{epoch:012d}-{uuid.uuid4().hex[:8]}"
        marked.dropDuplicates(ID_COLS).repartitionByRange("e").sortWithinPartitions(*ID_COLS).write.partitionBy("is_live").parquet(f"{self.files.root}/{name}/datoms")
        print_ = fingerprint(self.spark.read.parquet(f"{self.files.root}/{name}/datoms").select(*DATOM_SCHEMA.names)).first()[0]
        self.files.write(f"{name}/meta.json", json.dumps({"epoch": epoch, "fingerprint": print_}))
        new = Manifest(epoch, (), name, last)  # its name sorts after that of the epoch's commit
        self.files.write(f"_commits/{epoch:012d}z.json", new.text())
        return name

    def verify_checkpoint(self) -> None:
        m = self.manifest
        if m.checkpoint:
            meta = json.loads(self.files.read(f"{m.checkpoint}/meta.json"))
            kept = self.spark.read.parquet(f"{self.files.root}/{m.checkpoint}/datoms").select(*DATOM_SCHEMA.names)
            if fingerprint(kept).first()[0] != meta["fingerprint"]:
                raise CorruptionError("the checkpoint's facts differ from its fingerprint")


def create(spark: SparkSession, root: str, state: FactStore | None = None, node: bytes = bytes(16)) -> Database:
    """A new store in a folder that holds none: empty, or with a store value's facts and epoch as its first checkpoint."""
    db = Database(spark, root, node)
    if db.files.names("_commits"):
        raise StorageError(f"{root} holds a store already")
    if state is not None:
        last = state.facts.agg(F.max(F.struct(*TX_COLS)).alias("t")).first()["t"]
        db._write_checkpoint(state.facts, state.epoch, (last["tx_phys"], last["tx_log"], bytes(last["tx_node"]).hex()) if last else None)
        if last:
            db.clock.receive(TxId(last["tx_phys"], last["tx_log"], bytes(last["tx_node"])))
    return db


class DedupFilter:
    """A Bloom filter of facts, 64 KB with four hashes: it never denies a fact that was put in.

    Spark sets the bits, so the driver gets 8192 words at most, and tests are plain expressions.
    """

    WORDS, HASHES = 8192, 4

    def __init__(self, spark: SparkSession):
        self.spark, self.words, self.inserted = spark, [0] * self.WORDS, 0

    def _bits(self) -> list:
        return [F.pmod(F.xxhash64(F.lit(i), *ID_COLS), F.lit(self.WORDS * 64)) for i in range(self.HASHES)]

    def insert(self, facts: DataFrame) -> DedupFilter:
        bits = facts.select(F.explode(F.array(*self._bits())).alias("bit"))
        rows = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).collect()  # bounded by the words
        for r in rows:
            self.words[r["w"]] |= r["m"] & (2**64 - 1)
        self.inserted += facts.count()
        return self

    def probably_contains(self, facts: DataFrame) -> DataFrame:
        """`facts` with `maybe`, false where a fact is surely new."""
        held = self.spark.createDataFrame([([w - 2**64 if w >= 2**63 else w for w in self.words],)], "words array<long>")
        ok = F.lit(True)
        for bit in self._bits():
            ok = ok & (F.getbit(F.get("words", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1)
        return facts.crossJoin(F.broadcast(held)).select(*facts.columns, ok.alias("maybe"))  # one row of 64 KB

    def count(self) -> int:
        return self.inserted

    def clear(self) -> None:
        self.words, self.inserted = [0] * self.WORDS, 0


def cold_start(spark: SparkSession, root: str, node: bytes = bytes(16)) -> tuple[Database, str]:
    """Opens a store and tells from what: checkpoint+batches, checkpoint, batches or genesis."""
    db = Database(spark, root, node)
    m = db.manifest
    level = {(True, True): "checkpoint+batches", (True, False): "checkpoint", (False, True): "batches", (False, False): "genesis"}[bool(m.checkpoint), bool(m.batches)]
    return db, level


class Peer:
    """Another store, reached in process; filters run at its scan."""

    def __init__(self, db: Database):
        self.db = db

    def fetch(self, accepts: FactFilter | None = None) -> DataFrame:
        return (accepts or All()).apply(self.db.datoms())

    def schema(self) -> DataFrame:
        return self.db.schema()

    def frontier(self) -> DataFrame:
        return self.db.frontier()

    def ping(self) -> bool:
        return True


def pull(db: Database, peer: Peer, accepts: FactFilter | None = None) -> DataFrame:
    """The facts of both, without writing them."""
    return merge(db.datoms(), peer.fetch(accepts))
