"""A store as a value: facts, schema, epoch and genesis node, with its constructors, merge and replay.

Nothing is stored; the facts are a DataFrame, and every operation gives a new store. The stores in
a folder (`sources/store.py`) are opened as one of these where only reading is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import DATOM_SCHEMA, ID_COLS, ORDERS
from . import schema as schemas
from .live import live_set
from .scans import from_sorted, point_get, scan
from .setops import merge


@dataclass(frozen=True)
class FactStore:
    facts: DataFrame
    schema: DataFrame
    epoch: int = 0
    node: bytes = bytes(16)

    # constructors

    @staticmethod
    def genesis(spark: SparkSession, node: bytes = bytes(16)) -> FactStore:
        """No facts, epoch 0, and the schema that every store starts with."""
        return FactStore(spark.createDataFrame([], DATOM_SCHEMA), schemas.genesis(spark), 0, node)

    @staticmethod
    def from_facts(facts: DataFrame) -> FactStore:
        """Distinct facts under an empty schema, at epoch 0."""
        return FactStore(facts.dropDuplicates(ID_COLS), facts.sparkSession.createDataFrame([], schemas.SCHEMA_TYPE))

    @staticmethod
    def from_sorted(facts: DataFrame, schema: DataFrame, epoch: int, node: bytes = bytes(16)) -> FactStore:
        """Facts that lie in strictly rising order already, which is checked; they aren't sorted again."""
        return FactStore(from_sorted(facts).drop("pos"), schema, epoch, node)

    @staticmethod
    def from_checkpoint(facts: DataFrame, schema: DataFrame, epoch: int, node: bytes = bytes(16)) -> FactStore:
        return FactStore(facts.dropDuplicates(ID_COLS), schema, epoch, node)

    # changes

    def insert(self, facts: DataFrame) -> FactStore:
        """With more facts; one that is there already changes nothing, and epoch and schema stay."""
        return replace(self, facts=merge(self.facts, facts))

    def replay(self, batches: Sequence[tuple[int, DataFrame]]) -> FactStore:
        """After commit batches (epoch, facts): their facts are in, the epoch is the last one's, and
        schema definitions take effect batch by batch."""
        facts, schema, epoch = [self.facts], self.schema, self.epoch
        for epoch, rows in batches:  # noqa: B007
            facts.append(rows)
            schema = schemas.evolve(rows, schema, check=True)
        return FactStore(merge(*facts), schema, epoch, self.node) if batches else self

    def merge(self, other: FactStore) -> tuple[FactStore, DataFrame]:
        """(the union, schema conflicts): the greater epoch, the lesser genesis node, schemas merged."""
        schema, conflicts = schemas.merge_schemas(self.schema, other.schema)
        return FactStore(merge(self.facts, other.facts), schema, max(self.epoch, other.epoch), min(self.node, other.node)), conflicts

    # reading: the interface of an ordered backend

    def get(self, **key: object | Column) -> DataFrame:
        return point_get(self.facts, **key)

    def values(self, order: str = "eavt") -> DataFrame:
        return scan(self.facts, order)

    def columns_of(self, order: str) -> list[str]:
        return ORDERS[order]

    def size(self) -> DataFrame:
        return self.facts.agg(F.count("*").alias("n"))

    def live(self) -> DataFrame:
        return live_set(self.facts)
