"""Fact filters as a small algebra that compiles to column predicates."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import TX_COLS, V_COLS

#: Ids up to which a membership test is written into the predicate; more are joined.
INLINE_IDS = 1000


class FactFilter:
    """A predicate on single facts. Monotone filters only pass more as facts are added."""

    monotone = True

    def column(self) -> Column:
        raise NotImplementedError

    def apply(self, datoms: DataFrame) -> DataFrame:
        return datoms.where(self.column())

    def text(self) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.text()


@dataclass(frozen=True)
class All(FactFilter):
    def column(self) -> Column:
        return F.lit(True)

    def text(self) -> str:
        return "All"


@dataclass(frozen=True)
class AttributeNamespace(FactFilter):
    """Attributes that start with one of the prefixes; no prefix passes nothing."""

    prefixes: tuple[str, ...]

    def column(self) -> Column:
        return reduce(operator.or_, [F.col("a").startswith(p) for p in self.prefixes], F.lit(False)) if self.prefixes else F.lit(False)

    def text(self) -> str:
        return "AttributeNamespace([" + ", ".join(f'"{p}"' for p in self.prefixes) + "])"


@dataclass(frozen=True)
class FromNodes(FactFilter):
    nodes: tuple[bytes, ...]

    def column(self) -> Column:
        return F.col("tx_node").isin([F.lit(n) for n in self.nodes]) if self.nodes else F.lit(False)

    def text(self) -> str:
        return "FromNodes([" + ", ".join(n.hex() for n in self.nodes) + "])"


@dataclass(frozen=True)
class Entities(FactFilter):
    ids: tuple[bytes, ...]

    def column(self) -> Column:
        return F.col("e").isin([F.lit(i) for i in self.ids]) if self.ids else F.lit(False)

    def apply(self, datoms: DataFrame) -> DataFrame:
        if len(self.ids) <= INLINE_IDS:
            return datoms.where(self.column())
        wanted = datoms.sparkSession.createDataFrame([(i,) for i in set(self.ids)], "e binary")
        return datoms.join(wanted, "e", "left_semi")

    def text(self) -> str:
        return "Entities([" + ", ".join(i.hex() for i in self.ids) + "])"


@dataclass(frozen=True)
class And(FactFilter):
    """All of the parts; of none, true."""

    parts: tuple[FactFilter, ...]

    @property
    def monotone(self) -> bool:  # type: ignore[override]
        return all(p.monotone for p in self.parts)

    def column(self) -> Column:
        return reduce(operator.and_, [p.column() for p in self.parts]) if self.parts else F.lit(True)

    def text(self) -> str:
        return "And([" + ", ".join(map(str, self.parts)) + "])"


@dataclass(frozen=True)
class Or(FactFilter):
    """Any of the parts; of none, false."""

    parts: tuple[FactFilter, ...]

    @property
    def monotone(self) -> bool:  # type: ignore[override]
        return all(p.monotone for p in self.parts)

    def column(self) -> Column:
        return reduce(operator.or_, [p.column() for p in self.parts]) if self.parts else F.lit(False)

    def text(self) -> str:
        return "Or([" + ", ".join(map(str, self.parts)) + "])"


@dataclass(frozen=True)
class Not(FactFilter):
    part: FactFilter
    monotone = False

    def column(self) -> Column:
        return ~self.part.column()

    def text(self) -> str:
        return f"Not({self.part})"


@dataclass(frozen=True)
class AfterEpoch(FactFilter):
    epoch: int
    monotone = False

    def column(self) -> Column:
        return F.col("epoch") > self.epoch

    def text(self) -> str:
        return f"AfterEpoch({self.epoch})"


@dataclass(frozen=True)
class Custom(FactFilter):
    """A predicate of the caller's; counted as non-monotone unless said otherwise."""

    name: str
    build: Callable[[], Column] = field(compare=False)
    monotone: bool = False

    def column(self) -> Column:
        return self.build()

    def text(self) -> str:
        return f"Custom({self.name})"


def user_facts(datoms: DataFrame) -> DataFrame:
    """Without the facts about transactions themselves."""
    return datoms.where(~F.col("a").startswith("tx/"))


def replica_subset(datoms: DataFrame, accepts: FactFilter) -> DataFrame:
    """What a replica with this filter holds."""
    return accepts.apply(datoms)


@dataclass(frozen=True)
class TrustPolicy:
    """Which signers' facts count; by default all. Every condition that is given must hold.

    `only`: some signers. `max_error`: signers with that calibration error at most, from at least
    `min_count` verified predictions. `threshold` (n, signers): facts that n of the signers attest.
    `custom`: a predicate on the fact's columns.
    """

    only: tuple[bytes, ...] | None = None
    max_error: float | None = None
    min_count: int = 1
    threshold: tuple[int, tuple[bytes, ...]] | None = None
    custom: Callable[[], Column] | None = field(default=None, compare=False)


def calibration(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(signer, error, n) from predictions (signer, key, predicted) and outcomes (key, actual)."""
    both = predictions.join(outcomes, "key")
    return both.groupBy("signer").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("error"), F.count("*").alias("n"))


def _one_of(column: str, values: tuple[bytes, ...]) -> Column:
    return F.col(column).isin([F.lit(v) for v in values]) if values else F.lit(False)


def trust_filter(datoms: DataFrame, signers: DataFrame, policy: TrustPolicy, scores: DataFrame | None = None) -> DataFrame:
    """Facts that the policy trusts; `signers` has (tx columns, signer), `scores` what calibration gives.

    A signer attests a fact (entity, attribute, value, operation) with every transaction of its
    own that states it. The decision on a fact never depends on which others are asked for.
    """
    out = datoms
    if policy.only is not None or policy.max_error is not None:
        trusted = signers
        if policy.only is not None:
            trusted = trusted.where(_one_of("signer", policy.only))
        if policy.max_error is not None:
            good = scores.where((F.col("error") <= policy.max_error) & (F.col("n") >= policy.min_count))
            trusted = trusted.join(good, "signer", "left_semi")
        out = out.join(trusted.select(*TX_COLS).distinct(), TX_COLS, "left_semi")
    if policy.threshold is not None:
        n, of = policy.threshold
        content = F.struct("e", "a", *V_COLS, "op")
        said = datoms.join(signers.where(_one_of("signer", of)), TX_COLS).select(content.alias("_said"), "signer").distinct()
        enough = said.groupBy("_said").agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select("_said")
        out = out.join(enough, content.eqNullSafe(F.col("_said")), "left_semi") if n > 0 else out
    if policy.custom is not None:
        out = out.where(policy.custom())
    return out
