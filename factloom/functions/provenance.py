"""Provenance levels of transactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level, rank, confidence. Fixed values.
LEVELS = [("hypothesized", 0, 0.2), ("inferred", 1, 0.5), ("derived", 2, 0.8), ("observed", 3, 1.0)]
DEFAULT = "observed"


def keyword(level: str) -> str:
    return f"provenance/{level}"


def from_keyword(text: str) -> str | None:
    name = text.removeprefix("provenance/")
    return name if name in [x[0] for x in LEVELS] else None


def _lookup(column: Column, at: int) -> Column:
    name = F.regexp_replace(column, "^provenance/", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for level in LEVELS for x in (level[0], level[at])]), F.coalesce(name, F.lit(DEFAULT)))


def rank(column: Column) -> Column:
    """Rank of a level's keyword; null counts as observed, unknown text gives null."""
    return _lookup(column, 1)


def confidence(column: Column) -> Column:
    return _lookup(column, 2)
