"""Queries over several stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.live import live_set
from ..operators.setops import merge, shard, shard_of
from ..types import PeerUnreachable
from .datalog import Query, Rule, bound_entities, is_monotone, parse, query


def fan_out(stores: Sequence[DataFrame], q: Query | str, types: dict[str, int], **how) -> DataFrame:
    """Every store answers for itself; the answers' union."""
    out = None
    for s in stores:
        rows = query(live_set(s), q, types, **how)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def materialise(stores: Sequence[DataFrame], q: Query | str, types: dict[str, int], **how) -> DataFrame:
    """The stores' facts merge first."""
    return query(live_set(merge(*stores)), q, types, **how)


def federated(stores: Sequence[DataFrame | Callable[[], DataFrame]], q: Query | str, types: dict[str, int], rules: Sequence[Rule | str] = (), single_pattern_only: bool = True, **how) -> DataFrame:
    """Fans out what may be; merges first otherwise.

    Fanning out is right only for monotone queries, and only if each answer's facts lie in one
    store: that holds for one pattern, or where the caller says so (`single_pattern_only=False`).
    An unreachable store is left out of a fan-out, whose answer is then a valid subset; anything
    else fails.
    """
    q = parse(q) if isinstance(q, str) else q
    monotone = is_monotone(q, [r for r in rules if isinstance(r, Rule)])
    apart = monotone and (len(q.where) == 1 or not single_pattern_only)
    there = []
    for s in stores:
        try:
            there.append(s() if callable(s) else s)
        except PeerUnreachable:
            if not apart:
                raise
    if not there:
        raise PeerUnreachable("no store answers")
    return (fan_out if apart else materialise)(there, q, types, rules=rules, **how)


def sharded(datoms: DataFrame, n: int, q: Query | str, types: dict[str, int], **how) -> DataFrame:
    """A query whose patterns all name their entity reads those entities' shards only."""
    q = parse(q) if isinstance(q, str) else q
    wanted = bound_entities(q)
    rows = shard(datoms, n)
    if wanted and len(wanted) == len(q.where):
        rows = rows.where(shard_of(n).isin([int.from_bytes(e[:8], "little") % n for e in wanted]))
    return query(live_set(rows.drop("shard")), q, types, **how)
