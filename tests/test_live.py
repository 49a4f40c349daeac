import random

from pyspark.sql import functions as F

from factloom.operators import live, setops
from factloom.operators.filters import All, And, AttributeNamespace, Entities, FromNodes, Not, Or
from factloom.types import ID_COLS, TxId, node_id
from tests.helpers import eid, fact, frame, live_model


def values(df):
    return {(bytes(r.e), r.a, r.v_long) for r in df.collect()}


def test_latest_transaction_wins_not_the_larger_value(spark):
    d = frame(spark, [fact("x", "t/n", 9, 1), fact("x", "t/n", 3, 2)])
    assert values(live.live_resolve(d)) == {(eid("x"), "t/n", 3)}
    assert len(values(live.live_set(d))) == 2


def test_retraction_reveals_the_value_before(spark):
    d = frame(spark, [fact("x", "t/n", 1, 1), fact("x", "t/n", 2, 2), fact("x", "t/n", 2, 3, op=1)])
    assert values(live.live_resolve(d)) == {(eid("x"), "t/n", 1)}
    assert values(live.retracted_set(d)) == {(eid("x"), "t/n", 2)}


def test_assertion_wins_in_one_transaction(spark):
    d = frame(spark, [fact("x", "t/n", 1, 1, op=1), fact("x", "t/n", 1, 1, op=0)])
    assert values(live.live_set(d)) == {(eid("x"), "t/n", 1)}


def test_equal_transactions_take_the_greatest_value(spark):
    d = frame(spark, [fact("x", "t/n", 1, 1), fact("x", "t/n", 2, 1)])
    assert values(live.live_resolve(d)) == {(eid("x"), "t/n", 2)}


def _random(seed, n, big):
    r = random.Random(seed)
    top = 2**62 if big else 5
    return [fact(r.choice("abc"), r.choice(["t/x", "t/y"]), r.randrange(3), r.randrange(top), r.randrange(2**32 - 1 if big else 3), r.randrange(3), r.randrange(2)) for _ in range(n)]


def test_live_is_the_model_for_narrow_and_wide_keys(spark):
    for seed in range(3):
        for big in (False, True):
            rows = _random(seed, 80, big)
            d = frame(spark, rows)
            order = live.TxOrder.of(d)
            assert order.wide == big
            got = {(bytes(r.e), r.a, r.v_long): (r.tx_phys, r.tx_log, bytes(r.tx_node)) for r in live.live_set(d).collect()}
            assert got == {(k[0], k[1], k[2][2]): w[:3] for k, w in live_model(rows).items()}


def test_merge_laws(spark):
    a, b, c = (frame(spark, _random(s, 30, False)) for s in (1, 2, 3))

    def ids(df):
        return sorted(tuple(r) for r in df.select(*[F.hex(x) if x in ("e", "v_bin", "tx_node") else F.col(x).cast("string") for x in ID_COLS]).na.fill("-").collect())

    assert ids(setops.merge(a, b)) == ids(setops.merge(b, a))
    assert ids(setops.merge(setops.merge(a, b), c)) == ids(setops.merge(a, setops.merge(b, c)))
    assert ids(setops.merge(a, a)) == ids(setops.merge(a))
    assert setops.set_equal(a, setops.merge(a, a)).first().equal
    assert values(live.live_set(setops.merge(a, b))) == {(k[0], k[1], k[2][2]) for k in live_model(_random(1, 30, False) + _random(2, 30, False))}


def test_empty_store(spark):
    d = frame(spark, [])
    assert live.live_set(d).count() == live.live_resolve(d).count() == setops.merge(d, d).count() == 0


def test_as_of_and_ranges(spark):
    d = frame(spark, [fact("x", "t/n", i, i, log=i % 2, node=i % 3) for i in range(6)])
    assert values(live.as_of(d, TxId(3, 1, node_id(0)))) == {(eid("x"), "t/n", i) for i in range(4)}
    assert values(live.tx_range(d, TxId(2, 0, node_id(2)), TxId(3, 0, node_id(2)))) == {(eid("x"), "t/n", 2)}


def test_filters(spark):
    d = frame(spark, [fact("x", "user/name", 1, 1, node=1), fact("y", "db/ident", 2, 1, node=2)])
    for f, n in ((All(), 2), (AttributeNamespace(()), 0), (AttributeNamespace(("us", "zz")), 1), (FromNodes(()), 0), (Entities((eid("y"),)), 1), (And(()), 2), (Or(()), 0), (Not(All()), 0), (Entities(tuple(eid(str(i)) for i in range(1200)) + (eid("x"),)), 1)):
        assert f.apply(d).count() == n
    assert str(And((All(), Or(())))) == "And([All, Or([])])"
    assert not And((All(), Not(All()))).monotone and Or((All(),)).monotone


def test_live_aggregates_by_hash(spark):
    d = frame(spark, [fact("x", "t/n", 1, 1)])
    plan = live.live_set(d)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
