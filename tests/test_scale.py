"""What is dealt and what one task gets, told from plans and from small blocks."""

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import graph, indexes, scans
from factloom.operators.live import live_set
from factloom.plans import datalog
from factloom.types import LONG, REF, STRING, ValidationError
from tests.helpers import SF, eid, fact, frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_presorted_facts_lie_in_several_partitions(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries.scans, "from_sorted", lambda d: given.append(d) or d.withColumn("pos", F.lit(0)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries.from_sorted(spark, SF)
        assert given[0].rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_presorted_facts_are_checked_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "ORDER_BLOCK", 4)
    rows = [fact("e", "a", i, 1) for i in range(21)]
    parts = frame(spark, rows).repartitionByRange(3, "v_long").sortWithinPartitions("v_long")
    assert [(r.v_long, r.pos) for r in scans.from_sorted(parts).orderBy("pos").collect()] == [(i, i) for i in range(21)]
    for at in (2, 3, 4, 7, 20):  # inside a block, at its end, at the next one's start
        for bad in ([*rows[: at - 1], rows[at], rows[at - 1], *rows[at + 1 :]], [*rows[:at], rows[at - 1], *rows[at:]]):
            with pytest.raises(ValidationError):
                scans.from_sorted(frame(spark, bad).coalesce(1))


def test_words_are_dealt_for_entities_with_several_texts_only(spark):
    one, more = fact("a", "t", "to be, or not to BE", 1, tag=STRING), fact("b", "t", "be here", 1, tag=STRING)
    index = indexes.text_index(frame(spark, [one, more]), "t")
    assert "Exchange" not in plan(index)
    assert sorted(r.term for r in index.collect()) == ["be", "be", "here", "not", "or", "to"]
    again = [fact("a", "t", "be or be gone", 2, tag=STRING), fact("a", "t", "gone", 3, tag=STRING)]
    got = [(r.e and bytes(r.e), r.term) for r in indexes.text_index(frame(spark, [one, more, *again, (None, *more[1:]), (None, *more[1:])]), "t").collect()]
    assert len(got) == len(set(got)) == 9


def closure(edges, starts):
    out, new = set(), {(s, d) for s in starts for x, d in edges if x == s}
    while new:
        out |= new
        new = {(s, d) for s, n in new for x, d in edges if x == n} - out
    return out


@pytest.mark.parametrize("shape", ["layers", "hubs", "cycle", "layers into a cycle", "none"])
def test_what_is_reached_is_the_closure(spark, shape):
    layers = [(i, 100 + i % 12) for i in range(60)] + [(i, 100 + i % 5) for i in range(0, 60, 7)] + [(100 + i, 200 + i % 3) for i in range(12)] + [(200, 300), (201, 300)]
    edges = {
        "layers": [*layers, *layers[:5]],
        "hubs": [(i, 100 + j) for i in range(10) for j in range(3)] + [(100 + j, i) for i in range(10) for j in range(3)],
        "cycle": [(i, (i + 1) % 7) for i in range(7)] + [(3, 3)],
        "layers into a cycle": [*layers, (300, 200), (202, 202), (300, 5)],
        "none": [],
    }[shape]
    graph_ = spark.createDataFrame(edges, "src long, dst long")
    for starts in ([*range(60), 0, 999], [5], []):
        got = [tuple(r) for r in graph.reachable(graph_, spark.createDataFrame([(s,) for s in starts], "id long")).collect()]
        assert len(got) == len(set(got)) and set(got) == closure(edges, starts)
    got = [tuple(r) for r in graph.reachable(graph_).collect()]
    assert len(got) == len(set(got)) and set(got) == closure(edges, {s for s, _ in edges})


def test_starts_that_share_a_first_step_share_what_it_reaches(spark, monkeypatch):
    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    chain = [(i, 1000) for i in range(500)] + [(1000 + i, 1001 + i) for i in range(5)]
    got = graph.reachable(spark.createDataFrame(chain, "src long, dst long"), spark.range(500))
    assert got.count() == 3000
    assert sum(t.count() for t in written) < 1200  # rounds wrote 3500 and more


def test_closure_rules_answer_as_rounds_do(spark, monkeypatch):
    pairs = [(1, 2), (2, 3), (3, 1), (4, 2), (5, 6), (6, 6), (7, 5)]
    rows = live_set(frame(spark, [fact(f"n{a}", "to", eid(f"n{b}"), 1, tag=REF) for a, b in pairs] + [fact(f"n{a}", "tag", a % 2, 1) for a in (1, 4, 5, 7)]))
    rules = ("[(up ?x ?y) [?x to ?y]]", "[(up ?x ?z) (up ?x ?y) (up ?y ?z)]")
    asked = ["[:find ?o ?x :where [?o tag ?s] (up ?o ?x)]", "[:find ?o ?s ?x :where [?o tag ?s] (up ?o ?x)]", "[:find ?s (count ?x) :where [?o tag ?s] (up ?o ?x)]", "[:find ?x :where [?o tag 1] (up ?o ?x) (up ?x ?x)]"]

    def answers():
        got = [[tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in datalog.query(rows, q, {"to": REF, "tag": LONG}, rules=rules).collect()] for q in asked]
        assert all(len(x) == len(set(x)) for x in got)
        return [set(x) for x in got]

    assert datalog.closures([datalog.parse_rule(r) for r in rules]) == {"up"}
    fast = answers()
    monkeypatch.setattr(datalog, "closures", lambda _: set())
    assert fast == answers() and all(fast)
