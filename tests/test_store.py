import pytest
from pyspark.sql import functions as F

from factloom.functions.codec import canonical_bytes
from factloom.operators import antientropy, chunks, graph, scans, schema, txn
from factloom.operators.filters import AttributeNamespace
from factloom.operators.live import live_resolve, live_set
from factloom.plans import datalog, federation
from factloom.sources.store import Database, DedupFilter, Peer, cold_start, pull
from factloom.sources.wire import decode_facts, into_trusted, rejected
from factloom.streaming.views import Observer, commit_stream, observe
from factloom.types import DOUBLE, KEYWORD, LONG, REF, STRING, ChunkError, EmptyTransaction, FactError, PeerUnreachable, QueryError, SchemaViolation, UnknownAttribute, ValidationError, node_id
from tests.helpers import eid, fact, frame


def define(db, name, kind):
    t = txn.Transaction(db.node)
    e = eid(f"def/{name}")
    t.assert_fact(e, "db/ident", KEYWORD, name).assert_fact(e, "db/valueType", KEYWORD, f"db.type/{kind}").assert_fact(e, "db/cardinality", KEYWORD, "db.cardinality/one")
    return db.transact(t)


def test_commit_read_recover(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    db, level = cold_start(spark, root, node_id(1))
    assert level == "genesis" and db.epoch == 0 and db.datoms().count() == 0 and db.schema().count() == 25
    assert define(db, "user/name", "string").epoch == 1
    seen = []
    Observer(lambda epoch, df: seen.append((epoch, df.where("a = 'user/name'").count()))).register(db)
    r = db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "user/name", STRING, "ann"), secret=bytes(32))
    assert r.epoch == 2 and r.facts.where("a = 'tx/signature'").count() == 1 and r.facts.where("a = 'tx/predecessor'").count() == 1
    with pytest.raises(UnknownAttribute):
        db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "user/age", LONG, 3))
    with pytest.raises(SchemaViolation):
        db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "user/name", LONG, 3))
    with pytest.raises(EmptyTransaction):
        db.transact(txn.Transaction(db.node))
    assert db.epoch == 2
    got = db.batch_transact([txn.Transaction(db.node).retract_fact(eid("u"), "user/name", STRING, "ann"), txn.Transaction(db.node).assert_fact(eid("u"), "user/name", STRING, "bob")])
    assert [x.epoch for x in got] == [3, 4] and seen == [(1, 0), (2, 1), (3, 1), (4, 1)]
    # a batch whose manifest was never written stays unseen
    db.datoms().limit(1).write.parquet(f"{root}/batches/epoch-torn")
    again, level = cold_start(spark, root, node_id(1))
    assert level == "batches" and again.epoch == 4 and again.datoms().count() == db.datoms().count()
    names = [r.v_str for r in live_resolve(again.datoms()).where("a = 'user/name'").collect()]
    assert names == ["bob"]
    assert live_resolve(again.snapshot(2)).where("a = 'user/name'").first().v_str == "ann"
    n = again.datoms().count()
    again.checkpoint()
    again.verify_checkpoint()
    third, level = cold_start(spark, root, node_id(1))
    assert level == "checkpoint" and third.datoms().count() == n and third.epoch == 4
    assert third.live_first().where("a = 'user/name'").count() == 1
    define(third, "user/age", "long")
    assert cold_start(spark, root)[1] == "checkpoint+batches"
    # damaged newest manifest: the one before holds
    names = sorted(p.name for p in (tmp_path / "s/_commits").iterdir() if p.name.endswith("5.json"))
    (tmp_path / "s/_commits" / names[-1]).write_text("{")
    assert cold_start(spark, root)[0].epoch == 4
    other = Database(spark, f"file://{tmp_path}/t", node_id(2))
    assert pull(other, Peer(third), AttributeNamespace(("user/name",))).count() == 3


def test_schema_rules(spark):
    def d(e, ident, kind, phys, card="db.cardinality/one"):
        return [fact(e, a, v, phys, tag=KEYWORD) for a, v in (("db/ident", ident), ("db/valueType", kind), ("db/cardinality", card))]

    one = schema.evolve(frame(spark, d("a", "u/n", "db.type/string", 1)))
    two = schema.evolve(frame(spark, d("a", "u/n", "db.type/long", 1) + d("b", "u/m", "db.type/ref", 1)))
    merged, conflicts = schema.merge_schemas(one, two)
    assert {(r.attr, r.value_type) for r in merged.collect()} == {("u/n", STRING), ("u/m", REF)}
    assert [tuple(r) for r in conflicts.collect()] == [("u/n", "string one lww", "long one lww")]
    with pytest.raises(Exception, match="differently"):
        schema.merge_schemas(one, two, strict=True)
    assert schema.evolve(frame(spark, d("a", "u/n", "db.type/string", 1) + d("a2", "u/n", "db.type/long", 2))).first().value_type == LONG
    with pytest.raises(SchemaViolation):
        schema.evolve(frame(spark, d("a", "u/n", "db.type/what", 1)), check=True)


TYPES = {"k": REF, "n": LONG}


def people(spark):
    names = ["a", "b", "c", "d"]
    rows = [fact(x, "k", eid(y), 1, tag=REF) for x, y in (("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"))]
    return frame(spark, rows + [fact(x, "n", i, 1) for i, x in enumerate(names)] + [fact("a", "k", eid("d"), 2, tag=REF, op=1)])


def ask(spark, text, **how):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in datalog.query(live_set(people(spark)), text, TYPES, **how).collect())


def test_datalog_rewrites_keep_answers(spark):
    base = ask(spark, "[:find ?x ?n :where [?x k ?y] [?y n ?n] [(> ?n 0)]]")
    assert base == sorted([(eid("a"), 1), (eid("b"), 2)])
    for other in ("[:find ?p ?m :where [?p k ?q] [?q n ?m] [(> ?m 0)]]", "[:find ?x ?n :where [(> ?n 0)] [?y n ?n] [?x k ?y]]", "[:find ?x ?n :where [?x k ?y] [?x k ?y] [?y n ?n] [(> ?n 0)]]"):
        assert ask(spark, other) == base
    assert ask(spark, "[:find ?x :where [?x n ?v] (not [?x k _])]") == [(eid("d"),)]
    assert ask(spark, "[:find (sum ?v) :where [?x n ?v]]") == [(6,)]
    up = ("[(up ?x ?y) [?x k ?y]]", "[(up ?x ?z) [?x k ?y] (up ?y ?z)]")
    assert len(ask(spark, "[:find ?x ?y :where [?x n ?v] (up ?x ?y)]", rules=up)) == 9  # a cycle of three
    for bad in ("[:find ?x", "[:find ?z :where [?x n ?v]]", "[:find ?x :where [?x n ?v] [(> ?q 1)]]", "[:find ?x :where [?x n ?v] [?y n ?w]]"):
        with pytest.raises(QueryError):
            ask(spark, bad)


def test_monotone_queries_fan_out(spark):
    assert datalog.is_monotone(datalog.parse("[:find ?x :where [?x n ?v] [(> ?v 1)]]"))
    for q in ("[:find (count ?x) :where [?x n ?v]]", "[:find ?x :where [?x n ?v] (not [?x k _])]", "[:find ?x :where [?x n ?v] :limit 1]"):
        assert not datalog.is_monotone(datalog.parse(q))
    a, b = frame(spark, [fact("a", "n", 1, 1)]), frame(spark, [fact("b", "n", 2, 1)])

    def gone():
        raise PeerUnreachable("x")

    q = "[:find ?x ?v :where [?x n ?v]]"
    assert federation.federated([a, b], q, TYPES).count() == federation.materialise([a, b], q, TYPES).count() == 2
    assert federation.federated([a, gone], q, TYPES).count() == 1
    with pytest.raises(PeerUnreachable):
        federation.federated([a, gone], "[:find (count ?x) :where [?x n ?v]]", TYPES)


def test_graph_cycles_end(spark):
    g = graph.edges(people(spark))
    assert g.count() == 3
    start = spark.createDataFrame([(eid("a"),)], "id binary")
    assert graph.reachable(g, start).count() == 3
    assert {r.hops for r in graph.k_hop(g, start, 2).collect()} == {1, 2}
    assert graph.reachable(g, start.limit(0)).count() == 0


def test_trees_forget_their_history(spark):
    rows = [(f"k{i:03d}".encode(), str(i % 7).encode()) for i in range(900)]
    one = chunks.build_tree(spark.createDataFrame(rows, "key binary, value binary"), 4)
    two = chunks.build_tree(spark.createDataFrame(rows[::-1], "key binary, value binary").repartition(7), 4)
    assert one.root == two.root and chunks.diff_trees(one, two).count() == 0
    assert one.chunks.select(F.max("level")).first()[0] >= 1
    three = chunks.build_tree(spark.createDataFrame(rows[1:] + [(b"zz", b"1")], "key binary, value binary"), 4)
    assert {(bytes(r.key), r.kind) for r in chunks.diff_trees(one, three).collect()} == {(b"k000", "left_only"), (b"zz", "right_only")}
    proof = chunks.inclusion_proof(one, b"k123")
    assert chunks.check_proof(proof, one.root, b"k123", b"4") and not chunks.check_proof(proof, one.root, b"k123", b"5")
    assert chunks.inclusion_proof(one, b"nope") == []
    assert chunks.build_tree(spark.createDataFrame([], "key binary, value binary")).root is None
    assert chunks.parse_manifest(chunks.manifest({"live": one.root}))["live"] == one.root


def test_chunks_have_bounds_and_partitions_change_nothing(spark, monkeypatch):
    rows = [(f"k{i:05d}".encode(), str(i % 7).encode()) for i in range(6000)]
    pairs = spark.createDataFrame(rows, "key binary, value binary")
    one = chunks.build_tree(pairs, 5)
    sizes = [r.n for r in one.chunks.where("level = 0").orderBy("first").select(F.size("entries").alias("n")).collect()]
    assert sum(sizes) == 6000 and all(chunks.MIN_ENTRIES <= n <= chunks.MAX_ENTRIES for n in sizes[:-1]) and len(sizes) > 20
    monkeypatch.setattr(chunks, "PART_ENTRIES", 700)
    assert chunks.build_tree(pairs, 5).root == one.root
    wide = chunks.build_tree(pairs, 40)  # no key ends a chunk: all have the most entries
    assert [r.n for r in wide.chunks.where("level = 0").orderBy("first").select(F.size("entries").alias("n")).collect()] == [1024] * 5 + [880]


def test_descent_opens_only_what_differs_and_heights_may_differ(spark):
    rows = [(f"k{i:05d}".encode(), b"x") for i in range(9000)]
    big = chunks.build_tree(spark.createDataFrame(rows, "key binary, value binary"), 4)
    changed = chunks.build_tree(spark.createDataFrame([*rows[:4000], (rows[4000][0], b"y"), *rows[4001:]], "key binary, value binary"), 4)
    small = chunks.build_tree(spark.createDataFrame(rows[:50], "key binary, value binary"), 4)
    assert [(bytes(r.key), r.kind) for r in chunks.diff_trees(big, changed).collect()] == [(rows[4000][0], "modified")]
    assert big.height > small.height
    assert chunks.diff_trees(big, small).where("kind = 'left_only'").count() == chunks.diff_trees(small, big).where("kind = 'right_only'").count() == 8950
    empty = chunks.build_tree(spark.createDataFrame([], "key binary, value binary"))
    assert chunks.diff_trees(small, empty).count() == 50 and chunks.diff_trees(empty, empty).count() == 0
    # without the chunks that both share the difference is found all the same
    shared = big.chunks.join(changed.chunks.select("addr"), "addr", "left_semi").where("level = 0").select("addr")
    cut = [chunks.Tree(t.root, t.chunks.join(shared, "addr", "left_anti"), t.height) for t in (big, changed)]
    assert chunks.diff_trees(*cut).count() == 1


def test_chunk_codec():
    rows = [(b"b", b"1"), (b"a", b""), (b"", b"2")]
    data = chunks.PairCodec.encode(rows)
    assert chunks.PairCodec.decode(data) == sorted(rows) and chunks.PairCodec.boundary_key(data) == b"" and data[:5] == b"\x01\x03\0\0\0"
    inner = chunks.encode_chunk(2, [(b"a", bytes(32)), (b"b", bytes(32))])
    assert chunks.decode_chunk(inner) == (2, [(b"a", bytes(32)), (b"b", bytes(32))])
    for bad in (b"", b"\x03", data[:-1], data + b"x", chunks.encode_chunk(0, [(b"b", b""), (b"a", b"")])):
        with pytest.raises(ChunkError):
            chunks.decode_chunk(bad)
    with pytest.raises(ChunkError):
        chunks.PairCodec.encode([(b"a", b"1"), (b"a", b"2")])
    with pytest.raises(ChunkError):
        chunks.PairCodec.decode(inner)
    assert chunks.entries_fingerprint(rows) == chunks.entries_fingerprint(rows[::-1]) != chunks.entries_fingerprint(rows[:2])


def test_presorted_facts_are_checked(spark):
    d = scans.scan(frame(spark, [fact(f"x{i}", "n", i, 1) for i in range(30)])).coalesce(1)
    assert [r.pos for r in scans.from_sorted(d).orderBy("pos").collect()] == list(range(30))
    for bad in (d.unionByName(d), frame(spark, [fact("b", "n", 1, 1), fact("a", "n", 1, 1), fact("b", "n", 1, 1)]).coalesce(1)):
        with pytest.raises(ValidationError):
            scans.from_sorted(bad)


def test_wire_and_filter_of_duplicates(spark):
    good = frame(spark, [fact("a", "n", 1, 1), fact("b", "n", 2.0, 1, tag=DOUBLE)])
    assert into_trusted(good).count() == 2 and rejected(good).count() == 0
    bad = good.withColumn("v_dbl", F.lit(float("nan")))
    assert rejected(bad).count() == 2
    with pytest.raises(Exception, match="no fact"):
        into_trusted(bad).collect()
    back = decode_facts(good.select(canonical_bytes().alias("data")))
    assert sorted(map(str, back.drop("epoch").collect())) == sorted(map(str, good.drop("epoch").collect()))
    with pytest.raises(Exception, match="trailing|early"):
        decode_facts(spark.createDataFrame([(b"123",)], "data binary")).collect()
    seen = DedupFilter(spark).insert(good)
    other = frame(spark, [fact(f"o{i}", "n", i, 1) for i in range(200)])
    assert seen.count() == 2 and seen.probably_contains(good).where("maybe").count() == 2 and seen.probably_contains(other).where("maybe").count() <= 2
    seen.clear()
    assert seen.probably_contains(good).where("maybe").count() == 0


def test_an_exchange_makes_stores_equal_and_late_observers_catch_up(spark, tmp_path):
    a, b = frame(spark, [fact("a", "n", i, 1) for i in range(9)]), frame(spark, [fact("a", "n", i, 1) for i in range(4, 12)])
    for x in antientropy.reconcile(a, b):
        assert x.count() == 12
    assert antientropy.diff(a, antientropy.summary(a)).count() == 0 and antientropy.NoExchange.diff(a).count() == 0
    db = Database(spark, f"file://{tmp_path}/s", node_id(1))
    define(db, "user/n", "long")
    got, late = [], Observer(lambda epoch, df: got.append((epoch, df.where("a = 'user/n'").count())))
    late.register(db)
    db.observers.remove(late)  # misses two commits
    for i in range(2):
        db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "user/n", LONG, i))
    db.observers.append(late)
    db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "user/n", LONG, 7))
    assert got == [(1, 0), (2, 1), (3, 1), (4, 1)]
    late.observe(4)
    with pytest.raises(FactError):
        late.observe(3)
    assert db.transact(txn.Transaction(db.node).assert_fact(eid("u"), "no/such", LONG, 7), checked=False).epoch == 5


def test_filtered_observers_get_empty_batches(spark, tmp_path):
    frame(spark, [fact("a", "x/n", 1, 1)]).write.parquet(f"file://{tmp_path}/in")
    got = []
    observe(commit_stream(spark, f"file://{tmp_path}/in"), lambda i, df: got.append(df.count()), f"file://{tmp_path}/cp", AttributeNamespace(("y/",))).awaitTermination()
    assert got == [0]
