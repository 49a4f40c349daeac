"""Named queries over the driver's tables, and the SQL each is checked against.

The SQL is written from the meaning of each query on the relational tables; it shares no code
with the Spark side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import provenance as prov
from .functions.clock import frontier, merge_frontiers
from .functions.codec import canonical_bytes, content_hash, crc32_of, entity_id, hex_of
from .operators import antientropy, chunks, filters, fingerprint, graph, indexes, live, scans, schema, setops, txn
from .operators.state import FactStore
from .plans import datalog, federation
from .scratch import materialize, scratch_dir
from .sources.mapping import canonical, event_facts, facts, node_of, reference_facts, replicas, scalar_facts, table
from .sources.store import Database, Peer, cold_start, create, pull
from .sources.wire import decode_facts, into_trusted, rejected
from .streaming.views import Observer, apply_delta, commit_stream, delta_since, keep_live, kept_live, live_stream, windowed_counts
from .types import ASSERT, DOUBLE, EAVT, INSTANT, KEYWORD, LONG, REF, STRING, TX_COLS, TxId, node_id

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# The event facts in SQL: entity, attribute, value, time, counter, node, operation, epoch.
D = """d AS (SELECT sha256('user/' || user_id) AS e, 'event/' || event_type AS a, floor(value)::BIGINT AS v, epoch_us(ts) // 1000 AS p,
  event_id AS l, event_id % 4 AS n, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS op, event_id // 1000 AS epoch FROM events)"""
# LIVE values: the latest event of each value is an assertion.
LIVE = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY e, a, v ORDER BY p DESC, l DESC, n DESC, op) AS k FROM d) WHERE k = 1 AND op = 0)"""
ROW = "e, a, v, p AS tx_phys, l AS tx_log, n AS node, op::BIGINT AS op"
# The reference edges in SQL.
G = """g AS (SELECT sha256('order/' || o_orderkey) AS src, 'order/customer' AS attr, sha256('customer/' || o_custkey) AS dst FROM orders
  UNION SELECT sha256('customer/' || c_custkey), 'customer/nation', sha256('nation/' || c_nationkey) FROM customer
  UNION SELECT sha256('supplier/' || s_suppkey), 'supplier/nation', sha256('nation/' || s_nationkey) FROM supplier
  UNION SELECT sha256('nation/' || n_nationkey), 'nation/region', sha256('region/' || n_regionkey) FROM nation)"""


def _le(x: str, width: int) -> str:
    h = f"lpad(lower(to_hex({x})), 16, '0')"
    return "(" + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(width)) + ")"


HASHED = f"""h AS (SELECT *, sha256(unhex(e || {_le('length(a)::BIGINT', 2)} || hex(a) || '03' || {_le('v', 8)} || {_le('p', 8)} || {_le('l', 4)}
  || lpad(to_hex(n), 32, '0') || '0' || op)) AS hash FROM d)"""


def _fp(rows: str, column: str, group: str = "") -> str:
    """SQL of the XOR of digests, by `group` columns if given."""
    parts = " || ".join(f"lpad(lower(to_hex(bit_xor(('0x' || substr({column}, {a}, {n}))::BIGINT))), {n}, '0')" for a, n in fingerprint.SLICES)
    return f"SELECT {group + ', ' if group else ''}{parts} AS fingerprint FROM {rows}{' GROUP BY ' + group if group else ''}"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def portable(rows: DataFrame, *more: str) -> DataFrame:
    """Event facts as plain columns."""
    cols = {"e": hex_of(F.col("e")), "a": F.col("a"), "v": F.col("v_long"), "tx_phys": F.col("tx_phys"), "tx_log": F.col("tx_log"), "node": F.conv(F.hex("tx_node"), 16, 10).cast("bigint"), "op": F.col("op").cast("bigint")}
    return rows.select(*[c.alias(n) for n, c in cols.items() if n not in rows.columns or n != "op" or "op" in rows.columns], *more)


def _live_row(rows: DataFrame) -> DataFrame:
    return portable(rows.withColumn("op", F.lit(0))).drop("op")


LIVE_ROW = "e, a, v, p AS tx_phys, l AS tx_log, n AS node"


# scans and positions


def _scan(order: str):
    def run(spark, sf):
        return portable(scans.scan(event_facts(spark, sf), order))

    return run


for _order in ("eavt", "aevt", "vaet", "avet"):
    register(f"scan_{_order}", f"WITH {D} SELECT {ROW} FROM d")(_scan(_order))


@register("point_get", f"WITH {D} SELECT {ROW} FROM d WHERE e = sha256('user/1') AND a = 'event/click'")
def point_get(spark, sf):
    return portable(scans.point_get(event_facts(spark, sf), e=entity_id(F.lit("user/1")), a="event/click"))


@register("contains", f"WITH {D} SELECT {ROW} FROM d WHERE l % 3 = 2")
def contains(spark, sf):
    a, b = replicas(spark, sf)
    return portable(scans.contains(a, b))


@register("entity_exists", f"WITH {D} SELECT sha256('user/' || c_custkey) AS e, sha256('user/' || c_custkey) IN (SELECT e FROM d) AS present FROM customer")
def entity_exists(spark, sf):
    asked = table(spark, sf, "customer").select(entity_id(F.concat(F.lit("user/"), F.col("c_custkey").cast("string"))).alias("e"))
    return scans.entity_exists(event_facts(spark, sf), asked).select(hex_of(F.col("e")).alias("e"), "present")


@register("unique_entities", f"WITH {D} SELECT DISTINCT e FROM d")
def unique_entities(spark, sf):
    return scans.unique_entities(event_facts(spark, sf)).select(hex_of(F.col("e")).alias("e"))


@register("store_size", f"WITH {D} SELECT count(*)::BIGINT AS n, count(*) = 0 AS is_empty FROM d")
def store_size(spark, sf):
    return event_facts(spark, sf).agg(F.count("*").alias("n")).withColumn("is_empty", F.col("n") == 0)


@register("positions", f"WITH {D} SELECT {ROW}, row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1 AS pos FROM d")
def positions(spark, sf):
    return portable(scans.positions(event_facts(spark, sf)), "pos")


def _perm(order: str):
    def run(spark, sf):
        return scans.permutation(event_facts(spark, sf), order)

    return run


for _name, _by in (("aevt", "a, e, v, p, l, n, op"), ("vaet", "v, a, e, p, l, n, op"), ("avet", "a, v, e, p, l, n, op")):
    register(f"perm_{_name}", f"WITH {D} SELECT row_number() OVER (ORDER BY {_by}) - 1 AS rank, row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1 AS pos FROM d")(_perm(_name))


@register("perm_txid", f"WITH {D} SELECT row_number() OVER (ORDER BY p, l, n, pos) - 1 AS rank, pos FROM (SELECT *, row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1 AS pos FROM d)")
def perm_txid(spark, sf):
    return scans.tx_permutation(event_facts(spark, sf))


@register("columns", f"WITH {D} SELECT e, p AS tx_phys, l AS tx_log, n AS node, op::BIGINT AS op FROM d")
def columns(spark, sf):
    return portable(event_facts(spark, sf)).select("e", "tx_phys", "tx_log", "node", "op")


@register("attr_encode", f"WITH {D}, i AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS attr_id FROM (SELECT DISTINCT a FROM d)) SELECT attr_id::BIGINT AS attr_id, a, count(*)::BIGINT AS n FROM d JOIN i USING (a) GROUP BY ALL")
def attr_encode(spark, sf):
    d = event_facts(spark, sf)
    return scans.encoded(d, scans.attribute_dim(d)).groupBy(F.col("attr_id").cast("bigint").alias("attr_id"), "a").agg(F.count("*").alias("n"))


@register("entity_runs", f"WITH {D}, r AS (SELECT e, count(*)::BIGINT AS length FROM d GROUP BY e) SELECT e, row_number() OVER (ORDER BY e) - 1 AS run, (sum(length) OVER (ORDER BY e) - length)::BIGINT AS first, length FROM r")
def entity_runs(spark, sf):
    return scans.entity_runs(event_facts(spark, sf)).withColumn("e", hex_of(F.col("e")))


_PLACED = f"WITH {D}, q AS (SELECT *, row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1 AS pos FROM d), r AS (SELECT *, coalesce(sum(1 - op) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM q)"


@register("rank1", f"{_PLACED} SELECT pos, rank FROM r")
def rank1(spark, sf):
    return scans.rank1(scans.positions(event_facts(spark, sf)).select("pos", "op"), F.col("op") == ASSERT).select("pos", "rank")


@register("select1", f"{_PLACED} SELECT pos FROM r WHERE op = 0 AND rank = 100")
def select1(spark, sf):
    return scans.select1(scans.positions(event_facts(spark, sf)).select("pos", "op"), F.col("op") == ASSERT, 100).select("pos")


@register("symbol_rank", f"{_PLACED} SELECT pos, a, row_number() OVER (PARTITION BY a ORDER BY pos) - 1 AS rank FROM r")
def symbol_rank(spark, sf):
    return scans.symbol_rank(scans.positions(event_facts(spark, sf)).select("pos", "a"), "a")


_BYTES = f"WITH {D}, b AS (SELECT ('0x' || substr(hex(a), (i * 2 + 1)::INT, 2))::BIGINT AS byte FROM (SELECT a, unnest(range(length(a))) AS i FROM d)), c AS (SELECT byte, count(*)::BIGINT AS n FROM b GROUP BY byte)"


@register("byte_histogram", f"{_BYTES} SELECT * FROM c")
def byte_histogram(spark, sf):
    return scans.byte_histogram(event_facts(spark, sf), "a").withColumn("byte", F.col("byte").cast("bigint"))


@register("entropy_ratio", f"{_BYTES} SELECT round(sum(-(n / t) * log2(n / t)) / 8, 9) AS ratio FROM c, (SELECT sum(n) AS t FROM c)")
def entropy_ratio(spark, sf):
    return scans.entropy_ratio(scans.byte_histogram(event_facts(spark, sf), "a")).select(F.round("ratio", 9).alias("ratio"))


# time

_LOW, _HIGH = 1704067200000 + 86_400_000, 1704067200000 + 86_400_000 * 15


@register("tx_range", f"WITH {D} SELECT {ROW} FROM d WHERE p BETWEEN {_LOW} AND {_HIGH}")
def tx_range(spark, sf):
    return portable(live.tx_range(event_facts(spark, sf), TxId(_LOW), TxId(_HIGH, 2**32 - 1, b"\xff" * 16)))


@register("as_of", f"WITH d0 AS (WITH {D} SELECT * FROM d), d AS (SELECT * FROM d0 WHERE p <= {_HIGH}), {LIVE} SELECT {LIVE_ROW} FROM live")
def as_of(spark, sf):
    return _live_row(live.live_set(live.as_of(event_facts(spark, sf), TxId(_HIGH, 2**32 - 1, b"\xff" * 16))))


@register("snapshot", f"WITH {D} SELECT {ROW} FROM d WHERE epoch <= 5")
def snapshot(spark, sf):
    return portable(live.snapshot(event_facts(spark, sf), 5))


# filters


def _filter(f: filters.FactFilter):
    def run(spark, sf):
        return portable(f.apply(event_facts(spark, sf)))

    return run


register("filter_all", f"WITH {D} SELECT {ROW} FROM d")(_filter(filters.All()))
register("filter_namespace", f"WITH {D} SELECT {ROW} FROM d WHERE a LIKE 'event/c%' OR a LIKE 'event/p%'")(_filter(filters.AttributeNamespace(("event/c", "event/p"))))
register("filter_nodes", f"WITH {D} SELECT {ROW} FROM d WHERE n IN (1, 2)")(_filter(filters.FromNodes((node_id(1), node_id(2)))))
register("filter_and_or", f"WITH {D} SELECT {ROW} FROM d WHERE (a LIKE 'event/c%' OR n = 3) AND n <> 1")(
    _filter(filters.And((filters.Or((filters.AttributeNamespace(("event/c",)), filters.FromNodes((node_id(3),)))), filters.FromNodes((node_id(0), node_id(2), node_id(3))))))
)
register("filter_not", f"WITH {D} SELECT {ROW} FROM d WHERE NOT (a LIKE 'event/c%')")(_filter(filters.Not(filters.AttributeNamespace(("event/c",)))))
register("filter_after_epoch", f"WITH {D} SELECT {ROW} FROM d WHERE epoch > 3")(_filter(filters.AfterEpoch(3)))
register("replica_subset", f"WITH {D} SELECT {ROW} FROM d WHERE n = 2")(_filter(filters.FromNodes((node_id(2),))))


@register("filter_entities", f"WITH {D} SELECT {ROW} FROM d WHERE e IN (sha256('user/1'), sha256('user/2'), sha256('user/77'))")
def filter_entities(spark, sf):
    import hashlib

    ids = tuple(hashlib.sha256(f"user/{i}".encode()).digest() for i in (1, 2, 77))
    return portable(filters.Entities(ids).apply(event_facts(spark, sf)))


@register("filter_text", "SELECT 'And([All, Or([AttributeNamespace([\"a/\"]), Not(FromNodes([00000000000000000000000000000001]))])])' AS text, false AS monotone")
def filter_text(spark, sf):
    f = filters.And((filters.All(), filters.Or((filters.AttributeNamespace(("a/",)), filters.Not(filters.FromNodes((node_id(1),)))))))
    return spark.range(1).select(F.lit(str(f)).alias("text"), F.lit(f.monotone).alias("monotone"))


@register("user_facts", f"WITH {D} SELECT {ROW} FROM d")
def user_facts(spark, sf):
    d = event_facts(spark, sf)
    return portable(filters.user_facts(d.unionByName(txn.tx_metadata(txn.transactions(d)))))


@register("trust_only", f"WITH {D} SELECT {ROW} FROM d WHERE n IN (0, 1)")
def trust_only(spark, sf):
    d = event_facts(spark, sf)
    signers = txn.transactions(d).withColumn("signer", F.col("tx_node"))
    return portable(filters.trust_filter(d, signers, filters.TrustPolicy(only=(node_id(0), node_id(1)))))


_CAL = f"WITH {D}, c AS (SELECT n, avg(abs(v - 50)) AS error, count(*) AS k FROM d GROUP BY n)"


@register("calibration", f"{_CAL} SELECT n AS node, round(error, 6) AS error, k::BIGINT AS n FROM c")
def calibration(spark, sf):
    d = event_facts(spark, sf)
    said = d.select(F.conv(F.hex("tx_node"), 16, 10).cast("bigint").alias("signer"), F.col("tx_log").alias("key"), F.col("v_long").alias("predicted"))
    got = filters.calibration(said, d.select(F.col("tx_log").alias("key"), F.lit(50).alias("actual")))
    return got.select(F.col("signer").alias("node"), F.round("error", 6).alias("error"), "n")


@register("trust_calibrated", f"{_CAL} SELECT {ROW} FROM d WHERE n IN (SELECT n FROM c WHERE error <= (SELECT avg(error) FROM c))")
def trust_calibrated(spark, sf):
    d = event_facts(spark, sf)
    said = d.select(F.col("tx_node").alias("signer"), F.col("tx_log").alias("key"), F.col("v_long").alias("predicted"))
    scores = filters.calibration(said, d.select(F.col("tx_log").alias("key"), F.lit(50).alias("actual")))
    bar = scores.agg(F.avg("error")).first()[0] or 0.0  # one row a node
    signers = txn.transactions(d).withColumn("signer", F.col("tx_node"))
    return portable(filters.trust_filter(d, signers, filters.TrustPolicy(max_error=bar), scores))


# LIVE


@register("live_set", f"WITH {D}, {LIVE} SELECT {LIVE_ROW} FROM live")
def live_set(spark, sf):
    return _live_row(live.live_set(event_facts(spark, sf)))


@register("live_values", f"WITH {D}, {LIVE} SELECT {LIVE_ROW} FROM live WHERE a = 'event/click'")
def live_values(spark, sf):
    return _live_row(live.live_values(event_facts(spark, sf), attribute="event/click"))


_RESOLVE = f"WITH {D}, {LIVE} SELECT {LIVE_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY p DESC, l DESC, n DESC, v DESC) AS r FROM live) WHERE r = 1"


@register("live_resolve", _RESOLVE)
def live_resolve(spark, sf):
    return _live_row(live.live_resolve(event_facts(spark, sf)))


@register("resolve_by_provenance", f"WITH {D}, {LIVE} SELECT {LIVE_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY e, a ORDER BY n DESC, p DESC, l DESC, v DESC) AS r FROM live) WHERE r = 1")
def resolve_by_provenance(spark, sf):
    d = event_facts(spark, sf)
    weights = txn.transactions(d).withColumn("rank", F.conv(F.hex("tx_node"), 16, 10).cast("int"))
    return _live_row(live.resolve_by_provenance(d, weights))


@register("live_count", f"WITH {D}, {LIVE} SELECT count(*)::BIGINT AS n_triples, count(DISTINCT e || a)::BIGINT AS n_pairs FROM live")
def live_count(spark, sf):
    return live.live_counts(event_facts(spark, sf))


@register("retracted_values", f"WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY e, a, v ORDER BY p DESC, l DESC, n DESC, op) AS k FROM d) SELECT {LIVE_ROW} FROM r WHERE k = 1 AND op = 1")
def retracted_values(spark, sf):
    return _live_row(live.retracted_set(event_facts(spark, sf)))


@register("merge_causal", f"WITH {D}, {LIVE} SELECT {LIVE_ROW} FROM live")
def merge_causal(spark, sf):
    latest, order = live.merge_causal(*replicas(spark, sf))
    return _live_row(order.unpacked(latest.where(order.asserted())))


# sets


@register("merge", f"WITH {D} SELECT {ROW} FROM d")
def merge(spark, sf):
    return portable(setops.merge(*replicas(spark, sf)))


@register("selective_merge", f"WITH {D} SELECT {ROW} FROM d WHERE l % 3 <> 0 OR n IN (0, 1)")
def selective_merge(spark, sf):
    a, b = replicas(spark, sf)
    return portable(setops.selective_merge(a, b, filters.FromNodes((node_id(0), node_id(1)))))


@register(
    "merge_receipt",
    f"WITH {D} SELECT count(*) FILTER (WHERE n IN (0, 1) AND l % 3 = 0)::BIGINT AS transferred, count(*) FILTER (WHERE n NOT IN (0, 1))::BIGINT AS filtered_out, count(*) FILTER (WHERE n IN (0, 1) AND l % 3 <> 0)::BIGINT AS already_present FROM d WHERE l % 3 <> 1",
)
def merge_receipt(spark, sf):
    a, b = replicas(spark, sf)
    return setops.merge_receipt(a, b, filters.FromNodes((node_id(0), node_id(1))))


@register("store_diff", f"WITH {D} SELECT {ROW}, CASE WHEN l % 3 = 1 THEN 'left' ELSE 'right' END AS side FROM d WHERE l % 3 <> 2")
def store_diff(spark, sf):
    return portable(setops.difference(*replicas(spark, sf)), "side")


@register("store_intersection", f"WITH {D} SELECT {ROW} FROM d WHERE l % 3 = 2")
def store_intersection(spark, sf):
    return portable(setops.intersection(*replicas(spark, sf)))


@register("set_equal", f"WITH {D} SELECT false AS equal, count(*)::BIGINT AS n_different FROM d WHERE l % 3 <> 2")
def set_equal(spark, sf):
    return setops.set_equal(*replicas(spark, sf))


_SWAP = " || ".join(f"substr(e, {15 - 2 * i}, 2)" for i in range(8))


@register("shard_counts", f"WITH {D} SELECT (('0x' || {_SWAP})::UBIGINT % 7)::BIGINT AS shard, count(*)::BIGINT AS n FROM d GROUP BY ALL")
def shard_counts(spark, sf):
    return setops.shard(event_facts(spark, sf), 7).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@register("unshard", f"WITH {D} SELECT {ROW} FROM d")
def unshard(spark, sf):
    d = setops.shard(event_facts(spark, sf), 3)
    return portable(setops.unshard(*[d.where(F.col("shard") == i) for i in range(3)]))


# fingerprints and sketches


@register("content_hash", f"WITH {D}, {HASHED} SELECT l AS tx_log, hash FROM h")
def content_hashes(spark, sf):
    return event_facts(spark, sf).select("tx_log", hex_of(content_hash()).alias("hash"))


@register("fingerprint", f"WITH {D}, {HASHED} {_fp('h', 'hash')}")
def store_fingerprint(spark, sf):
    return fingerprint.fingerprint(event_facts(spark, sf))


_CHUNKS = "c AS (SELECT *, (row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1) // 1024 AS chunk FROM h)"


@register("chunk_fingerprints", f"WITH {D}, {HASHED}, {_CHUNKS}, f AS ({_fp('c', 'hash', 'chunk')}) SELECT f.*, (SELECT count(*) FROM c WHERE c.chunk = f.chunk)::BIGINT AS n FROM f")
def chunk_fingerprints(spark, sf):
    return fingerprint.chunk_fingerprints(event_facts(spark, sf))


@register("fingerprint_of_chunks", f"WITH {D}, {HASHED} {_fp('h', 'hash')}")
def fingerprint_of_chunks(spark, sf):
    return fingerprint.store_fingerprint(fingerprint.chunk_fingerprints(event_facts(spark, sf)))


@register(
    "diff_chunks",
    f"""WITH {D}, {HASHED},
  a AS (SELECT *, (row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1) // 1024 AS chunk FROM h WHERE l % 3 <> 0), b AS (SELECT *, (row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1) // 1024 AS chunk FROM h WHERE l % 3 <> 1),
  fa AS ({_fp('a', 'hash', 'chunk')}), fb AS ({_fp('b', 'hash', 'chunk')})
  SELECT coalesce(fa.chunk, fb.chunk) AS chunk FROM fa FULL JOIN fb ON fa.chunk = fb.chunk WHERE coalesce(fa.fingerprint, repeat('0', 64)) <> coalesce(fb.fingerprint, repeat('0', 64))""",
)
def diff_chunks(spark, sf):
    a, b = replicas(spark, sf)
    return fingerprint.diff_chunks(fingerprint.chunk_fingerprints(a), fingerprint.chunk_fingerprints(b))


_SK = f"{D}, {HASHED}, sa AS (SELECT hash FROM h WHERE l % 3 <> 0 ORDER BY hash LIMIT 256), sb AS (SELECT hash FROM h WHERE l % 3 <> 1 ORDER BY hash LIMIT 256), i AS (SELECT count(*) AS i FROM sa JOIN sb USING (hash)), u AS (SELECT (SELECT count(*) FROM sa) + (SELECT count(*) FROM sb) - i AS u, i FROM i)"


@register("minhash", f"WITH {D}, {HASHED} SELECT hash, (SELECT count(*) FROM h)::BIGINT AS n FROM h ORDER BY hash LIMIT 256")
def minhash(spark, sf):
    return fingerprint.sketch(event_facts(spark, sf)).select(F.explode("hashes").alias("hash"), "n")


def _sketches(spark, sf):
    a, b = replicas(spark, sf)
    return fingerprint.sketch(a), fingerprint.sketch(b)


@register("jaccard", f"WITH {_SK} SELECT round(i / u, 9) AS jaccard FROM u")
def jaccard(spark, sf):
    return fingerprint.jaccard(*_sketches(spark, sf)).select(F.round("jaccard", 9).alias("jaccard"))


@register("jaccard_unbiased", f"WITH {_SK}, low AS (SELECT hash FROM (SELECT hash FROM sa UNION SELECT hash FROM sb) ORDER BY hash LIMIT 256) SELECT round(count(*) FILTER (WHERE hash IN (SELECT hash FROM sa) AND hash IN (SELECT hash FROM sb)) / count(*), 9) AS jaccard FROM low")
def jaccard_unbiased(spark, sf):
    return fingerprint.jaccard_unbiased(*_sketches(spark, sf)).select(F.round("jaccard", 9).alias("jaccard"))


@register("est_diff", f"WITH {_SK} SELECT CASE WHEN u = i THEN 0 ELSE ((SELECT count(*) FILTER (WHERE l % 3 <> 0) + count(*) FILTER (WHERE l % 3 <> 1) FROM h) * (u - i) * 2 + (u + i)) // (2 * (u + i)) END::BIGINT AS estimated_difference FROM u")
def est_diff(spark, sf):
    return fingerprint.estimated_difference(*_sketches(spark, sf))


@register("sketch_merge", f"WITH {_SK} SELECT hash, (SELECT count(*) FILTER (WHERE l % 3 <> 0) + count(*) FILTER (WHERE l % 3 <> 1) FROM h)::BIGINT AS n FROM (SELECT hash FROM sa UNION SELECT hash FROM sb) ORDER BY hash LIMIT 256")
def sketch_merge(spark, sf):
    return fingerprint.merge_sketches(*_sketches(spark, sf)).select(F.explode("hashes").alias("hash"), "n")


@register("bijection_check", f"WITH {D}, {HASHED}, f AS ({_fp('h', 'hash')}) SELECT unnest(['eavt', 'aevt', 'vaet', 'avet']) AS layout, (SELECT count(*) FROM h)::BIGINT AS n, fingerprint FROM f")
def bijection_check(spark, sf):
    d = event_facts(spark, sf)  # each order is written as files of its own and checked as read back
    return fingerprint.bijection_check({o: materialize(scans.scan(d, o), f"layout-{o}") for o in ("eavt", "aevt", "vaet", "avet")})


# transactions

_FRONT = "SELECT n AS node, p AS tx_phys, l AS tx_log FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY p DESC, l DESC) AS k FROM d) WHERE k = 1"


def _front(rows):
    return rows.select(F.conv(F.hex("tx_node"), 16, 10).cast("bigint").alias("node"), "tx_phys", "tx_log")


@register("frontier", f"WITH {D} {_FRONT}")
def tx_frontier(spark, sf):
    return _front(frontier(event_facts(spark, sf)))


@register("frontier_merge", f"WITH {D} {_FRONT}")
def frontier_merge(spark, sf):
    return _front(merge_frontiers(*[frontier(r) for r in replicas(spark, sf)]))


_TXE = f"sha256(unhex({_le('p', 8)} || {_le('l', 4)} || lpad(to_hex(n), 32, '0')))"


@register(
    "tx_metadata",
    f"WITH {D} SELECT {_TXE} AS e, 'tx/time' AS a, p::VARCHAR AS v FROM d UNION ALL SELECT {_TXE}, 'tx/origin', sha256(unhex(lpad(to_hex(n), 32, '0'))) FROM d UNION ALL SELECT {_TXE}, 'tx/provenance', 'provenance/derived' FROM d",
)
def tx_metadata(spark, sf):
    txs = txn.transactions(event_facts(spark, sf))
    rows = txn.tx_metadata(txs).unionByName(txn.federation_metadata(txs, provenance="derived"))
    return rows.select(hex_of(F.col("e")).alias("e"), "a", F.coalesce("v_str", F.col("v_long").cast("string"), hex_of(F.col("v_bin"))).alias("v"))


@register("tx_bundles", f"WITH {D} SELECT p AS tx_phys, l AS tx_log, n AS node, 1::BIGINT AS n_facts, 3::BIGINT AS n_meta, p AS time, 'inferred' AS provenance, 0::BIGINT AS n_predecessors, false AS signed FROM d")
def tx_bundles(spark, sf):
    d = event_facts(spark, sf)
    txs = txn.transactions(d)
    rows = txn.bundles(d.unionByName(txn.tx_metadata(txs)).unionByName(txn.federation_metadata(txs, provenance="inferred")))
    return rows.select("tx_phys", "tx_log", F.conv(F.hex("tx_node"), 16, 10).cast("bigint").alias("node"), "n_facts", "n_meta", "time", "provenance", "n_predecessors", "signed")


@register("matching_transactions", f"WITH {D} SELECT l AS tx_log, 'event/click' AS a, true AS complete FROM d WHERE a = 'event/click' UNION ALL SELECT l, unnest(['tx/time', 'tx/origin']), true FROM d WHERE a = 'event/click'")
def matching_transactions(spark, sf):
    d = event_facts(spark, sf)
    rows = d.unionByName(txn.tx_metadata(txn.transactions(d)))
    return txn.matching_transactions(rows, filters.AttributeNamespace(("event/click",))).select("tx_log", "a", "complete")


@register("batch_splice", f"WITH {D} SELECT epoch, a, count(*)::BIGINT AS n FROM (SELECT 7 AS epoch, a FROM d WHERE l % 3 <> 0 UNION ALL SELECT 8, a FROM d WHERE l % 3 <> 1 UNION ALL SELECT unnest([7, 8]), 'tx/time' UNION ALL SELECT unnest([7, 8]), 'tx/origin') GROUP BY ALL")
def batch_splice(spark, sf):
    a, b = replicas(spark, sf)
    rows = txn.splice([(a, TxId(5, 0, node_id(1))), (b, TxId(5, 1, node_id(1)))], 7)
    return rows.groupBy("epoch", "a").agg(F.count("*").alias("n"))


@register("provenance_weight", "SELECT event_id, (event_id % 4)::BIGINT AS rank, [0.2, 0.5, 0.8, 1.0][event_id % 4 + 1]::DOUBLE AS confidence FROM events")
def provenance_weight(spark, sf):
    level = F.element_at(F.array(*[F.lit(prov.keyword(x[0])) for x in prov.LEVELS]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", prov.rank(level).cast("bigint").alias("rank"), prov.confidence(level).alias("confidence"))


@register("checksum")
def checksum(spark, sf):
    return table(spark, sf, "events").select("event_id", crc32_of(F.col("props")).alias("crc"))


# schema


def _definitions(spark, sf, keep, shift: int = 0):
    n = table(spark, sf, "nation").where(keep)
    names = F.array(*[F.lit(f"db.type/{t}") for t in ("keyword", "string", "long", "double")])
    kind = F.element_at(names, ((F.col("n_nationkey") + F.when(F.col("n_nationkey") % 5 == 0, shift).otherwise(0)) % 4 + 1).cast("int"))
    card = F.when(F.col("n_nationkey") % 2 == 0, "db.cardinality/one").otherwise("db.cardinality/many")
    out = None
    for a, v in (("db/ident", F.concat(F.lit("geo/"), F.lower("n_name"))), ("db/valueType", kind), ("db/cardinality", card)):
        rows = facts(n, F.concat(F.lit("attr/"), F.col("n_nationkey").cast("string")), F.lit(a), KEYWORD, v, F.col("n_nationkey"), F.lit(0), F.lit(0), F.lit(ASSERT))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("schema_from_facts", "SELECT 'geo/' || lower(n_name) AS attr, (n_nationkey % 4 + 1)::BIGINT AS value_type, (n_nationkey % 2)::BIGINT AS cardinality FROM nation")
def schema_from_facts(spark, sf):
    rows = schema.evolve(_definitions(spark, sf, F.lit(True)))
    return rows.select("attr", F.col("value_type").cast("bigint").alias("value_type"), F.col("cardinality").cast("bigint").alias("cardinality"))


@register("genesis_schema", "SELECT 25::BIGINT AS n, 2::BIGINT AS n_many, 4::BIGINT AS n_refs")
def genesis_schema(spark, sf):
    return schema.genesis(spark).agg(F.count("*").alias("n"), F.sum("cardinality").alias("n_many"), F.sum(F.when(F.col("value_type") == REF, 1).otherwise(0)).alias("n_refs"))


_BOTH = "a AS (SELECT 'geo/' || lower(n_name) AS attr, n_nationkey % 4 + 1 AS t, n_nationkey % 2 AS c FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT 'geo/' || lower(n_name) AS attr, (n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS t, n_nationkey % 2 AS c FROM nation WHERE n_nationkey % 3 <> 1)"


def _two_schemas(spark, sf):
    k = F.col("n_nationkey") % 3
    return schema.merge_schemas(schema.evolve(_definitions(spark, sf, k != 0)), schema.evolve(_definitions(spark, sf, k != 1, 1)))


@register("schema_merge", f"WITH {_BOTH} SELECT coalesce(a.attr, b.attr) AS attr, least(a.t, b.t)::BIGINT AS value_type, coalesce(a.c, b.c)::BIGINT AS cardinality FROM a FULL JOIN b ON a.attr = b.attr")
def schema_merge(spark, sf):
    return _two_schemas(spark, sf)[0].select("attr", F.col("value_type").cast("bigint").alias("value_type"), F.col("cardinality").cast("bigint").alias("cardinality"))


_KIND = "(['keyword', 'string', 'long', 'double'])[{}] || CASE WHEN a.c = 0 THEN ' one lww' ELSE ' many lww' END"


@register("schema_conflicts", f"WITH {_BOTH} SELECT a.attr, {_KIND.format('least(a.t, b.t)')} AS kept, {_KIND.format('greatest(a.t, b.t)')} AS discarded FROM a JOIN b ON a.attr = b.attr WHERE a.t <> b.t")
def schema_conflicts(spark, sf):
    return _two_schemas(spark, sf)[1]


@register("schema_violations", "SELECT 'customer/balance' AS a, 'unknown attribute' AS problem, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'order/total', 'wrong type', count(*)::BIGINT FROM orders")
def schema_violations(spark, sf):
    known = [("order/status", STRING), ("order/total", LONG), ("order/date", INSTANT), ("customer/segment", STRING)]
    given = spark.createDataFrame([(a, t, 0, 0, None) for a, t in known], schema.SCHEMA_TYPE)
    return schema.violations(scalar_facts(spark, sf), given).groupBy("a", "problem").agg(F.count("*").alias("n"))


# graph


def _hex_edges(rows):
    return rows.select(hex_of(F.col("src")).alias("src"), "attr", hex_of(F.col("dst")).alias("dst"))


@register("edges", f"WITH {G} SELECT * FROM g")
def edges(spark, sf):
    return _hex_edges(graph.edges(reference_facts(spark, sf)))


def _ids(spark, sf, name, key, prefix):
    return table(spark, sf, name).select(entity_id(F.concat(F.lit(prefix), F.col(key).cast("string"))).alias("id"))


@register("neighbors", f"WITH {G} SELECT * FROM g WHERE attr = 'customer/nation'")
def neighbors(spark, sf):
    return _hex_edges(graph.neighbors(graph.edges(reference_facts(spark, sf)), _ids(spark, sf, "customer", "c_custkey", "customer/")))


@register("reverse_neighbors", f"WITH {G} SELECT * FROM g WHERE attr IN ('customer/nation', 'supplier/nation')")
def reverse_neighbors(spark, sf):
    return _hex_edges(graph.reverse_neighbors(graph.edges(reference_facts(spark, sf)), _ids(spark, sf, "nation", "n_nationkey", "nation/")))


@register("degree_stats", f"WITH {G} SELECT count(*)::BIGINT AS n_edges, count(DISTINCT src)::BIGINT AS n_sources, count(DISTINCT dst)::BIGINT AS n_targets FROM g")
def degree_stats(spark, sf):
    return graph.degree_stats(graph.edges(reference_facts(spark, sf)))


@register("k_hop", f"WITH {G} SELECT a.src AS start, a.dst AS node, 1::BIGINT AS hops FROM g a WHERE attr = 'customer/nation' UNION SELECT a.src, b.dst, 2 FROM g a JOIN g b ON a.dst = b.src WHERE a.attr = 'customer/nation'")
def k_hop(spark, sf):
    rows = graph.k_hop(graph.edges(reference_facts(spark, sf)), _ids(spark, sf, "customer", "c_custkey", "customer/"), 2)
    return rows.select(hex_of(F.col("start")).alias("start"), hex_of(F.col("node")).alias("node"), F.col("hops").cast("bigint").alias("hops"))


_REACH = f"WITH RECURSIVE {G}, r AS (SELECT src AS start, dst AS node FROM g WHERE attr = 'order/customer' UNION SELECT r.start, g.dst FROM r JOIN g ON r.node = g.src)"


@register("reachable", f"{_REACH} SELECT * FROM r")
def reachable(spark, sf):
    rows = graph.reachable(graph.edges(reference_facts(spark, sf)), _ids(spark, sf, "orders", "o_orderkey", "order/"))
    return rows.select(hex_of(F.col("start")).alias("start"), hex_of(F.col("node")).alias("node"))


# Datalog

TYPES = {"order/customer": REF, "customer/nation": REF, "supplier/nation": REF, "nation/region": REF, "order/status": STRING, "order/total": DOUBLE, "order/date": INSTANT, "customer/segment": STRING, "customer/balance": DOUBLE}


def _world(spark, sf):
    return live.live_set(reference_facts(spark, sf).unionByName(scalar_facts(spark, sf)))


def _ask(text: str, ids: tuple[str, ...] = (), rules: tuple[str, ...] = (), **params):
    def run(spark, sf):
        rows = datalog.query(_world(spark, sf), text, TYPES, params, rules)
        return rows.select(*[hex_of(F.col(c)).alias(c) if c in ids else F.col(c) for c in rows.columns])

    return run


register("dl_pattern", "SELECT DISTINCT sha256('customer/' || c_custkey) AS c, c_mktsegment AS s FROM customer")(_ask("[:find ?c ?s :where [?c customer/segment ?s]]", ("c",)))
register("dl_join2", "SELECT DISTINCT sha256('order/' || o_orderkey) AS o, sha256('nation/' || c_nationkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey")(_ask("[:find ?o ?n :where [?o order/customer ?c] [?c customer/nation ?n]]", ("o", "n")))
register("dl_join3", "SELECT DISTINCT sha256('order/' || o_orderkey) AS o, sha256('region/' || n_regionkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")(
    _ask("[:find ?o ?r :where [?n nation/region ?r] [?o order/customer ?c] [?c customer/nation ?n]]", ("o", "r"))
)
register("dl_predicate", "SELECT DISTINCT sha256('order/' || o_orderkey) AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 200000")(_ask("[:find ?o ?t :where [?o order/total ?t] [(> ?t 200000.0)]]", ("o",)))
register("dl_param", "SELECT DISTINCT sha256('customer/' || c_custkey) AS c FROM customer WHERE c_mktsegment = 'BUILDING'")(_ask("[:find ?c :where [?c customer/segment $segment]]", ("c",), segment="BUILDING"))
register("dl_constant", "SELECT DISTINCT sha256('order/' || o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'MACHINERY'")(
    _ask('[:find ?o :where [?o order/status "F"] [?o order/customer ?c] [?c customer/segment "MACHINERY"]]', ("o",))
)
register("dl_not", "SELECT DISTINCT sha256('customer/' || c_custkey) AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    _ask('[:find ?c :where [?c customer/segment ?s] (not [?o order/customer ?c] [?o order/status "P"])]', ("c",))
)
register("dl_exists", "SELECT sha256('nation/' || c_nationkey) AS n, true AS exists_c FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")(
    _ask('[:find ?n (exists ?c) :where [?c customer/nation ?n] [?c customer/segment "BUILDING"]]', ("n",))
)
register("dl_count", "SELECT sha256('nation/' || c_nationkey) AS n, count(*)::BIGINT AS count_c FROM customer GROUP BY c_nationkey")(_ask("[:find ?n (count ?c) :where [?c customer/nation ?n]]", ("n",)))
register("dl_sum", "SELECT c_mktsegment AS s, sum(epoch_us(o_orderdate) // 1000)::BIGINT AS sum_d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(_ask("[:find ?s (sum ?d) :where [?o order/date ?d] [?o order/customer ?c] [?c customer/segment ?s]]"))
register("dl_minmax", "SELECT o_orderstatus AS s, min(o_totalprice) AS min_t, max(o_totalprice) AS max_t FROM orders GROUP BY 1")(_ask("[:find ?s (min ?t) (max ?t) :where [?o order/status ?s] [?o order/total ?t]]"))
register("dl_order_limit", "SELECT sha256('order/' || o_orderkey) AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 20")(_ask("[:find ?o ?t :where [?o order/total ?t] :order-by (desc ?t) ?o :limit 20]", ("o",)))
register("dl_rules", f"{_REACH} SELECT start AS o, node AS x FROM r")(
    _ask(
        "[:find ?o ?x :where [?o order/status ?s] (up ?o ?x)]",
        ("o", "x"),
        ("[(up ?x ?y) [?x order/customer ?y]]", "[(up ?x ?y) [?x customer/nation ?y]]", "[(up ?x ?y) [?x nation/region ?y]]", "[(up ?x ?z) (up ?x ?y) (up ?y ?z)]"),
    )
)

_EV = {f"event/{t}": LONG for t in ("click", "view", "purchase", "signup", "error", "logout", "login", "search")}
_FED = "[:find ?e ?v :where [?e event/click ?v]]"
_L = "(SELECT e, v FROM (SELECT *, row_number() OVER (PARTITION BY e, a, v ORDER BY p DESC, l DESC, n DESC, op) AS k FROM d WHERE {}) WHERE k = 1 AND op = 0 AND a = 'event/click')"


def _fed(how):
    def run(spark, sf):
        rows = how(replicas(spark, sf), _FED, _EV)
        return rows.select(hex_of(F.col("e")).alias("e"), "v")

    return run


register("fed_fanout", f"WITH {D} SELECT * FROM {_L.format('l % 3 <> 0')} UNION SELECT * FROM {_L.format('l % 3 <> 1')}")(_fed(federation.fan_out))
register("fed_materialise", f"WITH {D} SELECT DISTINCT * FROM {_L.format('true')}")(_fed(federation.materialise))
register("fed_sharded", f"WITH {D} SELECT DISTINCT * FROM {_L.format('true')}")(lambda spark, sf: federation.sharded(event_facts(spark, sf), 4, _FED, _EV).select(hex_of(F.col("e")).alias("e"), "v"))


# streams


@register("observer_delta", f"WITH {D} SELECT {ROW} FROM d WHERE epoch > 4")
def observer_delta(spark, sf):
    return portable(delta_since(event_facts(spark, sf), 4))


@register("commit_stream", f"WITH {D}, {LIVE} SELECT e, a, v FROM live")
def commit_stream_live(spark, sf):
    """Commits as files, LIVE kept by a stream over them."""
    folder = f"{scratch_dir(spark)}/commits-{uuid.uuid4().hex}"
    event_facts(spark, sf).repartition(4, "epoch").write.parquet(f"{folder}/in")
    keep_live(commit_stream(spark, f"{folder}/in", max_files=2), f"{folder}/live", f"{folder}/state").awaitTermination()
    return kept_live(spark, f"{folder}/live").where("live").select(hex_of(F.col("e")).alias("e"), "a", F.col("v_long").alias("v"))


@register("windowed_counts", f"WITH {D} SELECT epoch_us(date_trunc('hour', make_timestamp(p * 1000))) // 1000 AS start, a, count(*)::BIGINT AS n FROM d GROUP BY 1, 2")
def windowed(spark, sf):
    return windowed_counts(event_facts(spark, sf)).select(F.unix_millis("start").alias("start"), "a", "n")


@register("incremental_live", f"WITH {D}, {LIVE} SELECT e, a, v FROM live")
def incremental_live(spark, sf):
    d = event_facts(spark, sf)
    old = live_stream(d.where("epoch <= 4")).drop("live")
    rows = apply_delta(old, delta_since(d, 4)).where(F.col("_key").endswith("1"))
    return rows.select(hex_of(F.col("e")).alias("e"), "a", F.col("v_long").alias("v"))


# content-addressed trees


def _pairs(rows):
    key = F.concat_ws("|", hex_of(F.col("e")), "a", F.col("tx_log").cast("string"))
    return rows.select(key.cast("binary").alias("key"), F.col("v_long").cast("string").cast("binary").alias("value"))


@register("tree_round_trip", f"WITH {D} SELECT e || '|' || a || '|' || l AS key, v::VARCHAR AS value FROM d")
def tree_round_trip(spark, sf):
    tree = chunks.build_tree(_pairs(event_facts(spark, sf)))
    return chunks.read_tree(tree.chunks, tree.root).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@register("tree_diff", f"WITH {D} SELECT e || '|' || a || '|' || l AS key, CASE WHEN l % 3 = 1 THEN 'left_only' ELSE 'right_only' END AS kind FROM d WHERE l % 3 <> 2")
def tree_diff(spark, sf):
    a, b = (chunks.build_tree(_pairs(r)) for r in replicas(spark, sf))
    return chunks.diff_trees(a, b).withColumn("key", F.col("key").cast("string"))


@register("tree_transfer", f"WITH {D} SELECT e || '|' || a || '|' || l AS key FROM d WHERE l % 3 <> 1")
def tree_transfer(spark, sf):
    a, b = (chunks.build_tree(_pairs(r)) for r in replicas(spark, sf))
    missing, _ = chunks.transfer(b.chunks, a.chunks)
    return chunks.read_tree(a.chunks.unionByName(missing), b.root).select(F.col("key").cast("string").alias("key"))


# text and vectors


def _text_facts(spark, sf):
    d = table(spark, sf, "documents")
    return facts(d, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit("doc/text"), STRING, F.col("text"), F.lit(1), F.lit(0), F.lit(0), F.lit(ASSERT))


_TERMS = r"t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)"


@register("text_index", f"WITH {_TERMS} SELECT term, count(*)::BIGINT AS n FROM t WHERE term <> '' GROUP BY term")
def text_index(spark, sf):
    return indexes.text_index(_text_facts(spark, sf), "doc/text").groupBy("term").agg(F.count("*").alias("n"))


@register("text_search", f"WITH {_TERMS} SELECT sha256('doc/' || doc_id) AS e FROM t WHERE term IN ('the', 'license') GROUP BY doc_id HAVING count(*) = 2")
def text_search(spark, sf):
    return indexes.text_scan(_text_facts(spark, sf), "doc/text", ["the", "License"]).select(hex_of(F.col("e")).alias("e"))


@register("vector_search", "WITH s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS score FROM embeddings) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vector_search(spark, sf):
    vectors = table(spark, sf, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()[0]
    return indexes.vector_search(vectors, first, 10).withColumn("score", F.round("score", 6))


# more of positions, runs and symbols

_POS = "row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1 AS pos"


@register("from_sorted", f"WITH {D} SELECT {ROW}, {_POS} FROM d")
def from_sorted(spark, sf):
    return portable(scans.from_sorted(scans.scan(event_facts(spark, sf))), "pos")  # the sort's partitions follow each other


@register("canonical", f"WITH {D} SELECT {ROW} FROM d")
def canonical_facts(spark, sf):
    a, b = replicas(spark, sf)
    return portable(canonical(a.unionByName(b)))


@register("run_of", f"WITH {D} SELECT {_POS}, dense_rank() OVER (ORDER BY e) - 1 AS run, e FROM d")
def run_of(spark, sf):
    d = event_facts(spark, sf)
    return scans.run_of(scans.entity_runs(d), scans.positions(d)).select("pos", "run", hex_of(F.col("e")).alias("e"))


_RUNS = f"{D}, q AS (SELECT e, {_POS} FROM d), r AS (SELECT e, dense_rank() OVER (ORDER BY e) - 1 AS run, pos FROM q)"


@register("run_range", f"WITH {_RUNS} SELECT e, min(pos) AS start, max(pos) + 1 AS stop FROM r WHERE run = 3 GROUP BY e")
def run_range(spark, sf):
    return scans.run_range(scans.entity_runs(event_facts(spark, sf)), 3).select(hex_of(F.col("e")).alias("e"), "start", "stop")


@register("entity_at", f"WITH {_RUNS} SELECT run, e FROM r WHERE pos = 100")
def entity_at(spark, sf):
    return scans.entity_at(scans.entity_runs(event_facts(spark, sf)), 100).select("run", hex_of(F.col("e")).alias("e"))


@register("run_counts", f"WITH {D} SELECT count(DISTINCT e)::BIGINT AS n_runs, count(*)::BIGINT AS n_facts FROM d")
def run_counts(spark, sf):
    return scans.run_counts(scans.entity_runs(event_facts(spark, sf)))


@register("symbol_select", f"WITH {D}, q AS (SELECT a, {_POS} FROM d) SELECT pos FROM q WHERE a = 'event/click' ORDER BY pos LIMIT 1 OFFSET 10")
def symbol_select(spark, sf):
    return scans.symbol_select(scans.positions(event_facts(spark, sf)), "a", "event/click", 10)


@register("symbol_access", f"WITH {D}, q AS (SELECT a, {_POS} FROM d) SELECT pos, a AS symbol FROM q WHERE pos < 100")
def symbol_access(spark, sf):
    return scans.symbol_access(scans.positions(event_facts(spark, sf)), "a", spark.range(100).select(F.col("id").alias("pos")))


@register("attr_intern", f"WITH {D}, o AS (SELECT a FROM d WHERE a < 'event/p' GROUP BY a), m AS (SELECT a FROM d WHERE a >= 'event/p' GROUP BY a) SELECT (row_number() OVER (ORDER BY a) - 1)::INT AS attr_id, a FROM o UNION ALL SELECT (row_number() OVER (ORDER BY a) - 1 + (SELECT count(*) FROM o))::INT, a FROM m")
def attr_intern(spark, sf):
    d = event_facts(spark, sf)
    return scans.intern_attributes(scans.attribute_dim(d.where("a < 'event/p'")), d.select("a"))


@register("attr_resolve", f"WITH {D}, o AS (SELECT a, (row_number() OVER (ORDER BY a) - 1)::INT AS i FROM d GROUP BY a) SELECT k::INT AS attr_id, a FROM range(6) t(k) LEFT JOIN o ON i = k")
def attr_resolve(spark, sf):
    return scans.resolve_attributes(scans.attribute_dim(event_facts(spark, sf)), spark.range(6).select(F.col("id").cast("int").alias("attr_id")))


@register("is_live", f"WITH {D}, {LIVE}, q AS (SELECT *, {_POS} FROM d) SELECT pos, EXISTS (SELECT 1 FROM live w WHERE (w.e, w.a, w.v, w.l, w.op) = (q.e, q.a, q.v, q.l, q.op)) AS is_live FROM q")
def is_live(spark, sf):
    d = scans.positions(event_facts(spark, sf))
    on = ["e", "a", "v_tag", "v_long", *TX_COLS]
    flagged = d.join(live.live_set(d).select(*on, F.lit(0).cast("tinyint").alias("op"), F.lit(True).alias("_live")), [*on, "op"], "left")
    return flagged.select("pos", F.coalesce("_live", F.lit(False)).alias("is_live"))


# incremental fingerprints, stores as values, anti-entropy


@register(
    "insert_hashes",
    f"WITH {D}, {HASHED}, q AS (SELECT hash, l, (row_number() OVER (ORDER BY e, a, v, p, l, n, op) - 1) // 1024 AS chunk FROM h), f AS ({_fp('q', 'hash', 'chunk')}) SELECT chunk, fingerprint, count(*)::BIGINT AS n, bool_or(l > 90 AND l % 7 = 0) AS dirty FROM f JOIN q USING (chunk) GROUP BY chunk, fingerprint",
)
def insert_hashes(spark, sf):
    placed = fingerprint.fact_hashes(scans.positions(event_facts(spark, sf)))
    new = (F.col("tx_log") > 90) & (F.col("tx_log") % 7 == 0)
    old = placed.where(~new).select("pos", "_h")
    first = fingerprint.clear_dirty(fingerprint.insert_hashes(spark.createDataFrame([], "chunk long, fingerprint string, n long"), old))
    return fingerprint.insert_hashes(first, placed.where(new).select("pos", "_h"))


@register("state_merge", "SELECT 7::BIGINT AS epoch, 1::BIGINT AS node, (SELECT count(*) FROM events)::BIGINT AS n, 0::BIGINT AS conflicts")
def state_merge(spark, sf):
    a, b = replicas(spark, sf)
    known = schema.genesis(spark)
    one, two = FactStore(a, known, 7, node_id(2)), FactStore(b, known, 4, node_id(1))
    both, conflicts = one.merge(two)
    row = both.size().withColumns({"epoch": F.lit(both.epoch).cast("bigint"), "node": F.lit(int.from_bytes(both.node, "big")).cast("bigint")})
    return row.crossJoin(conflicts.agg(F.count("*").alias("conflicts"))).select("epoch", "node", "n", "conflicts")  # one row each


@register("state_insert", f"WITH {D} SELECT {ROW} FROM d WHERE l % 3 <> 0 OR e = sha256('user/1')")
def state_insert(spark, sf):
    d = event_facts(spark, sf)
    one = d.where(F.col("e") == entity_id(F.lit("user/1")))
    return portable(FactStore.from_facts(replicas(spark, sf)[0]).insert(one).insert(one).facts)


@register("state_replay", f"WITH {D} SELECT {ROW}, (SELECT max(epoch) FROM d WHERE epoch < 3) AS epoch FROM d WHERE epoch < 3")
def state_replay(spark, sf):
    d = event_facts(spark, sf)
    batches = [(i, d.where(F.col("epoch") == i)) for i in range(3) if not d.where(F.col("epoch") == i).isEmpty()]
    found = FactStore.genesis(spark).replay(batches)
    return portable(found.facts.drop("epoch")).withColumn("epoch", F.lit(found.epoch).cast("bigint"))


@register("anti_entropy", f"WITH {D} SELECT {ROW}, side FROM d, (VALUES ('a'), ('b')) s(side)")
def anti_entropy(spark, sf):
    a, b = antientropy.reconcile(*replicas(spark, sf))
    return portable(a).withColumn("side", F.lit("a")).unionByName(portable(b).withColumn("side", F.lit("b")))


@register("anti_entropy_diff", f"WITH {D}, k AS (SELECT substr(md5(unhex(e)), 1, 3) AS b FROM d GROUP BY e HAVING bool_or(l % 3 <> 2)) SELECT {ROW} FROM d WHERE l % 3 <> 0 AND substr(md5(unhex(e)), 1, 3) IN (SELECT b FROM k)")
def anti_entropy_diff(spark, sf):
    a, b = replicas(spark, sf)
    return portable(antientropy.diff(a, antientropy.summary(b)))


@register("merge_provenance", "SELECT 0::BIGINT AS lost, 0::BIGINT AS foreign")
def merge_provenance(spark, sf):
    a, b = replicas(spark, sf)
    return antientropy.provenance_kept(setops.merge(a, b), a, b)


@register("trust_threshold", f"WITH {D} SELECT {ROW} FROM d WHERE (e, a, v, op) IN (SELECT (e, a, v, op) FROM d WHERE n IN (0, 1, 2) GROUP BY e, a, v, op HAVING count(DISTINCT n) >= 2)")
def trust_threshold(spark, sf):
    d = event_facts(spark, sf)
    signers = d.select(*TX_COLS, F.col("tx_node").alias("signer")).distinct()
    return portable(filters.trust_filter(d, signers, filters.TrustPolicy(threshold=(2, tuple(node_id(i) for i in range(3))))))


@register("trust_custom", f"WITH {D} SELECT {ROW} FROM d WHERE a = 'event/click' AND n IN (1, 2)")
def trust_custom(spark, sf):
    d = event_facts(spark, sf)
    signers = d.select(*TX_COLS, F.col("tx_node").alias("signer")).distinct()
    policy = filters.TrustPolicy(only=(node_id(1), node_id(2)), custom=lambda: F.col("a") == "event/click")
    return portable(filters.trust_filter(d, signers, policy))


@register("tx_bundle_contents", f"WITH {D} SELECT e, a, v, p AS tx_phys, l AS tx_log, n AS node, 0::BIGINT AS n_predecessors FROM d")
def tx_bundle_contents(spark, sf):
    d = event_facts(spark, sf)
    whole = d.unionByName(txn.tx_metadata(d.select(*TX_COLS).distinct()))
    rows = txn.bundle_contents(whole).select(*TX_COLS, F.size("predecessors").cast("bigint").alias("n_predecessors"), F.explode("facts").alias("f"))
    return portable(rows.select(*TX_COLS, "n_predecessors", "f.e", "f.a", "f.v_long", "f.op"), "n_predecessors").drop("op")


# the trust boundary


@register("decode_facts", f"WITH {D} SELECT {ROW} FROM d")
def decoded_facts(spark, sf):
    return portable(decode_facts(event_facts(spark, sf).select(canonical_bytes().alias("data"))))


def _damaged(d):
    """Every tenth fact loses something that a fact must have."""
    k = F.col("tx_log") % 40
    d = d.withColumn("v_long", F.when(k == 0, F.lit(None)).otherwise(F.col("v_long"))).withColumn("v_tag", F.when(k == 10, F.lit(12)).otherwise(F.col("v_tag")).cast("tinyint"))
    return d.withColumn("op", F.when(k == 20, F.lit(2)).otherwise(F.col("op")).cast("tinyint")).withColumn("e", F.when(k == 30, F.substring("e", 1, 31)).otherwise(F.col("e")))


@register("wire_rejected", f"WITH {D} SELECT l AS tx_log, CASE l % 40 WHEN 0 THEN 'value' WHEN 10 THEN 'value type' WHEN 20 THEN 'operation' ELSE 'entity' END AS problem FROM d WHERE l % 10 = 0")
def wire_rejected(spark, sf):
    return rejected(_damaged(event_facts(spark, sf))).select("tx_log", "problem")


@register("wire_trusted", f"WITH {D} SELECT {ROW} FROM d WHERE l % 10 <> 0")
def wire_trusted(spark, sf):
    return portable(into_trusted(_damaged(event_facts(spark, sf)).where("tx_log % 10 <> 0")))


# stores in a folder: commits, checkpoints, recovery, observers, peers


def _define(db, name: str, kind: str) -> txn.Transaction:
    e = _eid(f"def/{name}")
    t = txn.Transaction(db.node).assert_fact(e, "db/ident", KEYWORD, name)
    return t.assert_fact(e, "db/valueType", KEYWORD, f"db.type/{kind}").assert_fact(e, "db/cardinality", KEYWORD, "db.cardinality/one")


def _eid(text: str) -> bytes:
    import hashlib

    return hashlib.sha256(text.encode()).digest()


def _nation_store(spark, sf, upto: int = 25):
    """A store with a commit a nation, in key order, after one that defines the attribute; 25 rows."""
    db = Database(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", node_id(1))
    db.transact(_define(db, "nation/name", "string"))
    rows = table(spark, sf, "nation").orderBy("n_nationkey").limit(upto).collect()
    db.batch_transact([txn.Transaction(db.node).assert_fact(_eid(f"nation/{r.n_nationkey}"), "nation/name", STRING, r.n_name) for r in rows])
    return db


def _names(rows):
    return rows.where("a = 'nation/name'").select(hex_of(F.col("e")).alias("e"), F.col("v_str").alias("name"))


_NATION = "SELECT sha256('nation/' || n_nationkey) AS e, n_name AS name FROM nation"


@register("store_batch_commit", "SELECT sha256('nation/' || n_nationkey) AS e, n_name AS name, (row_number() OVER (ORDER BY n_nationkey) + 1)::BIGINT AS epoch FROM nation")
def store_batch_commit(spark, sf):
    db = _nation_store(spark, sf)
    return db.datoms().where("a = 'nation/name'").select(hex_of(F.col("e")).alias("e"), F.col("v_str").alias("name"), "epoch")


@register("store_recover", f"{_NATION}")
def store_recover(spark, sf):
    """Opened anew from its batches; files of a commit without a manifest stay unseen."""
    db = _nation_store(spark, sf)
    db.datoms().withColumn("v_str", F.lit("torn")).write.parquet(f"{db.files.root}/batches/epoch-torn")
    again, level = cold_start(spark, db.files.root, node_id(1))
    assert level == "batches" and again.epoch == db.epoch
    return _names(live.live_resolve(again.datoms()))


@register("store_checkpoint", f"{_NATION}")
def store_checkpoint(spark, sf):
    db = _nation_store(spark, sf)
    db.checkpoint()
    db.verify_checkpoint()
    again, level = cold_start(spark, db.files.root, node_id(1))
    assert level == "checkpoint" and again.epoch == db.epoch
    return _names(live.live_resolve(again.datoms()))


def _changed_store(spark, sf):
    """Checkpointed, then nation 0 retracted; before the checkpoint nation 1 was renamed."""
    db = _nation_store(spark, sf, 5)
    name = {r.n_nationkey: r.n_name for r in table(spark, sf, "nation").where("n_nationkey < 5").collect()}
    db.transact(txn.Transaction(db.node).retract_fact(_eid("nation/1"), "nation/name", STRING, name[1]).assert_fact(_eid("nation/1"), "nation/name", STRING, "NEW"))
    db.checkpoint()
    db.transact(txn.Transaction(db.node).retract_fact(_eid("nation/0"), "nation/name", STRING, name[0]))
    return db


@register("store_live_first", "SELECT sha256('nation/' || n_nationkey) AS e, CASE WHEN n_nationkey = 1 THEN 'NEW' ELSE n_name END AS name FROM nation WHERE n_nationkey BETWEEN 1 AND 4")
def store_live_first(spark, sf):
    return _names(live.live_resolve(_changed_store(spark, sf).live_first()))


@register("store_history", "SELECT sha256('nation/1') AS e, n_name AS name, op::BIGINT AS op FROM nation, (VALUES (0), (1)) o(op) WHERE n_nationkey = 1")
def store_history(spark, sf):
    return _changed_store(spark, sf).history().where("a = 'nation/name'").select(hex_of(F.col("e")).alias("e"), F.col("v_str").alias("name"), F.col("op").cast("bigint").alias("op"))


@register("store_replay", "SELECT sha256('nation/' || n_nationkey) AS e, n_name AS name, 6::BIGINT AS epoch FROM nation WHERE n_nationkey < 5")
def store_replay(spark, sf):
    db = _nation_store(spark, sf, 5)
    found = FactStore.genesis(spark, db.node).replay(db.batches())
    assert found.schema.where("attr = 'nation/name'").count() == 1
    return _names(found.live()).withColumn("epoch", F.lit(found.epoch).cast("bigint"))


@register("store_snapshots", "SELECT k::BIGINT AS epoch, greatest(k - 1, 0)::BIGINT AS n FROM range(7) t(k)")
def store_snapshots(spark, sf):
    db, out = _nation_store(spark, sf, 5), None
    for k in range(7):
        row = db.snapshot(k).agg(F.count(F.when(F.col("a") == "nation/name", 1)).alias("n")).select(F.lit(k).cast("bigint").alias("epoch"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register("store_observer", "SELECT k::BIGINT AS epoch, CASE WHEN k = 1 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN k = 1 THEN 'catch-up' ELSE 'commit' END AS how FROM range(1, 7) t(k)")
def store_observer(spark, sf):
    db = Database(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", node_id(1))
    db.transact(_define(db, "nation/name", "string"))
    seen = []

    def note(how):
        return lambda epoch, rows: seen.append((epoch, rows.where("a = 'nation/name'").count(), how))

    Observer(note("commit"), note("catch-up")).register(db)
    for r in table(spark, sf, "nation").orderBy("n_nationkey").limit(5).collect():
        db.transact(txn.Transaction(db.node).assert_fact(_eid(f"nation/{r.n_nationkey}"), "nation/name", STRING, r.n_name))
    return spark.createDataFrame(seen, "epoch long, n long, how string")


@register("store_novel", "SELECT sha256('nation/' || n_nationkey) AS e, n_name AS name FROM nation WHERE n_nationkey >= 5")
def store_novel(spark, sf):
    db, other = _nation_store(spark, sf, 5), _nation_store(spark, sf)
    clock = db.datoms().select("e", "a", "v_str", *TX_COLS)
    rows = other.datoms().drop(*TX_COLS).join(clock, ["e", "a", "v_str"], "left")
    offered = rows.select(*[F.coalesce(c, F.lit(0 if c != "tx_node" else bytes(16))).alias(c) if c in TX_COLS else F.col(c) for c in other.datoms().columns])
    return _names(db.novel(offered))


@register("store_pull", f"{_NATION} UNION SELECT sha256('region/' || r_regionkey), r_name FROM region")
def store_pull(spark, sf):
    """Facts of two stores together, the peer's filtered at its scan."""
    mine = Database(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", node_id(2))
    mine.transact(_define(mine, "region/name", "string"))
    rows = table(spark, sf, "region").collect()  # five rows
    mine.batch_transact([txn.Transaction(mine.node).assert_fact(_eid(f"region/{r.r_regionkey}"), "region/name", STRING, r.r_name) for r in rows])
    both = pull(mine, Peer(_nation_store(spark, sf)), filters.AttributeNamespace(("nation/",)))
    return live.live_resolve(both.where("a like '%/name'")).select(hex_of(F.col("e")).alias("e"), F.col("v_str").alias("name"))


@register("chunk_table", f"WITH {D} SELECT e || '|' || a || '|' || l AS key, 'kept' AS what FROM d UNION ALL SELECT 'chunks', 'none left' WHERE true")
def chunk_table(spark, sf):
    tree = chunks.build_tree(_pairs(event_facts(spark, sf)))
    held = chunks.ChunkTable(spark).put(tree.chunks).put(tree.chunks)
    assert held.has(held.all()).where("not present").isEmpty() and held.all().count() == tree.chunks.count()
    rows = chunks.read_tree(held.get(held.all()), tree.root).select(F.col("key").cast("string").alias("key"), F.lit("kept").alias("what"))
    rows = materialize(rows, "chunk-rows")
    gone = held.delete(tree.chunks.select("addr"))
    left = gone.all().agg(F.count("*").alias("n")).select(F.lit("chunks").alias("key"), F.when(F.col("n") == 0, "none left").otherwise("some left").alias("what"))
    return rows.unionByName(left)


@register("store_create", f"WITH {D}, {LIVE} SELECT {LIVE_ROW}, (SELECT max(epoch) FROM d) AS epoch FROM live")
def store_create(spark, sf):
    """A store value written as a folder's first checkpoint, opened anew; its LIVE partition is enough for current values."""
    d = event_facts(spark, sf)
    top = d.agg(F.max("epoch")).first()[0]
    db = create(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", FactStore(d, schema.genesis(spark), top), node_id(1))
    again, level = cold_start(spark, db.files.root, node_id(1))
    assert level == "checkpoint" and again.datoms().count() == d.count()
    return _live_row(live.live_set(again.live_first())).withColumn("epoch", F.lit(again.epoch).cast("bigint"))


@register("filter_custom", f"WITH {D} SELECT {ROW} FROM d WHERE v % 2 = 0 AND a <> 'event/click'")
def filter_custom(spark, sf):
    even = filters.Custom("even", lambda: F.col("v_long") % 2 == 0, monotone=True)
    return portable(filters.And((even, filters.Not(filters.AttributeNamespace(("event/click",))))).apply(event_facts(spark, sf)))


@register("tree_proofs", f"WITH {D} SELECT e || '|' || a || '|' || l AS key, true AS proven FROM d WHERE l IN (7, 8, 9)")
def tree_proofs(spark, sf):
    """Three entries proven by their paths to the root, which is all a light client holds."""
    pairs = _pairs(event_facts(spark, sf))
    tree = chunks.build_tree(pairs)
    root, _ = chunks.commitment(tree)
    out = []
    for r in _pairs(event_facts(spark, sf).where(F.col("tx_log").isin(7, 8, 9))).collect():
        proof = chunks.inclusion_proof(tree, bytes(r.key))
        out.append((r.key.decode(), chunks.check_proof(proof, root, bytes(r.key), bytes(r.value)) and not chunks.check_proof(proof, root, bytes(r.key), b"other")))
    return spark.createDataFrame(out, "key string, proven boolean")
